"""What can go wrong with variants, states, histories and solutions."""


class PlyframeError(Exception):
    """Base of all errors of this package."""


class VariantMalformed(PlyframeError):
    """A variant string that names no member of its game family."""


class StateMalformed(PlyframeError):
    """A string that is no state of its variant."""


class InvalidHistory(PlyframeError):
    """A sequence of states that no play produces."""


class InvalidGraph(PlyframeError):
    """Nodes and edges that make no finite game."""


class SolverViolation(PlyframeError):
    """A game that breaks what the solver relies on, such as a cycle."""


class InvalidConversion(PlyframeError):
    """A utility that is none of -1, 0 and 1."""


class SchemaError(PlyframeError):
    """A table layout that is incomplete or names a column twice."""
