import subprocess
import sys

HIDE = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r} or name.startswith({name!r} + "."):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as e
print(len(e.queries()), any(n.startswith("op1_") for n in e.queries()), "pipeline" in e.queries(), set(e.oracle_sql()) <= set(e.queries()))
"""


def seen(hidden):
    out = subprocess.run([sys.executable, "-c", HIDE.format(name=hidden)], capture_output=True, text=True, check=True).stdout.split()
    return int(out[0]), *(x == "True" for x in out[1:])


def test_the_games_need_neither_llm_nor_what_it_imports():
    games = seen("plyframe.llm")
    assert games[0] >= 48 and games[1:] == (False, False, True)
    assert seen("sentencepiece")[0] == games[0] and seen("sentencepiece")[1:] == (False, False, True)
    n, has_ops, has_pipeline, _ = seen("corpus_pipeline")
    assert n >= games[0] and not has_pipeline
