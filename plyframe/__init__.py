"""plyframe: finite sequential games as Spark DataFrames."""
