"""DataFrame operators: each takes and returns DataFrames or ``pyspark.ml`` objects."""
