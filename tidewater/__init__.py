"""A versioned SQL engine on Spark: a strict dialect bound to DataFrames over Parquet and a commit log."""
