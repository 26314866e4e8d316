"""The commit log, native tables and external Parquet."""
