"""Table definitions, delimited files, Parquet stores and row output."""
