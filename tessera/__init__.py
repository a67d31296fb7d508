"""A PySpark-native analytics engine: SQL tables, deltas and views over DataFrames."""
