"""hushframe: privacy-preserving analytics on PySpark DataFrames."""
