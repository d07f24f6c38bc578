"""Housing-market statistics as PySpark DataFrame functions."""
