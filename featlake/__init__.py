"""Feature engineering and event analytics on PySpark DataFrames."""
