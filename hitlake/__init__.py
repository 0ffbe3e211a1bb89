"""hitlake: detector-hit analytics on PySpark DataFrames."""
