"""Speech-corpus and transcript analytics on PySpark DataFrames."""
