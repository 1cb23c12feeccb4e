"""caseloom: case-record analytics on PySpark DataFrames."""
