"""Code-risk analytics as operators over Spark DataFrames."""
