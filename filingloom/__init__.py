"""filingloom: document analytics on Spark DataFrames."""
