"""lagweave: spatial econometrics on Spark DataFrames."""
