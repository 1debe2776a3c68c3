"""Stay-level risk modelling on Spark DataFrames."""
