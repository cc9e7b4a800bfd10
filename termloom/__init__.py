"""termloom: vocabulary analytics on Spark DataFrames."""
