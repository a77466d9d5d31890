"""Record and evidence linkage, and training-data preparation, on Spark DataFrames."""
