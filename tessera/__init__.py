"""A Spark-native engine for machine-learning analytics on DataFrames."""
