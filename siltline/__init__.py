"""Document-corpus analytics on Spark: DataFrame-in, DataFrame-out operators."""
