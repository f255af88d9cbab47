"""Multi-branch retail analytics on Spark: DataFrame in, DataFrame out."""
