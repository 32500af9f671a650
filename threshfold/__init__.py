"""threshfold: DataFrame operators for mention studies and corpus preparation on Spark."""
