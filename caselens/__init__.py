"""Case-file analytics on Spark: every operator is a DataFrame job keyed by case."""
