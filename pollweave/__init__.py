"""Survey weighting and poll aggregation as Spark DataFrame operators."""
