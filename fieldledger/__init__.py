"""Farm-survey, price-series and aggregate-supply analytics as Spark DataFrame operators."""
