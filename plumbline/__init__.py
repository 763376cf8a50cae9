"""Data quality on Spark: measure, profile, bin, index and monitor tables."""
