"""Spark analytics for gridded space-time fields and sparse sensor arrays."""
