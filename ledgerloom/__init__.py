"""Spark-first normalisation of property registers, and corpus preparation on Spark."""
