"""Spark-first analytics for dense, indexed sequences of sample planes and audio."""
