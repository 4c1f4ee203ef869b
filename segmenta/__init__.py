"""Spark-first analytics over segmented sensor recordings."""
