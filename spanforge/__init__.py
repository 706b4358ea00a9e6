"""Spark-first analytics over append-only event logs."""
