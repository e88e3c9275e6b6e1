"""Null-aware time-series analytics on Apache Spark."""
