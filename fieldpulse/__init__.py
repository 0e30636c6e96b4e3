"""Telemetry analytics for networks of independent measuring nodes, as Spark DataFrame functions."""
