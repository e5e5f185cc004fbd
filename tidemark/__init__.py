"""Telemetry analytics on PySpark: readings, day frames, models and findings."""
