"""Structured Streaming jobs over run telemetry."""
