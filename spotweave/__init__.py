"""Spatial-transcriptomics and cohort analytics as Spark DataFrame operators."""
