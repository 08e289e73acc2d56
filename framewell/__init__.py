"""Framewell: Spark jobs over media-pipeline telemetry, benchmark sweeps and pixel tables."""
