"""Breakout and risk analytics over price bars, expressed as Spark jobs."""
