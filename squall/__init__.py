"""Squall: a Spark-first analytics engine for Doppler weather-radar data."""
