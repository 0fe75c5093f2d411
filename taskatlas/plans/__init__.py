"""Whole runs and the query catalogue."""
