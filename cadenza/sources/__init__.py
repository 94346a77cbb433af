"""Readers of activity files, listings, weather and maps; each returns lazy tables."""
