"""Feeds, series and files."""
