"""Readers for ratings and items; sinks for result sets."""
