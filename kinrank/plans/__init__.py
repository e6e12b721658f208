"""Experiments, the registered query catalogue and its oracle SQL."""
