"""Whole jobs: fit on past events, score new ones."""
