"""Composed jobs, and the corpus views that queries derive from the test tables."""
