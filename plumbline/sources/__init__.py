"""Readers that return canonical tables, and the writers for result tables."""
