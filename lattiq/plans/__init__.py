"""Queries over the test tables, one per operator family."""
