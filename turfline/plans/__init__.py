"""Whole analyses and the named queries."""
