"""Operators on categories."""
