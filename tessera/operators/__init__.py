"""Operators on slices of bytes."""
