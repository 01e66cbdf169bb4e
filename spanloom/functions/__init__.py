"""Spanloom subpackage."""
