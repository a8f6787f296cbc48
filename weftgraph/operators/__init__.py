"""Operators over property graphs."""
