"""Operators for preparing training text at scale, each with its registered query."""
