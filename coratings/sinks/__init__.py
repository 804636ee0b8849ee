"""Outputs. All of them replace what was there, also with an empty result."""
