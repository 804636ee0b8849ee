"""Staging of intermediate tables and the plans made of several operators."""
