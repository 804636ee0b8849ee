"""Readers with explicit schemas; none infers types from the data."""
