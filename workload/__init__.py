"""Queries on the shared test tables, each with equivalent SQL."""
