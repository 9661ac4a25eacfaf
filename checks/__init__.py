"""Queries over the test tables, their inputs and the equivalent SQL."""
