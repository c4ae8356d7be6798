"""Registered queries and SQL functions."""
