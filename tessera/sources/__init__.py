"""Readers for vocabularies and models."""
