"""Readers of record stores, and views of the shared tables."""
