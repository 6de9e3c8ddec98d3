"""The registered queries and their SQL."""

from mnemora.plans import changed, indexed, queries, store

__all__ = ["changed", "indexed", "queries", "store"]
