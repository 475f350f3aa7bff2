"""Queries over the driver's tables."""

from shalebed.plans import catalog, logs, pools, queries, tables, texts

__all__ = ["catalog", "logs", "pools", "queries", "tables", "texts"]
