"""All queries of the image and byte operators, with their SQL."""

from __future__ import annotations

from . import registry, trained

QUERIES, SQL = registry.QUERIES, registry.SQL

__all__ = ["QUERIES", "SQL", "registry", "trained"]
