"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from vakya.llm import abuse, formatdup, langid, leaks, looks, mixing, neardup, pii, quality, quota

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _m in (pii, formatdup, quota, abuse, looks, langid, neardup, leaks, mixing, quality):
    QUERIES |= _m.QUERIES
    SQL |= getattr(_m, "SQL", {})
