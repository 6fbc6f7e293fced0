"""All queries of the library outside of the language-model subpackage."""

from __future__ import annotations

from marginalia.plans import activity, articles, commerce, content, joined, learning, operations, reading, rules
from marginalia.plans.registry import ORACLE_SQL, QUERIES

flagship = activity.event_funnel

__all__ = ["ORACLE_SQL", "QUERIES", "activity", "articles", "commerce", "content", "flagship", "joined", "learning", "operations", "reading", "rules"]
