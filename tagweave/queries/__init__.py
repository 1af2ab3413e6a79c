"""The registered queries."""

from tagweave.queries import boxes, labels, records, text, tracks, streams  # noqa: F401
from tagweave.queries.registry import oracle_sql, queries  # noqa: F401
