"""All queries over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from . import archive_queries, corpus_queries, document_queries, scoring_queries, shape_queries, text_queries, training_queries  # noqa: F401  they register their queries
from .registry import QUERIES, SQL, Query

FLAGSHIP = "cer_by_role"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
