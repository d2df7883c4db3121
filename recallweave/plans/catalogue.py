"""Registered queries over the driver's tables, each with SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if SQL can express it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def load() -> None:
    from . import hangul, memory, retrieval, stats, stories, upkeep  # noqa: F401  registration


#: SQL of the shared first steps.
MESSAGES = """msg AS (
  SELECT chat_id, id, role, text, row_number() OVER (PARTITION BY chat_id ORDER BY seq, id)::INT AS turn FROM (
    SELECT conv_id::VARCHAR AS chat_id, turn AS seq, conv_id::VARCHAR || ':' || turn::VARCHAR AS id, role, text FROM conversations
    WHERE role IN ('user', 'assistant') AND text IS NOT NULL AND length(trim(text)) > 0
    QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY turn) = 1))"""


def clean(x: str) -> str:
    """SQL of the searchable text (no own blocks occur in the tables)."""
    out = x
    for p in (r"\[//\]:\s*#\s*\([^\n]*\)", r"<!--[\s\S]*?-->"):
        out = f"regexp_replace({out}, '{p}', '', 'g')"
    for p in (r"```(?:INFO)?[^`]*```", r"!\[[^\]]*\]\([^)]+\)", r"\[(?:💼|🤝|📝)[^\]\n]*\][^\n]*", r"\s+"):
        out = f"regexp_replace({out}, '{p}', ' ', 'g')"
    return f"trim({out})"


def terms(x: str) -> str:
    return f"regexp_extract_all(lower({clean(x)}), '[a-z0-9_]{{2,}}')"


def bm25(n: str = "n", df: str = "df", tf: str = "tf", length: str = "length", avg: str = "avg_length") -> str:
    return f"({tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * {length} / {avg})) * ln(1 + ({n} - {df} + 0.5) / ({df} + 0.5)))"


def index_sql(units: str) -> str:
    """Postings, frequencies and statistics of a relation (chat_id, unit_id, text)."""
    return f"""each AS (SELECT chat_id, unit_id, unnest({terms('text')}) AS term FROM {units}),
post AS (SELECT chat_id, unit_id, term, count(*) AS tf FROM each GROUP BY ALL),
dfs AS (SELECT chat_id, term, count(*) AS df FROM post GROUP BY ALL),
lens AS (SELECT chat_id, unit_id, len({terms('text')}) AS length FROM {units}),
stat AS (SELECT chat_id, count(*) AS n, greatest(1.0, avg(length)) AS avg_length FROM lens GROUP BY ALL)"""
