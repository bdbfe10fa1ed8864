"""The registry of named queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its checking SQL where SQL can express it."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


#: Normal forms as DuckDB writes them; {0} is the text.
def sql_squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[ \t\n\r\f]+', ' ', 'g'), ' ')"


def sql_norm(x: str) -> str:
    return sql_squeeze(
        rf"regexp_replace(strip_accents(replace(lower({x}), 'ß', 'ss')), '[^\p{{L}}\p{{N}}_ \t\n\r\f]', ' ', 'g')"
    )


def sql_clean(x: str) -> str:
    return (
        f"(case when lower(trim(coalesce({x}, ''), ' ')) in ('', 'nan', 'none', 'null', 'na', 'n/a') "
        f"then '' else trim(coalesce({x}, ''), ' ') end)"
    )


def sql_ascii(x: str) -> str:
    return (
        rf"trim(regexp_replace(lower(regexp_replace(strip_accents({sql_clean(x)}), '[^\x00-\x7F]', '', 'g')), "
        r"'[^a-z0-9]+', ' ', 'g'))"
    )


def sql_first_author(x: str) -> str:
    return sql_ascii(rf"regexp_extract({sql_clean(x)}, '^[^;|]*')")


def sql_doi(x: str) -> str:
    return (
        rf"regexp_replace(trim(regexp_replace(regexp_replace(lower({sql_clean(x)}), "
        rf"'^https?://(?:dx\.)?[^/\s]+/(10\.)', '\1'), '^doi:\s*', '')), '[.,;)]+$', '')"
    )
