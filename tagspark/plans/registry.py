"""Where named queries and their checking SQL are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tagspark.plans.library import TABLES, VIEW_SQL, Library

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, tuple[str, tuple[str, ...]]] = {}

_PLAIN = {t: t for t in TABLES}


def norm(column: str) -> str:
    """SQL text of the tag normal form; the given tables hold no white space but spaces."""
    return f"lower(trim(replace(replace({column}, '_', ' '), '-', ' ')))"


def view_sql(name: str) -> str:
    text = VIEW_SQL[name].format(**_PLAIN)
    return f"SELECT *, {norm('tag')} AS tag_norm FROM ({text})" if name == "file_tags" else text


# Further named parts of checking SQL: text and the parts it reads.
PARTS: dict[str, tuple[str, tuple[str, ...]]] = {}


def part(name: str, text: str, *reads: str) -> None:
    PARTS[name] = (text, reads)


def with_parts(body: str, reads: tuple[str, ...]) -> str:
    """The SQL with every view and part it reads, in order, as common table expressions."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in done:
            return
        if name in PARTS:
            text, inner = PARTS[name]
            for other in inner:
                add(other)
            done[name] = text
        else:
            done[name] = view_sql(name)

    for name in reads:
        add(name)
    head = ",\n".join(f"{name} AS ({text})" for name, text in done.items())
    recursive = "RECURSIVE " if "batch_starts" in done else ""
    return f"WITH {recursive}{head}\n{body}" if done else body


def query(*reads: str, sql: str | None = None) -> Callable:
    """Register a function of a Library under its own name, with its checking SQL if there is one."""

    def register(build: Callable[[Library], DataFrame]) -> Callable[[Library], DataFrame]:
        name = build.__name__
        QUERIES[name] = lambda spark, folder: build(Library(spark, folder))
        if sql is not None:
            _SQL[name] = (sql, reads)
        return build

    return register


def checking_sql() -> dict[str, str]:
    """Query name -> complete SQL text."""
    return {name: with_parts(sql, reads) for name, (sql, reads) in _SQL.items()}
