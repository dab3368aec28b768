"""Registry of named queries and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from boxtally.plans.fixtures import cte

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    ids: str
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(ids: str, sql: str | None = None, tables: str = "", recursive: bool = False):
    """Register a query under its function name.

    ``ids`` are the inventory items it covers; ``tables`` the derived tables
    that ``sql`` reads, put in front of it as a WITH list.
    """
    def wrap(fn: Query) -> Query:
        text = sql
        if text is not None and tables:
            head = "with recursive" if recursive else "with"
            body = text.strip()
            rest = body[len("with "):] if body.lower().startswith("with ") else None
            text = f"{head} {cte(*tables.split())}" + (f",\n{rest}" if rest else f"\n{body}")
        name = fn.__name__
        if name in REGISTRY:
            raise ValueError(f"query {name!r} registered twice")
        REGISTRY[name] = Entry(fn, ids, text)
        return fn

    return wrap
