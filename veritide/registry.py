"""Queries over the given tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import wraps
from importlib import import_module

from pyspark.sql import types as T

from veritide.shipping import ship

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None, dates: Sequence[str] = ()):
    """Register a function (spark, sf_dir) -> DataFrame under its name; ``sql`` is its DuckDB form.

    Dates come out as ISO text on both sides (``dates`` names those of ``sql``), since the two
    engines hand them to Python as different types.
    """

    def keep(f: Callable) -> Callable:
        @wraps(f)
        def run(spark, sf_dir):
            ship(spark)
            df = f(spark, sf_dir)
            return df.withColumns({c.name: df[c.name].cast("string") for c in df.schema if isinstance(c.dataType, T.DateType)})

        QUERIES[f.__name__] = run
        if sql is not None:
            as_text = ", ".join(f"cast(cast({d} as date) as varchar) as {d}" for d in dates)
            ORACLES[f.__name__] = f"select * replace ({as_text}) from ({sql})" if dates else sql
        return run

    return keep


def load() -> None:
    for name in ("scoring", "tables", "records"):
        import_module(f"veritide.plans.{name}")
