"""Checks of inputs, and a runner of table constraints."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require(df: DataFrame, *columns: str) -> None:
    """Raise a ValueError that names the columns ``df`` lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required column(s): {', '.join(missing)}")


def not_null(name: str) -> tuple[str, Column]:
    return f"{name} is null", F.col(name).isNull()


def accepted(name: str, values: Iterable) -> tuple[str, Column]:
    return f"{name} is not an accepted value", F.col(name).isNotNull() & ~F.col(name).isin(list(values))


def violations(df: DataFrame, rules: list[tuple[str, Column]], unique: list[list[str]] = (), refers: list[tuple[str, DataFrame, str]] = ()) -> DataFrame:
    """``rule, n``: each broken rule and its number of rows.

    ``rules`` are (name, condition of a bad row), all counted in one pass; ``unique`` are lists
    of columns whose combinations must not repeat (n: surplus keys); ``refers`` are (column,
    table, its column) whose values must be found there. A table without violations gives no row.
    """
    parts = []
    if rules:
        counts = df.agg(*[F.count_if(bad).alias(f"r{i}") for i, (_, bad) in enumerate(rules)])
        pairs = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("n")) for i, (name, _) in enumerate(rules)])
        parts.append(counts.select(F.explode(pairs).alias("p")).select("p.rule", "p.n"))
    for keys in unique:
        twice = df.groupBy(*keys).count().where("count > 1")
        parts.append(twice.agg(F.count("*").alias("n")).select(F.lit(f"{', '.join(keys)} repeats").alias("rule"), "n"))
    for name, table, key in refers:
        orphans = df.where(F.col(name).isNotNull()).join(table.select(F.col(key).alias(name)), name, "left_anti")
        parts.append(orphans.agg(F.count("*").alias("n")).select(F.lit(f"{name} has no {key}").alias("rule"), "n"))
    return reduce(DataFrame.unionByName, parts).where("n > 0")


def same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one of two tables holds, with the side that has them."""
    x, y = a.select(keys).distinct(), b.select(keys).distinct()
    return x.join(y, keys, "left_anti").withColumn("side", F.lit("left")).unionByName(y.join(x, keys, "left_anti").withColumn("side", F.lit("right")))


def check_contract(docs: DataFrame, schema: str, text: str = "document", rules: list[tuple[str, Column]] = ()) -> DataFrame:
    """``rule, n`` for JSON texts that do not parse as ``schema``, lack a field of it or break a rule.

    Rules see the parsed document as column ``doc``; a field that is missing or null at the top
    level counts as lacking.
    """
    parsed = F.from_json(text, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    df = docs.select(parsed.alias("doc"))
    fields = [f.name for f in df.schema["doc"].dataType if f.name != "_corrupt"]
    broken = F.col("doc").isNull() | F.col("doc._corrupt").isNotNull()
    lacking = [(f"{name} is missing", ~broken & F.col(f"doc.{name}").isNull()) for name in fields]
    return violations(df, [("not a document", broken), *lacking, *[(n, ~broken & c) for n, c in rules]])
