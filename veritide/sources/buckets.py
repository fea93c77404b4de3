"""Co-partitioned storage: tables that are bucketed and sorted by the keys they are joined on."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame


def bucketed(df: DataFrame, keys: Sequence[str], n: int, path: str, name: str | None = None) -> DataFrame:
    """``df`` written under ``path`` in ``n`` buckets by ``keys``, each sorted, and a reader that knows it.

    Tables with the same keys and number of buckets are joined and grouped on them without an
    exchange: what is shuffled once here is never shuffled again. ``name`` is that of the table
    in the catalog. A bucket is one task of every later join, so ``n`` follows the size of the
    largest table, and a key that holds a large share of the rows does not belong here: such a
    bucket cannot be split.
    """
    name = name or f"bucketed_{uuid.uuid4().hex}"
    # one file a bucket: rows are dealt to their bucket before they are written
    df.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)
