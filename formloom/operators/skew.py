"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_join(rows: DataFrame, lookup: DataFrame, keys: list[str], heavy_share: float = 0.001, how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``lookup`` (unique by ``keys``). Keys that hold more than ``heavy_share`` of
    all rows number at most ``1 / heavy_share``; their lookup rows are broadcast and their rows
    stay where they are. All other keys go through a shuffled join. ``how``: inner or left. Null
    keys match nothing; a left join keeps them."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.agg(F.count(F.lit(1))).first()[0]
    least = max(1, int(total * heavy_share))
    heavy = counts.filter(F.col("_n") > least).select(*keys).join(lookup, keys).withColumn("_heavy", F.lit(True))
    values = [c for c in lookup.columns if c not in keys]
    marked = rows.join(F.broadcast(heavy), keys, "left")
    by_broadcast = marked.filter(F.col("_heavy")).drop("_heavy")
    rest = marked.filter(F.col("_heavy").isNull()).drop("_heavy", *values).join(lookup, keys, how)
    return by_broadcast.unionByName(rest)
