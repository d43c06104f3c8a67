"""References to dictionary keys that are missing, deleted or loaded later.

Rows: references are counted per key first. Keys that hold a large share of all references are few by
arithmetic (at most ``1 / heavy_share``); their versions are broadcast and each reference to them is
checked in place. All others go through one shuffled anti-join with the live spans of their keys, in
which the heavy ones that are left take part under keys of their own, so no task gets a hot key.

Counts: references are pre-aggregated per key and period. A group whose whole time span lies within
one state of its key gets one verdict; only groups whose state changes inside the span are judged
by the times of their references.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formloom.session import materialise

_KEY = ["field_name", "ref_key", "scope_key"]
_GROUP = ["table_name", *_KEY, "ref_month"]


@dataclass(frozen=True)
class Dimension:
    """Versions of the keys one field refers to: columns ref_key, scope_key, loaded_at, deleted_at."""

    field_name: str
    versions: DataFrame


def normal_key(column) -> F.Column:
    """Trimmed upper case; blank becomes null, which is no reference."""
    key = F.upper(F.regexp_replace(column, r"(?U)^\s+|\s+$", ""))
    return F.when(key != "", key)


def dimension(field_name: str, df: DataFrame, key: str, scope: str | None = None) -> Dimension:
    rows = df.select(
        F.lit(field_name).alias("field_name"),
        normal_key(F.col(key)).alias("ref_key"),
        (F.coalesce(normal_key(F.col(scope)), F.lit("")) if scope else F.lit("")).alias("scope_key"),
        "loaded_at",
        "deleted_at",
    )
    return Dimension(field_name, rows.filter(F.col("ref_key").isNotNull()))


def references(df: DataFrame, table_name: str, field_name: str, row_id: str, keys, time: str, scope=None) -> DataFrame:
    """One row for each distinct key a row refers to; ``keys`` is an array column of normal keys.
    Rows without a time cannot be judged and give none. A null scope is the scope ''."""
    return (
        df.select(
            F.lit(table_name).alias("table_name"),
            F.col(row_id).alias("row_id"),
            F.lit(field_name).alias("field_name"),
            F.explode(F.array_distinct(keys)).alias("ref_key"),
            (F.coalesce(normal_key(scope), F.lit("")) if scope is not None else F.lit("")).alias("scope_key"),
            F.col(time).alias("ref_time"),
        )
        .filter(F.col("ref_key").isNotNull() & F.col("ref_time").isNotNull())
        .withColumn("ref_month", F.date_format("ref_time", "yyyy-MM"))
    )


def _judge(groups: DataFrame, versions: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """reason of each group by the versions of its key: 'live', 'missing', 'late', 'deleted', or
    'mixed' where the state changes between ``low`` and ``high``."""
    v = versions.select("field_name", "ref_key", "scope_key", F.col("loaded_at").alias("_l"), F.col("deleted_at").alias("_d"))
    ended = F.coalesce(F.col("_d"), F.lit("9999-12-31").cast("timestamp_ntz"))
    joined = groups.join(v, _KEY, "left")
    covers = (F.col("_l") <= F.col(low)) & (ended > F.col(high))
    touches = (F.col("_l") <= F.col(high)) & (ended > F.col(low)) & (ended > F.col("_l"))
    agg = joined.groupBy(*keys).agg(
        F.max(F.coalesce(covers, F.lit(False))).alias("_covers"),
        F.max(F.coalesce(touches, F.lit(False))).alias("_touches"),
        F.min("_l").alias("_first"),
        F.first(low).alias("_low"),
        F.first(high).alias("_high"),
    )
    return agg.withColumn(
        "reason",
        F.when(F.col("_first").isNull(), "missing")
        .when(F.col("_covers"), "live")
        .when(F.col("_touches"), "mixed")
        .when(F.col("_first") > F.col("_high"), "late")
        .when(F.col("_first") <= F.col("_low"), "deleted")
        .otherwise("mixed"),
    ).drop("_covers", "_touches", "_first", "_low", "_high")


def _versions(dims: list[Dimension]) -> DataFrame:
    rows = dims[0].versions
    for d in dims[1:]:
        rows = rows.unionByName(d.versions)
    return rows.withColumn("loaded_at", F.col("loaded_at").cast("timestamp_ntz")).withColumn("deleted_at", F.col("deleted_at").cast("timestamp_ntz")).filter(F.col("loaded_at").isNotNull()).distinct()


def group_verdicts(refs: DataFrame, dims: list[Dimension]) -> DataFrame:
    """(table_name, field_name, ref_key, scope_key, ref_month, n_refs, reason) of every (key, period) group."""
    groups = refs.groupBy(*_GROUP).agg(
        F.count(F.lit(1)).alias("n_refs"),
        F.min(F.col("ref_time").cast("timestamp_ntz")).alias("_lo"),
        F.max(F.col("ref_time").cast("timestamp_ntz")).alias("_hi"),
    )
    return _judge(groups, _versions(dims), [*_GROUP, "n_refs"], "_lo", "_hi")


def orphan_references(refs: DataFrame, dims: list[Dimension], heavy_share: float = 0.001) -> DataFrame:
    """(table_name, row_id, field_name, ref_key, reason, ref_month) of all references without a
    live row at their time; columns as TESTDATA.md has them for p2.

    Nulls are no references; a version with null loaded_at never was live; one deleted before it
    was loaded counts as never live. Repeated rows of one id give one result each key and month. Empty
    inputs give an empty result.
    """
    versions = _versions(dims)
    counts = materialise(refs.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("_n")), "reference-counts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    heavy = counts.filter(F.col("_n") > max(1, int(total * heavy_share))).select(*_KEY)  # at most 1 / heavy_share rows
    spans = heavy.join(versions, _KEY, "left").groupBy(*_KEY).agg(F.min("loaded_at").alias("_hf"), F.collect_list(F.when(F.col("loaded_at").isNotNull(), F.struct("loaded_at", "deleted_at"))).alias("_spans"))

    t = F.col("_t")
    marked = refs.withColumn("_t", F.col("ref_time").cast("timestamp_ntz")).join(F.broadcast(spans), _KEY, "left")
    is_heavy = F.col("_spans").isNotNull()
    live = F.exists("_spans", lambda v: (v["loaded_at"] <= t) & (v["deleted_at"].isNull() | (v["deleted_at"] > t)))
    left = marked.filter(~is_heavy | ~live).withColumn("_k", F.when(is_heavy, F.concat(F.lit("\u0000"), F.xxhash64("table_name", "row_id").cast("string"))).otherwise(F.col("ref_key")))

    v = versions.select(F.col("field_name").alias("_vf"), F.col("ref_key").alias("_vk"), F.col("scope_key").alias("_vs"), F.col("loaded_at").alias("_l"), F.col("deleted_at").alias("_d"))
    same = (F.col("field_name") == F.col("_vf")) & (F.col("_k") == F.col("_vk")) & (F.col("scope_key") == F.col("_vs"))
    dead = left.join(v, same & (F.col("_l") <= t) & (F.col("_d").isNull() | (F.col("_d") > t)), "left_anti")
    first = v.groupBy("_vf", "_vk", "_vs").agg(F.min("_l").alias("_first"))
    known = F.coalesce("_hf", "_first")
    reason = F.when(known.isNull(), "missing").when(known > t, "late").otherwise("deleted")
    return dead.join(first, same, "left").select("table_name", "row_id", "field_name", "ref_key", reason.alias("reason"), "ref_month").distinct()


def orphan_counts(refs: DataFrame, dims: list[Dimension]) -> DataFrame:
    """Orphan references per table, field, reason and month, from the pre-aggregated groups. Repeated rows
    count each time."""
    verdicts = materialise(group_verdicts(refs, dims), "orphan-groups").filter(F.col("reason") != "live")
    mixed = verdicts.filter(F.col("reason") == "mixed").select(*_GROUP)
    times = refs.withColumn("_t", F.col("ref_time").cast("timestamp_ntz")).join(mixed, _GROUP, "left_semi").groupBy(*_GROUP, "_t").agg(F.count(F.lit(1)).alias("n_refs"))
    judged = _judge(times, _versions(dims), [*_GROUP, "_t", "n_refs"], "_t", "_t").filter(F.col("reason") != "live")
    cols = [*_GROUP, "reason", "n_refs"]
    found = verdicts.filter(F.col("reason") != "mixed").select(cols).unionByName(judged.select(cols))
    return found.groupBy("table_name", "field_name", "reason", "ref_month").agg(F.sum("n_refs").alias("n_refs"), F.countDistinct("ref_key").alias("n_keys"))
