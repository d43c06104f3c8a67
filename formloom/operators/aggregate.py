"""Aggregations: counts with totals, outliers, nested summaries, indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts_with_totals(df: DataFrame, levels: list[str], kinds: str, names: list[str]) -> DataFrame:
    """Counts of each kind per level, with subtotals (rollup); nulls of a level mark a subtotal."""
    return df.rollup(*levels).agg(*[F.count_if(F.col(kinds) == n).alias("n_" + "".join(c for c in n.lower() if c.isalnum())) for n in names], F.count(F.lit(1)).alias("n_all"))


def outliers(counts: DataFrame, doc: list[str], unit: str, value: str, extra: DataFrame | None = None) -> DataFrame:
    """Reasons why a unit's count stands out of its document: two population deviations from the
    mean, zero, above twice or below three tenths of the mean (mean above five). Units without a
    reason give no row."""
    w = Window.partitionBy(*doc)
    c = F.col(value)
    rows = counts.withColumn("mean", F.avg(c).over(w)).withColumn("sd", F.stddev_pop(c).over(w))
    reasons = F.array_compact(
        F.array(
            F.when(F.abs(c - F.col("mean")) > 2 * F.col("sd"), "statistical_outlier"),
            F.when(c == 0, "zero"),
            F.when(c > 2 * F.col("mean"), "high"),
            F.when((c < 0.3 * F.col("mean")) & (F.col("mean") > 5), "low"),
        )
    )
    return rows.withColumn("reasons", reasons).filter(F.size("reasons") > 0).select(*doc, unit, value, F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.array_join("reasons", ",").alias("reasons"))


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the largest ``order``, by one aggregation without a sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def three_way(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of two sets with where they stand: left, right or both."""
    a = left.select(key).distinct().withColumn("_l", F.lit(1))
    b = right.select(key).distinct().withColumn("_r", F.lit(1))
    side = F.when(F.col("_r").isNull(), "left").when(F.col("_l").isNull(), "right").otherwise("both")
    return a.join(b, key, "full").select(key, side.alias("side"))


def inverted_index(df: DataFrame, id_col: str, terms: Column, least_df: int = 1) -> DataFrame:
    """(term, n_docs, n_tokens, first_id, last_id): statistics of the postings of each term. The
    postings themselves stay rows (``postings``): a list per term would not be bounded."""
    p = postings(df, id_col, terms)
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("tf").alias("n_tokens"), F.min(id_col).alias("first_id"), F.max(id_col).alias("last_id")).filter(F.col("n_docs") >= least_df)


def postings(df: DataFrame, id_col: str, terms: Column) -> DataFrame:
    """(term, id, tf): one row per term of a document. Terms are counted within the document before
    any shuffle."""
    return df.select(F.col(id_col), F.explode(terms).alias("term")).groupBy("term", id_col).agg(F.count(F.lit(1)).alias("tf"))
