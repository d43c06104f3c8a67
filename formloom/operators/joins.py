"""Joins by order, range, text and key sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formloom.functions import text as tx


def asof_backward(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str], bucket: str = "month") -> DataFrame:
    """Each left row with the ``values`` of the latest right row of its key at or before its time.

    Both sides are laid in one stream and the last right row is carried forward, so no pairs are
    formed. The stream of a key is cut into time buckets: rows are ordered within a bucket only,
    and what a bucket ends with is carried over one row per bucket, so a hot key does not end up
    in one task. Of right rows at one time, the largest by ``values`` counts. Left rows with a null
    key or time have null values.
    """
    pick = F.struct(F.col(right_time).alias("_t"), *values)
    lcols = left.columns
    lrows = left.withColumn("_k", F.col(key)).withColumn("_at", F.col(left_time)).withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(right.select(pick.alias("x")).schema["x"].dataType))
    rrows = right.filter(F.col(key).isNotNull() & F.col(right_time).isNotNull()).select(
        *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in lcols], F.col(key).alias("_k"), F.col(right_time).alias("_at"), F.lit(0).alias("_side"), pick.alias("_v")
    )
    both = lrows.unionByName(rrows).withColumn("_b", F.date_trunc(bucket, F.col("_at")))
    ends = both.filter("_side = 0").groupBy("_k", "_b").agg(F.max("_v").alias("_end"))
    over = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    spans = both.select("_k", "_b").distinct().join(ends, ["_k", "_b"], "left").withColumn("_carry", F.max("_end").over(over)).select("_k", "_b", "_carry")
    inside = Window.partitionBy("_k", "_b").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    done = both.withColumn("_own", F.max("_v").over(inside)).filter("_side = 1").join(spans, ["_k", "_b"], "left")
    best = F.coalesce("_own", "_carry")
    return done.select(*lcols, *[best[v].alias(v) for v in values])


def between_marks(rows: DataFrame, keys: list[str], order: list[str], mark: Column, name: str) -> DataFrame:
    """Adds the number of the section a row lies in: how many marks have come by then."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.sum(F.when(mark, 1).otherwise(0)).over(w).cast("long"))


def neighbours(rows: DataFrame, keys: list[str], order: list[str], is_mark: Column, is_row: Column, value: str) -> DataFrame:
    """For each marked row the nearest other row before and after it."""
    up = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    v = F.when(is_row, F.col(value))
    return rows.withColumn("above", F.last(v, ignorenulls=True).over(up)).withColumn("below", F.first(v, ignorenulls=True).over(down)).filter(is_mark)


def best_line(items: DataFrame, lines: DataFrame, page: list[str], item: str, item_text: str, pos: str, line_text: str) -> DataFrame:
    """Each item with the line of its page that holds its text or stands in it: most shared tokens,
    then first; null where none shares a token.

    Candidates are paired through shared tokens of a page, so a page does not pair every line with every
    item; a token that stands in all of them still does.
    """
    i = items.select(*page, item, F.col(item_text).alias("_it"), F.array_distinct(tx.tokens(F.col(item_text))).alias("_iw"))
    lines = lines.join(items.select(*page).distinct(), page, "left_semi")
    ln = lines.select(*page, pos, F.col(line_text).alias("_lt"), F.array_distinct(tx.tokens(F.col(line_text))).alias("_lw"))
    words = ln.select(*page, pos, F.explode("_lw").alias("_w"))
    pairs = i.select(*page, item, F.explode("_iw").alias("_w")).join(words, [*page, "_w"]).groupBy(*page, item, pos).agg(F.count(F.lit(1)).alias("score"))
    hit = pairs.join(i, [*page, item]).join(ln, [*page, pos]).filter(F.contains("_lt", "_it") | F.contains("_it", "_lt"))
    best = hit.groupBy(*page, item).agg(F.min_by(F.struct(F.col(pos), F.col("score")), F.struct(-F.col("score"), F.col(pos))).alias("_b"))
    return items.select(*page, item).join(best, [*page, item], "left").select(*page, item, F.col(f"_b.{pos}").alias("line_pos"), F.coalesce(F.col("_b.score"), F.lit(0)).cast("long").alias("score"))


def division(rows: DataFrame, group: str, member: str, wanted: list) -> DataFrame:
    """Groups that hold all ``wanted`` members."""
    need = list(dict.fromkeys(wanted))
    return rows.filter(F.col(member).isin(need)).groupBy(group).agg(F.countDistinct(member).alias("_n")).filter(F.col("_n") == len(need)).select(group)


def exact_then_partial(queries: DataFrame, q_id: str, q_text: str, entries: DataFrame, e_ord: str, e_text: str) -> DataFrame:
    """The first entry equal to a query's text, else the first that stands in it as whole words.

    Partial matches go through an index of the entries' word runs: the runs of a query's words, up
    to the length of the longest entry, are joined by equality. Entries are few and their lengths
    bounded, so no query is compared with every entry.
    """
    form = lambda c: F.array_join(tx.tokens(c), " ")
    e = entries.select(F.col(e_ord).alias("_o"), F.col(e_text).alias("_t"), form(F.col(e_text)).alias("_f")).filter("_f <> ''")
    longest = e.agg(F.max(F.size(F.split("_f", " ")))).first()[0] or 1
    q = queries.select(F.col(q_id), F.col(q_text).alias("_q"))
    exact = q.join(e, F.col("_q") == F.col("_t")).groupBy(q_id).agg(F.min_by("_t", "_o").alias("_exact"))
    runs = q.select(q_id, F.explode(F.array_distinct(tx.phrases(tx.tokens(F.col("_q")), longest))).alias("_f"))
    part = runs.join(e, "_f").groupBy(q_id).agg(F.min_by("_t", "_o").alias("_part"))
    return q.join(exact, q_id, "left").join(part, q_id, "left").select(
        q_id, F.coalesce("_exact", "_part").alias("entry"), F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_part").isNotNull(), "partial").alias("how")
    )


def best_similar(rows: DataFrame, entries: DataFrame, block: str, left: str, right: str, score: Column, least: float, bound: Column | None = None) -> DataFrame:
    """Each distinct left text with its best entry of the same block, from ``least`` on. Texts are
    deduplicated before pairing; ties go to the smaller entry. Pairs whose ``bound``, a cheap value
    not under the score, is below ``least`` are not scored."""
    l = rows.select(block, left).distinct()
    pairs = l.join(entries.select(block, right).distinct(), block)
    pairs = (pairs if bound is None else pairs.filter(bound >= least)).withColumn("score", score).filter(F.col("score") >= least)
    return pairs.groupBy(block, left).agg(F.min_by(F.struct(F.col(right), F.col("score")), F.struct(-F.col("score"), F.col(right))).alias("_b")).select(block, left, f"_b.{right}", "_b.score")


def inject_missing(ranked: DataFrame, targets: DataFrame, key: str, item: str, score: str, lift: float = 2.0) -> DataFrame:
    """Adds the targets a ranking lacks, each with the key's best score plus ``lift``."""
    top = ranked.groupBy(key).agg((F.max(score) + lift).alias(score))
    missing = targets.select(key, item).distinct().join(ranked.select(key, item), [key, item], "left_anti").join(top, key)
    return ranked.select(key, item, score, F.lit(False).alias("injected")).unionByName(missing.select(key, item, score, F.lit(True).alias("injected")))


def overlapping(boxes: DataFrame, regions: DataFrame, page: str, box: tuple[str, str, str, str], region: tuple[str, str, str, str], cell: float) -> DataFrame:
    """Boxes joined with the regions of the same page they overlap, with the shared ``area``.

    Both sides are laid on bands of height ``cell`` and joined by page and band, so a page is not one key;
    a pair that shares several bands is taken in the first of them only. Boxes and regions are
    (x0, y0, x1, y1); touching edges do not overlap; boxes with a null corner match nothing.
    """
    def banded(df: DataFrame, low: str, high: str, name: str) -> DataFrame:
        first, last = F.floor(F.col(low) / cell), F.floor(F.col(high) / cell)
        return df.filter(F.col(low) <= F.col(high)).withColumn(name, first).withColumn("_band", F.explode(F.sequence(first, last)))

    j = banded(boxes, box[1], box[3], "_f1").join(banded(regions, region[1], region[3], "_f2"), [page, "_band"]).filter(F.col("_band") == F.greatest("_f1", "_f2"))
    wide = F.least(box[2], region[2]) - F.greatest(box[0], region[0])
    tall = F.least(box[3], region[3]) - F.greatest(box[1], region[1])
    return j.filter((wide > 0) & (tall > 0)).withColumn("area", wide * tall).drop("_band", "_f1", "_f2")
