"""Instruction-tuning corpora: steps, messages, splits and weights, all deterministic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Order of patterns when a row names several.
PRIORITY = ["findings", "conditional", "supplemental", "direct", "plain"]


def _starts(name: str):
    return lambda p: p.startswith(name)


def canonical_pattern(c: Column) -> Column:
    """One pattern of a comma-separated list by priority, without a '_single' ending; a lone
    'direct' counts as 'plain'. Null and blank lists have none."""
    parts = F.filter(F.transform(F.split(F.lower(c), ","), lambda p: F.regexp_replace(F.trim(p), "_single$", "")), lambda p: p != "")
    out = F.when(F.size(parts) == 0, F.lit(None).cast("string")).when((F.size(parts) == 1) & (parts[0] == "direct"), "plain")
    for name in PRIORITY:
        out = out.when(F.exists(parts, _starts(name)), name)
    return out.otherwise(parts[0])


def steps(rows: DataFrame, keep: list[str], label: str, domain: str, pattern: str, annotation: str) -> DataFrame:
    """Up to three instruction rows of each labelled row: domain, pattern and variable."""
    def row(step: str, instruction: Column, output: Column, holds: Column) -> Column:
        return F.when(holds, F.struct(F.lit(step).alias("step"), instruction.alias("instruction"), output.alias("output")))
    ask = F.concat(F.lit("Field: "), F.col(label))
    three = F.array_compact(
        F.array(
            row("domain", F.concat(F.lit("Name the domain. "), ask), F.col(domain), F.col(domain) != ""),
            row("pattern", F.concat(F.lit("Name the pattern. "), ask, F.lit("; domain: "), F.coalesce(domain, F.lit("unknown"))), F.col(pattern), F.col(pattern).isNotNull()),
            row("variable", F.concat(F.lit("Write the annotation. "), ask, F.lit("; pattern: "), F.coalesce(pattern, F.lit("unknown"))), F.col(annotation), F.col(annotation) != ""),
        )
    )
    return rows.select(*keep, F.explode(three).alias("_s")).select(*keep, "_s.*")


def chat(system: Column, user: Column, answer: Column) -> Column:
    """messages: an array of (role, content)."""
    return F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in (("system", system), ("user", user), ("assistant", answer))])


def hash_order(id_col: Column, seed: str) -> Column:
    """A total order that looks random and is the same everywhere."""
    return F.md5(F.concat(F.lit(seed + "|"), id_col.cast("string")))


def split(rows: DataFrame, group: str, id_col: str, share: float, seed: str) -> DataFrame:
    """Adds the split: in each group, the first max(1, share) rows by hash order validate, the rest train.

    Ranks are taken within the groups of a first hex digit and offset by the counts before, so no
    task sorts a whole group."""
    h = rows.withColumn("_h", hash_order(F.col(id_col), seed)).withColumn("_b", F.substring("_h", 1, 2))
    sizes = h.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(group).orderBy("_b")
    sizes = sizes.withColumn("_before", F.sum("_c").over(w) - F.col("_c")).withColumn("_n", F.sum("_c").over(Window.partitionBy(group)))
    inside = Window.partitionBy(group, "_b").orderBy("_h", id_col)
    r = h.withColumn("_r", F.row_number().over(inside)).join(sizes, [group, "_b"])
    n_val = F.greatest(F.lit(1), F.floor(F.col("_n") * share))
    return r.withColumn("split", F.when(F.col("_before") + F.col("_r") <= n_val, "validation").otherwise("train")).drop("_h", "_b", "_c", "_before", "_n", "_r")
