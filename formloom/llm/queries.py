"""Queries p3, p6, p7, p8 and p9 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.catalog import spread, table
from formloom.llm import dedup, entries, leak, quality, tokenizer
from formloom.plans.shaping import packed_sql


def _texts(spark: SparkSession, root: str) -> DataFrame:
    return spread(table(spark, root, "documents").select("doc_id", "text"))


def _records(spark: SparkSession, root: str) -> DataFrame:
    return spread(table(spark, root, "page_annotations").select("row_id", "study_id", "text", "annotation", "loaded_at"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """The dictionary entry meant by each hand-typed value."""
    return entries.map_entries(table(spark, root, "typed_entries"), table(spark, root, "sdtm_variables"), table(spark, root, "ct_terms"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Records of a study that differ in formatting only; the newest month comes to a ledger of all before."""
    records = _records(spark, root)
    return dedup.duplicate_members(records, batch=dedup.latest_delivery(records, "loaded_at"))


def p6_copies(spark: SparkSession, root: str) -> DataFrame:
    """Each distinct record with its number of copies."""
    records = _records(spark, root)
    return dedup.duplicate_counts(records, batch=dedup.latest_delivery(records, "loaded_at"))


_LETTERS = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{M}}\p{{N}}]', '', 'g')"
_P6_KEYS = f"""WITH k AS (SELECT row_id, study_id, {_LETTERS.format("text")} AS t,
  list_sort(list_filter(list_transform({packed_sql("annotation")}, lambda y: {_LETTERS.format("y")}), lambda y: y <> '')) AS a FROM page_annotations WHERE regexp_matches(text, '\\S')),
g AS (SELECT study_id, t, a, min(row_id) AS first_id, count(*) AS n_copies FROM k GROUP BY ALL)
"""


def p7_ids(spark: SparkSession, root: str) -> DataFrame:
    """Token ids of every document."""
    return tokenizer.encode_documents(_texts(spark, root))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents that hold at least half of an evaluation item."""
    return leak.leaks(_texts(spark, root), table(spark, root, "eval_items"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents that are no natural prose, with their kind."""
    return quality.not_prose(_texts(spark, root))


def p9_quality(spark: SparkSession, root: str) -> DataFrame:
    """Quality statistics of every document with what makes it an outlier."""
    df = quality.quality(_texts(spark, root))
    return df.withColumn("contributions", F.array_join(F.transform("contributions", lambda v: F.format_number(v, 3)), ";"))


QUERIES = {
    "p3_found": p3_found,
    "p6_found": p6_found,
    "p6_copies": p6_copies,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p9_found": p9_found,
    "p9_quality": p9_quality,
}
# Fuzzy matching, BPE, alignments and robust fits have no SQL; tests compare them with brute force.
ORACLES: dict[str, str] = {
    "p6_found": _P6_KEYS + "SELECT first_id, row_id AS copy_id FROM k JOIN g ON k.study_id IS NOT DISTINCT FROM g.study_id AND k.t = g.t AND k.a = g.a WHERE row_id <> first_id",
    "p6_copies": _P6_KEYS + "SELECT study_id, first_id, n_copies FROM g",
}
