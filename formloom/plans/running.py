"""Queries of streams, hooks and seed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom import hooks
from formloom.catalog import table
from formloom.operators import parse
from formloom.session import scratch_path
from formloom.sources import seeds
from formloom.streaming import pages


def _items_folder(spark: SparkSession, root: str) -> str:
    items = parse.tagged(table(spark, root, "documents"), "doc_id", "text").select("doc_id", "pos", "tag", "text")
    path = scratch_path(spark, "items")
    items.write.parquet(path)
    return path


def stm_page_state(spark: SparkSession, root: str) -> DataFrame:
    """STM01: context carried by a stream with state over all tagged items."""
    path = _items_folder(spark, root)
    stream = pages.carry_context(spark.readStream.schema(pages.ITEM_SCHEMA).parquet(path))
    return pages.run_to_end(stream, scratch_path(spark, "stream-out"), scratch_path(spark, "stream-state"))


def stm_page_state_batch(spark: SparkSession, root: str) -> DataFrame:
    """STM03: the same result of the finished table."""
    return pages.carry_context_batch(parse.tagged(table(spark, root, "documents"), "doc_id", "text").select("doc_id", "pos", "tag", "text"))


def hook_generator(spark: SparkSession, root: str) -> DataFrame:
    """UDF01 to UDF04: default generator over all questions."""
    return hooks.generate(table(spark, root, "page_annotations").select("row_id", "text"), "text", "answer").select("row_id", "answer")


def hook_reranker(spark: SparkSession, root: str) -> DataFrame:
    """UDF06, UDF08: default reranker of annotations against their questions."""
    return table(spark, root, "page_annotations").filter("text IS NOT NULL").select("row_id", F.round(hooks.shared_words(F.col("text"), F.coalesce("option_annotations", F.lit(""))), 6).alias("score"))


def kbb_seed_variables(spark: SparkSession, root: str) -> DataFrame:
    """KBB01: identifier variables of the seed domains."""
    return seeds.identifier_variables(spark)


def kbb_seed_terms(spark: SparkSession, root: str) -> DataFrame:
    """KBB04, AGG10: seed codelists with the number of their terms, and codes that stand twice."""
    t = seeds.terms(spark)
    return t.groupBy("codelist_code", "codelist_name").agg(F.count(F.lit(1)).alias("n_terms"), (F.count(F.lit(1)) - F.countDistinct("term_code")).alias("n_repeated"))


def kbb_codelist_by_suffix(spark: SparkSession, root: str) -> DataFrame:
    """KBB05: codelists of variables by the end of their names."""
    return table(spark, root, "sdtm_variables").select("variable_row", F.concat("var_name", F.when(F.col("role") == "Rule", "UNIT").otherwise("SEV")).alias("name")).withColumn("code", seeds.codelist_of(F.col("name")))


from formloom.plans.parsing import _TAGGED  # noqa: E402


def _values(text: str) -> str:
    quoted = lambda r: "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")"
    return "VALUES " + ", ".join(map(quoted, seeds.rows(text)))

_STATE = _TAGGED + """
SELECT doc_id, pos, tag, text, last_value(CASE WHEN tag = '<FORM>' THEN text END IGNORE NULLS) OVER w AS form, last_value(CASE WHEN tag = '<SH>' THEN text END IGNORE NULLS) OVER w AS section,
 CASE WHEN sum(CASE WHEN tag = '<Q>' THEN 1 ELSE 0 END) OVER w > 0 THEN printf('q-%03d', CAST(sum(CASE WHEN tag = '<Q>' THEN 1 ELSE 0 END) OVER w - 1 AS BIGINT)) END AS qid
FROM items WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""

QUERIES = {f.__name__: f for f in (stm_page_state, stm_page_state_batch, hook_generator, hook_reranker, kbb_seed_variables, kbb_seed_terms, kbb_codelist_by_suffix)}
ORACLES = {
    "stm_page_state": _STATE,
    "stm_page_state_batch": _STATE,
    "hook_generator": r"SELECT row_id, CASE WHEN regexp_matches(lower(coalesce(text, '')), 'other,? *specify') THEN 'supplemental' WHEN regexp_matches(lower(coalesce(text, '')), '\b(result|score|rate)\b') THEN 'findings' WHEN regexp_matches(lower(coalesce(text, '')), '\bdate\b') THEN 'plain' ELSE 'direct' END AS answer FROM page_annotations",
    "hook_reranker": "WITH w AS (SELECT row_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS q, list_filter(regexp_split_to_array(lower(coalesce(option_annotations, '')), '[^a-z0-9]+'), lambda x: x <> '') AS d FROM page_annotations WHERE text IS NOT NULL) SELECT row_id, round(CASE WHEN len(q) > 0 THEN len(list_intersect(q, d)) / len(q) ELSE 0 END, 6) AS score FROM w",
    "kbb_seed_variables": f"SELECT d.code AS domain, i.name, i.label, 'Identifier' AS role FROM ({_values(seeds.DOMAINS)}) d(code, n, c), ({_values(seeds.IDENTIFIERS)}) i(name, label)",
    "kbb_seed_terms": f"SELECT codelist_code, codelist_name, count(*) AS n_terms, count(*) - count(DISTINCT term_code) AS n_repeated FROM ({_values(seeds.TERMS)}) t(codelist_code, codelist_name, v, p, term_code) GROUP BY ALL",
    "kbb_codelist_by_suffix": "SELECT variable_row, var_name || CASE WHEN role = 'Rule' THEN 'UNIT' ELSE 'SEV' END AS name, CASE WHEN role = 'Rule' THEN 'C66770' ELSE 'C66769' END AS code FROM sdtm_variables",
}
