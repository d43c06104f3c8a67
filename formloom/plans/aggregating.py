"""Queries of aggregations, windows and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formloom.catalog import table
from formloom.functions import text as tx
from formloom.operators import aggregate, parse

from formloom.plans.parsing import _TAGGED


def agg_tag_counts_rollup(spark: SparkSession, root: str) -> DataFrame:
    """AGG01, AGG04: items by kind per source and document, with totals."""
    docs = table(spark, root, "documents")
    it = parse.tagged(docs, "doc_id", "text").join(docs.select("doc_id", "source"), "doc_id")
    return aggregate.counts_with_totals(it, ["source", "doc_id"], "tag", parse.TAGS)


def agg_qc_outliers(spark: SparkSession, root: str) -> DataFrame:
    """AGG02, AGG03, WIN09, DIG03: pages whose number of questions stands out of their study."""
    c = table(spark, root, "page_annotations").groupBy("study_id", "page_id").agg(F.count(F.lit(1)).alias("n"))
    return aggregate.outliers(c, ["study_id"], "page_id", "n")


_QC = """WITH c AS (SELECT study_id, page_id, count(*) AS n FROM page_annotations GROUP BY ALL),
s AS (SELECT *, avg(n) OVER (PARTITION BY study_id) AS m, stddev_pop(n) OVER (PARTITION BY study_id) AS sd FROM c),
r AS (SELECT study_id, page_id, n, round(m, 6) AS mean, round(sd, 6) AS sd, concat_ws(',', CASE WHEN abs(n - m) > 2 * sd THEN 'statistical_outlier' END, CASE WHEN n = 0 THEN 'zero' END,
 CASE WHEN n > 2 * m THEN 'high' END, CASE WHEN n < 0.3 * m AND m > 5 THEN 'low' END) AS reasons FROM s)
SELECT * FROM r WHERE reasons <> ''"""


def agg_grouping_sets(spark: SparkSession, root: str) -> DataFrame:
    """AGG05, AGG06: frequencies by domain class, by pattern and overall in one pass."""
    d = table(spark, root, "page_annotations").select(F.coalesce(F.nullif(F.trim("pattern"), F.lit("")), F.lit("unknown")).alias("pattern"), F.coalesce("form", F.lit("unknown")).alias("form"))
    return d.groupingSets([["pattern"], ["form"], []], "pattern", "form").agg(F.count(F.lit(1)).alias("n"))


def agg_mean_topk(spark: SparkSession, root: str) -> DataFrame:
    """AGG08: forms with the highest mean confidence, the five best of each study (a top-k report)."""
    m = table(spark, root, "page_annotations").filter("form IS NOT NULL").groupBy("study_id", "form").agg(F.round(F.avg("confidence"), 6).alias("mean"))
    w = Window.partitionBy("study_id").orderBy(F.desc("mean"), "form")
    return m.withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 5")


def agg_nested_summary(spark: SparkSession, root: str) -> DataFrame:
    """AGG09, SET06, KBB11: classes with their sorted domains."""
    return table(spark, root, "sdtm_domains").groupBy("domain_class").agg(F.countDistinct("domain_code").alias("n_domains"), F.array_join(F.array_sort(F.collect_set("domain_code")), ",").alias("domains"))


def agg_first_attributes(spark: SparkSession, root: str) -> DataFrame:
    """AGG14: variables by name; the first row's attributes stand, domains are counted."""
    return table(spark, root, "sdtm_variables").groupBy("var_name").agg(F.min_by("label", "variable_row").alias("label"), F.min_by("role", "variable_row").alias("role"), F.countDistinct("domain_code").alias("n_domains"))


def agg_inverted_index(spark: SparkSession, root: str) -> DataFrame:
    """AGG13, RET02, STR03: terms of two documents or more with their document counts (``agg_word_index`` has all)."""
    words = tx.tokens(F.col("text"), 3)
    return aggregate.inverted_index(table(spark, root, "documents").filter("text IS NOT NULL"), "doc_id", words, least_df=2)


_INDEX = """WITH p AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 3)) AS term FROM documents WHERE text IS NOT NULL)
SELECT term, count(DISTINCT doc_id) AS n_docs, count(*) AS n_tokens, min(doc_id) AS first_id, max(doc_id) AS last_id FROM p GROUP BY term HAVING count(DISTINCT doc_id) >= 2"""


def agg_debug_steps(spark: SparkSession, root: str) -> DataFrame:
    """AGG12, AGG15: how many steps users take, and the mean step value of each kind."""
    return table(spark, root, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_steps"), F.count_if(F.col("event_type") == "error").alias("n_errors"), F.round(F.avg("value"), 6).alias("mean_value"), F.countDistinct("event_type").alias("n_kinds")
    )


def agg_role_listing(spark: SparkSession, root: str) -> DataFrame:
    """AGG17, STR11: variables of each domain listed by role in a fixed role order."""
    order = F.array_position(F.array(*[F.lit(r) for r in ("Identifier", "Topic", "Timing", "Qualifier", "Rule")]), F.col("role"))
    v = table(spark, root, "sdtm_variables").groupBy("domain_code", "role").agg(F.array_join(F.array_sort(F.collect_set("var_name")), ", ").alias("names")).withColumn("ord", order)
    part = F.struct("ord", F.format_string("%s: %s", "role", "names").alias("t"))
    return v.groupBy("domain_code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda s: s["t"]), "; ").alias("listing"))


_ROLES = """WITH v AS (SELECT domain_code, role, string_agg(DISTINCT var_name, ', ' ORDER BY var_name) AS names FROM sdtm_variables GROUP BY ALL)
SELECT domain_code, string_agg(role || ': ' || names, '; ' ORDER BY CASE role WHEN 'Identifier' THEN 1 WHEN 'Topic' THEN 2 WHEN 'Timing' THEN 3 WHEN 'Qualifier' THEN 4 WHEN 'Rule' THEN 5 ELSE 0 END, role) AS listing FROM v GROUP BY domain_code"""


def agg_pivot_types(spark: SparkSession, root: str) -> DataFrame:
    """AGG01: event kinds as columns."""
    return table(spark, root, "events").groupBy("user_id").pivot("event_type", ["click", "purchase", "error", "signup", "view"]).count().na.fill(0)


def lk_variable_domains(spark: SparkSession, root: str) -> DataFrame:
    """JN14, JN16, AGG07, KBB10: domains of each variable, and whether it has several homes."""
    v = table(spark, root, "sdtm_variables").groupBy("var_name").agg(F.array_sort(F.collect_set("domain_code")).alias("d"))
    return v.select("var_name", F.array_join("d", ",").alias("domains"), (F.size("d") > 1).alias("multi_home"))


def lk_domain_variables(spark: SparkSession, root: str) -> DataFrame:
    """KBB12: live variables of each domain by role."""
    v = table(spark, root, "sdtm_variables").filter("deleted_at IS NULL")
    return v.groupBy("domain_code").agg(F.countDistinct("var_name").alias("n_variables"), F.countDistinct(F.when(F.col("core") == "Req", F.col("var_name"))).alias("n_required"), F.min("var_name").alias("first_variable"))


def lk_statistics(spark: SparkSession, root: str) -> DataFrame:
    """AGG07, AGG10: size of the dictionary."""
    v = table(spark, root, "sdtm_variables").groupBy("var_name").agg(F.countDistinct("domain_code").alias("n"))
    d = table(spark, root, "sdtm_variables").agg(F.countDistinct("domain_code").alias("n_domains"), F.countDistinct("codelist_code").alias("n_codelists"))
    return v.agg(F.count(F.lit(1)).alias("n_variables"), F.count_if(F.col("n") > 1).alias("n_multi_home")).crossJoin(d)


def set_three_way(spark: SparkSession, root: str) -> DataFrame:
    """SET01, SET02, SET04: codes used in annotations against codes of the dictionary."""
    used = table(spark, root, "page_annotations").select(F.explode(F.regexp_extract_all(F.upper("domain"), F.lit("[A-Z0-9]+"), F.lit(0))).alias("code"))
    return aggregate.three_way(used, table(spark, root, "sdtm_domains").select(F.col("domain_code").alias("code")), "code")


_THREE = """WITH u AS (SELECT DISTINCT unnest(regexp_extract_all(upper(domain), '[A-Z0-9]+')) AS code FROM page_annotations), d AS (SELECT DISTINCT domain_code AS code FROM sdtm_domains)
SELECT code, CASE WHEN d.k IS NULL THEN 'left' WHEN u.k IS NULL THEN 'right' ELSE 'both' END AS side FROM (SELECT code, 1 AS k FROM u) u FULL JOIN (SELECT code, 1 AS k FROM d) d USING (code)"""


def src_last_row_wins(spark: SparkSession, root: str) -> DataFrame:
    """SRC08, SRC09, AGG11: the newest version of each variable."""
    return aggregate.last_wins(table(spark, root, "sdtm_variables").select("var_name", "domain_code", "label", "role", "variable_row"), ["var_name", "domain_code"], "variable_row")


def src_union_sources(spark: SparkSession, root: str) -> DataFrame:
    """SET03, SET07, SRC10: terms of both sources, duplicates kept, with their origin."""
    a = table(spark, root, "ct_terms").select(F.lit("terms").alias("origin"), "codelist_code", F.col("submission_value").alias("value"))
    b = table(spark, root, "ct_relationships").filter("codelist_code IS NOT NULL").select(F.lit("uses").alias("origin"), F.upper(F.trim("codelist_code")).alias("codelist_code"), F.upper(F.trim("variable_name")).alias("value"))
    return a.unionByName(b).groupBy("origin", "codelist_code").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("value").alias("n_values"))


def src_ntz_filter_age(spark: SparkSession, root: str) -> DataFrame:
    """DTE01, SRC13: events of the last seven days of the table."""
    ev = table(spark, root, "events")
    last = ev.agg(F.max("ts").alias("_last"))
    return ev.crossJoin(F.broadcast(last)).filter(F.col("ts") >= F.col("_last") - F.expr("INTERVAL 7 DAYS")).select("event_id", "user_id", "ts")


def dig_document_summary(spark: SparkSession, root: str) -> DataFrame:
    """DIG05: one row per study file with its counts and whether it needs a second look."""
    pa = table(spark, root, "page_annotations")
    s = pa.groupBy("study_id").agg(F.countDistinct("page_id").alias("n_pages"), F.count(F.lit(1)).alias("n_items"), F.count_if(F.trim("annotation") != "").alias("n_annotated"), F.count_if(F.col("annotation") == "[NOT SUBMITTED]").alias("n_not_submitted"), F.count_if(F.col("text").isNull() | (F.trim("text") == "")).alias("n_malformed"))
    return s.withColumn("second_look", F.col("n_malformed") > 0.01 * F.col("n_items"))


def win_sessions(spark: SparkSession, root: str) -> DataFrame:
    """Extension: sessions of a user by a gap of thirty minutes, as running sums over the gaps."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(w) > F.expr("INTERVAL 30 MINUTES")
    ev = table(spark, root, "events").withColumn("_g", F.coalesce(gap, F.lit(True)).cast("int"))
    ev = ev.withColumn("session", F.sum("_g").over(w))
    return ev.groupBy("user_id", "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("n_events"))


def ext_tumbling(spark: SparkSession, root: str) -> DataFrame:
    """Extension: events per hour and kind."""
    ev = table(spark, root, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return ev.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


QUERIES = {f.__name__: f for f in (
    agg_tag_counts_rollup, agg_qc_outliers, agg_grouping_sets, agg_mean_topk, agg_nested_summary, agg_first_attributes, agg_inverted_index, agg_debug_steps, agg_role_listing, agg_pivot_types,
    lk_variable_domains, lk_domain_variables, lk_statistics, set_three_way, src_last_row_wins, src_union_sources, src_ntz_filter_age, dig_document_summary, win_sessions, ext_tumbling,
)}

ORACLES = {
    "agg_tag_counts_rollup": _TAGGED + """ SELECT source, doc_id, count(*) FILTER (WHERE tag = '<FORM>') AS n_form, count(*) FILTER (WHERE tag = '<SH>') AS n_sh, count(*) FILTER (WHERE tag = '<Q>') AS n_q,
 count(*) FILTER (WHERE tag = '<INPUT>') AS n_input, count(*) AS n_all FROM items JOIN (SELECT doc_id, source FROM documents) USING (doc_id) GROUP BY ROLLUP (source, doc_id)""",
    "agg_qc_outliers": _QC,
    "agg_grouping_sets": "SELECT pattern, form, count(*) AS n FROM (SELECT coalesce(nullif(trim(pattern, ' '), ''), 'unknown') AS pattern, coalesce(form, 'unknown') AS form FROM page_annotations) GROUP BY GROUPING SETS ((pattern), (form), ())",
    "agg_mean_topk": "SELECT * FROM (SELECT study_id, form, mean, row_number() OVER (PARTITION BY study_id ORDER BY mean DESC NULLS LAST, form) AS rank FROM (SELECT study_id, form, round(avg(confidence), 6) AS mean FROM page_annotations WHERE form IS NOT NULL GROUP BY ALL)) WHERE rank <= 5",
    "agg_nested_summary": "SELECT domain_class, count(DISTINCT domain_code) AS n_domains, string_agg(DISTINCT domain_code, ',' ORDER BY domain_code) AS domains FROM sdtm_domains GROUP BY 1",
    "agg_first_attributes": "SELECT var_name, arg_min(label, variable_row) AS label, arg_min(role, variable_row) AS role, count(DISTINCT domain_code) AS n_domains FROM sdtm_variables GROUP BY 1",
    "agg_inverted_index": _INDEX,
    "agg_debug_steps": "SELECT user_id, count(*) AS n_steps, count(*) FILTER (WHERE event_type = 'error') AS n_errors, round(avg(value), 6) AS mean_value, count(DISTINCT event_type) AS n_kinds FROM events GROUP BY 1",
    "agg_role_listing": _ROLES,
    "agg_pivot_types": "SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS {t}" for t in ("click", "purchase", "error", "signup", "view")) + " FROM events GROUP BY 1",
    "lk_variable_domains": "SELECT var_name, string_agg(DISTINCT domain_code, ',' ORDER BY domain_code) AS domains, count(DISTINCT domain_code) > 1 AS multi_home FROM sdtm_variables GROUP BY 1",
    "lk_domain_variables": "SELECT domain_code, count(DISTINCT var_name) AS n_variables, count(DISTINCT var_name) FILTER (WHERE core = 'Req') AS n_required, min(var_name) AS first_variable FROM sdtm_variables WHERE deleted_at IS NULL GROUP BY 1",
    "lk_statistics": "SELECT (SELECT count(DISTINCT var_name) FROM sdtm_variables) AS n_variables, (SELECT count(*) FROM (SELECT var_name FROM sdtm_variables GROUP BY 1 HAVING count(DISTINCT domain_code) > 1)) AS n_multi_home, count(DISTINCT domain_code) AS n_domains, count(DISTINCT codelist_code) AS n_codelists FROM sdtm_variables",
    "set_three_way": _THREE,
    "src_last_row_wins": "SELECT var_name, domain_code, label, role, variable_row FROM (SELECT *, row_number() OVER (PARTITION BY var_name, domain_code ORDER BY variable_row DESC) AS rn FROM sdtm_variables) WHERE rn = 1",
    "src_union_sources": "SELECT origin, codelist_code, count(*) AS n_rows, count(DISTINCT value) AS n_values FROM (SELECT 'terms' AS origin, codelist_code, submission_value AS value FROM ct_terms UNION ALL SELECT 'uses', upper(trim(codelist_code, ' ')), upper(trim(variable_name, ' ')) FROM ct_relationships WHERE codelist_code IS NOT NULL) GROUP BY ALL",
    "src_ntz_filter_age": "SELECT event_id, user_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAYS",
    "dig_document_summary": "SELECT *, n_malformed > 0.01 * n_items AS second_look FROM (SELECT study_id, count(DISTINCT page_id) AS n_pages, count(*) AS n_items, count(*) FILTER (WHERE trim(annotation, ' ') <> '') AS n_annotated, count(*) FILTER (WHERE annotation = '[NOT SUBMITTED]') AS n_not_submitted, count(*) FILTER (WHERE text IS NULL OR trim(text, ' ') = '') AS n_malformed FROM page_annotations GROUP BY 1)",
    "win_sessions": "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTES OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS g FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, CAST(sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM g) SELECT user_id, session, min(ts) AS started, max(ts) AS ended, count(*) AS n_events FROM s GROUP BY ALL",
    "ext_tumbling": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
