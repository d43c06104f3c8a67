"""Queries of joins and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formloom.catalog import spread, table
from formloom.functions import text as tx
from formloom.functions.fuzzy import ratio_bound, sequence_ratio
from formloom.operators import joins, parse


def jn_asof_backward(spark: SparkSession, root: str) -> DataFrame:
    """JN10: the study's relationship that was newest when a page was annotated."""
    pa = table(spark, root, "page_annotations").select("row_id", "study_id", "annotated_at")
    ct = table(spark, root, "ct_relationships").select("study_id", "created_at", "rel_id")
    return joins.asof_backward(pa, ct, "study_id", "annotated_at", "created_at", ["rel_id"]).select("row_id", "rel_id")


_ASOF = """SELECT p.row_id, c.rel_id FROM page_annotations p ASOF LEFT JOIN
 (SELECT study_id, created_at, max(rel_id) AS rel_id FROM ct_relationships GROUP BY ALL) c ON p.study_id = c.study_id AND p.annotated_at >= c.created_at"""


def jn_range_section(spark: SparkSession, root: str) -> DataFrame:
    """JN08, WIN03: the stretch between two purchases each event of a user lies in."""
    ev = table(spark, root, "events").select("event_id", "user_id", "ts", "event_type")
    return joins.between_marks(ev, ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase", "section").select("event_id", "section")


def jn_neighbours(spark: SparkSession, root: str) -> DataFrame:
    """JN11, JN06: for each section header the question above and the question below."""
    it = parse.tagged(table(spark, root, "documents"), "doc_id", "text")
    return joins.neighbours(it, ["doc_id"], ["pos"], F.col("tag") == "<SH>", F.col("tag") == "<Q>", "pos").select("doc_id", "pos", "above", "below")


def jn_contains_argmax(spark: SparkSession, root: str) -> DataFrame:
    """JN07, SET05, JN09: each distinct answer of a page with the line of the page that holds it best."""
    docs = spread(table(spark, root, "documents").select("doc_id", "text"))
    lines = parse.lines(docs, "doc_id", "text")
    items = parse.tagged(docs, "doc_id", "text").filter("tag = '<INPUT>' AND text <> ''").groupBy("doc_id", "text").agg(F.min("pos").alias("item"))
    return joins.best_line(items, lines, ["doc_id"], "item", "text", "pos", "line")


def jn_equi_chain(spark: SparkSession, root: str) -> DataFrame:
    """JN01, JN02, JN03, JN04: variables with the class of their domain and the terms of their codelists."""
    v = table(spark, root, "sdtm_variables").filter("deleted_at IS NULL").select("var_name", "domain_code", "codelist_code").distinct()
    d = table(spark, root, "sdtm_domains").filter("deleted_at IS NULL").groupBy("domain_code").agg(F.max("domain_class").alias("domain_class"))
    t = table(spark, root, "ct_terms").groupBy("codelist_code").agg(F.count(F.lit(1)).alias("n_terms"), F.min("submission_value").alias("first_term"))
    return v.join(d, "domain_code", "left").join(t, "codelist_code", "left").select("var_name", "domain_code", "codelist_code", F.coalesce("domain_class", F.lit("Unknown")).alias("domain_class"), F.coalesce("n_terms", F.lit(0)).cast("long").alias("n_terms"), "first_term")


_CHAIN = """WITH v AS (SELECT DISTINCT var_name, domain_code, codelist_code FROM sdtm_variables WHERE deleted_at IS NULL),
d AS (SELECT domain_code, max(domain_class) AS domain_class FROM sdtm_domains WHERE deleted_at IS NULL GROUP BY 1),
t AS (SELECT codelist_code, count(*) AS n_terms, min(submission_value) AS first_term FROM ct_terms GROUP BY 1)
SELECT var_name, domain_code, v.codelist_code, coalesce(domain_class, 'Unknown') AS domain_class, coalesce(n_terms, 0) AS n_terms, first_term
FROM v LEFT JOIN d USING (domain_code) LEFT JOIN t ON v.codelist_code = t.codelist_code"""


def jn_exact_then_partial(spark: SparkSession, root: str) -> DataFrame:
    """JN13, JN20, RET09: typed answers to labels: equal first, else the first whole-word part."""
    q = table(spark, root, "typed_entries").filter("submission_value IS NOT NULL").select("entry_id", "submission_value")
    e = table(spark, root, "ct_terms").groupBy("submission_value").agg(F.min("term_id").alias("ord"))
    return joins.exact_then_partial(q, "entry_id", "submission_value", e, "ord", "submission_value")


_PARTIAL = r"""WITH q AS (SELECT entry_id, submission_value AS t, list_filter(regexp_split_to_array(lower(submission_value), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM typed_entries WHERE submission_value IS NOT NULL),
e AS (SELECT submission_value AS t, array_to_string(list_filter(regexp_split_to_array(lower(submission_value), '[^a-z0-9]+'), lambda x: x <> ''), ' ') AS f, min(term_id) AS o FROM ct_terms GROUP BY ALL),
x AS (SELECT entry_id, arg_min(e.t, o) AS t FROM q JOIN e ON q.t = e.t GROUP BY 1),
p AS (SELECT entry_id, arg_min(e.t, o) AS t FROM q JOIN e ON e.f <> '' AND contains(' ' || array_to_string(w, ' ') || ' ', ' ' || e.f || ' ') GROUP BY 1)
SELECT q.entry_id, coalesce(x.t, p.t) AS entry, CASE WHEN x.t IS NOT NULL THEN 'exact' WHEN p.t IS NOT NULL THEN 'partial' END AS how FROM q LEFT JOIN x USING (entry_id) LEFT JOIN p USING (entry_id)"""


def jn_fuzzy_levenshtein(spark: SparkSession, root: str) -> DataFrame:
    """JN12, FZY02, FLT04: best variable of the domain for each typed name by edit ratio."""
    t = table(spark, root, "typed_entries").filter("trim(annotation) <> ''").select("domain_code", F.upper(F.trim("annotation")).alias("typed"))
    v = table(spark, root, "sdtm_variables").select("domain_code", "var_name")
    return joins.best_similar(t, v, "domain_code", "typed", "var_name", F.round(tx.edit_ratio(F.col("typed"), F.col("var_name")), 6), 0.6)


_LEV = """WITH t AS (SELECT DISTINCT domain_code, upper(trim(annotation)) AS typed FROM typed_entries WHERE trim(annotation) <> ''),
v AS (SELECT DISTINCT domain_code, var_name FROM sdtm_variables),
p AS (SELECT domain_code, typed, var_name, round(1 - levenshtein(typed, var_name) / greatest(length(typed), length(var_name)), 6) AS score FROM t JOIN v USING (domain_code)),
r AS (SELECT *, row_number() OVER (PARTITION BY domain_code, typed ORDER BY score DESC, var_name) AS rn FROM p WHERE score >= 0.6)
SELECT domain_code, typed, var_name, score FROM r WHERE rn = 1"""


def jn_fuzzy_ratio(spark: SparkSession, root: str) -> DataFrame:
    """FZY01, JN12: the same by the sequence-matcher ratio (no SQL equivalent)."""
    t = table(spark, root, "typed_entries").filter("trim(annotation) <> ''").select("domain_code", F.upper(F.trim("annotation")).alias("typed"))
    v = table(spark, root, "sdtm_variables").select("domain_code", "var_name")
    return joins.best_similar(t, v, "domain_code", "typed", "var_name", F.round(sequence_ratio("typed", "var_name"), 6), 0.6, F.round(ratio_bound(F.col("typed"), F.col("var_name")), 6))


#: Pairs of texts with the ratio worked out by hand: twice the matching characters over all characters.
KNOWN_RATIOS = [("abcd", "bcde", 0.75), ("", "", 1.0), ("abc", "xyz", 0.0), ("AETERM", "AETRT", 0.727273), ("same text", "same text", 1.0), ("ab", "", 0.0), ("tide", "diet", 0.25), ("diet", "tide", 0.5)]


def fzy_known_ratios(spark: SparkSession, root: str) -> DataFrame:
    """FZY01: the sequence-matcher ratio of pairs with known ratios, and its bound."""
    df = spark.createDataFrame([(a, b) for a, b, _ in KNOWN_RATIOS], "a string, b string")
    return df.select("a", "b", F.round(sequence_ratio("a", "b"), 6).alias("ratio"), (F.round(ratio_bound(F.col("a"), F.col("b")), 6) >= F.round(sequence_ratio("a", "b"), 6)).alias("bounded"))


def jn_alias_ngrams(spark: SparkSession, root: str) -> DataFrame:
    """JN18, ARR02: labels that stand in question texts, through word runs of up to three words."""
    q = spread(table(spark, root, "page_annotations").select("row_id", "text")).filter("text IS NOT NULL").select("row_id", F.explode(F.array_distinct(tx.phrases(tx.tokens(F.col("text")), 3))).alias("alias"))
    a = table(spark, root, "sdtm_domains").select(F.explode(F.array(F.lower("domain_name"), F.lower(F.substring_index("domain_name", " ", -1)))).alias("alias"), "domain_code").groupBy("alias").agg(F.min("domain_code").alias("domain_code"))
    return q.join(a, "alias").select("row_id", "alias", "domain_code")


_ALIAS = r"""WITH w AS (SELECT row_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM page_annotations WHERE text IS NOT NULL),
p AS (SELECT DISTINCT row_id, array_to_string(w[i:i + n - 1], ' ') AS alias FROM w, range(1, 4) t(n), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
a AS (SELECT alias, min(domain_code) AS domain_code FROM (SELECT lower(domain_name) AS alias, domain_code FROM sdtm_domains UNION ALL SELECT lower(split_part(domain_name, ' ', -1)), domain_code FROM sdtm_domains) GROUP BY 1)
SELECT row_id, alias, domain_code FROM p JOIN a USING (alias)"""


def jn_inject_missing(spark: SparkSession, root: str) -> DataFrame:
    """JN19, WIN08: codelists a study ought to use, added to its ranking."""
    ct = table(spark, root, "ct_relationships").filter("codelist_code IS NOT NULL").withColumn("code", F.upper(F.trim("codelist_code")))
    ranked = ct.groupBy("study_id", "code").agg(F.count(F.lit(1)).cast("double").alias("score"))
    live = table(spark, root, "ct_codelists").filter("extensible").select(F.col("codelist_code").alias("code")).distinct()
    targets = ct.select("study_id").distinct().crossJoin(F.broadcast(live))  # the grid of studies and the fixed codelists is the ranking's key space
    return joins.inject_missing(ranked, targets, "study_id", "code", "score")


_INJECT = """WITH r AS (SELECT study_id, upper(trim(codelist_code)) AS code, CAST(count(*) AS DOUBLE) AS score FROM ct_relationships WHERE codelist_code IS NOT NULL GROUP BY ALL),
l AS (SELECT DISTINCT codelist_code AS code FROM ct_codelists WHERE extensible),
m AS (SELECT s.study_id, l.code, s.top + 2.0 AS score FROM (SELECT study_id, max(score) AS top FROM r GROUP BY 1) s, l WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.study_id = s.study_id AND r.code = l.code))
SELECT study_id, code, score, false AS injected FROM r UNION ALL SELECT study_id, code, score, true FROM m"""


def jn_class_lookup(spark: SparkSession, root: str) -> DataFrame:
    """JN17, JN14: first class of each domain used in annotations, with a default."""
    used = table(spark, root, "page_annotations").filter("trim(domain) <> ''").select(F.explode(F.array_distinct(F.regexp_extract_all(F.upper("domain"), F.lit("[A-Z0-9]+"), F.lit(0)))).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n_rows"))
    cls = table(spark, root, "sdtm_domains").groupBy(F.col("domain_code").alias("code")).agg(F.min_by("domain_class", "domain_row").alias("domain_class"))
    return used.join(cls, "code", "left").select("code", "n_rows", F.coalesce("domain_class", F.lit("Unknown")).alias("domain_class"))


_CLASS = """WITH u AS (SELECT code, count(*) AS n_rows FROM (SELECT DISTINCT row_id, unnest(regexp_extract_all(upper(domain), '[A-Z0-9]+')) AS code FROM page_annotations WHERE trim(domain) <> '') GROUP BY 1),
c AS (SELECT domain_code AS code, arg_min(domain_class, domain_row) AS domain_class FROM sdtm_domains GROUP BY 1)
SELECT code, n_rows, coalesce(domain_class, 'Unknown') AS domain_class FROM u LEFT JOIN c USING (code)"""


def jn_option_match(spark: SparkSession, root: str) -> DataFrame:
    """JN21, RET10: typed answers that equal a term's value or its code, by either key."""
    q = table(spark, root, "typed_entries").filter("submission_value IS NOT NULL").select("entry_id", F.upper(F.trim("submission_value")).alias("k"))
    t = table(spark, root, "ct_terms")
    keys = t.select(F.explode(F.array_distinct(F.array_compact(F.array(F.upper("submission_value"), F.upper("nci_c_code"))))).alias("k"), "term_id")
    return q.join(keys, "k").groupBy("entry_id").agg(F.countDistinct("term_id").alias("n_terms"), F.min("term_id").alias("first_term"))


_OPTION = """WITH k AS (SELECT upper(submission_value) AS k, term_id FROM ct_terms UNION SELECT upper(nci_c_code), term_id FROM ct_terms)
SELECT entry_id, count(DISTINCT term_id) AS n_terms, min(term_id) AS first_term FROM typed_entries q JOIN k ON upper(trim(q.submission_value)) = k.k GROUP BY 1"""


def jn_page_files(spark: SparkSession, root: str) -> DataFrame:
    """JN23, SRC05: pages joined by the number in their file names."""
    page = F.regexp_extract("file", r"page_(\d+)", 1).cast("int")
    a = table(spark, root, "page_annotations").withColumn("n", page).groupBy("study_id", "n").agg(F.count(F.lit(1)).alias("n_rows"))
    b = table(spark, root, "page_results").withColumn("n", page).groupBy("study_id", "n").agg(F.count(F.lit(1)).alias("n_results"))
    return a.join(b, ["study_id", "n"], "full")


_FILES = r"""WITH a AS (SELECT study_id, TRY_CAST(nullif(regexp_extract(file, 'page_(\d+)', 1), '') AS INTEGER) AS n, count(*) AS n_rows FROM page_annotations GROUP BY ALL),
b AS (SELECT study_id, TRY_CAST(nullif(regexp_extract(file, 'page_(\d+)', 1), '') AS INTEGER) AS n, count(*) AS n_results FROM page_results GROUP BY ALL)
SELECT study_id, n, n_rows, n_results FROM a FULL JOIN b USING (study_id, n)"""


def flt_required_members(spark: SparkSession, root: str) -> DataFrame:
    """FLT09, JN15: domains that have all of three variables by their stems."""
    v = table(spark, root, "sdtm_variables").select("domain_code", F.expr("substring(var_name, 3)").alias("stem"))
    return joins.division(v, "domain_code", "stem", ["RSLT", "TSTC", "LATY"])


def flt_membership(spark: SparkSession, root: str) -> DataFrame:
    """FLT14, SET04: studies and domain codes that are, or are not, in the dictionary."""
    ct = table(spark, root, "ct_relationships").select("study_id", F.upper(F.trim("domain_code")).alias("code")).distinct()
    known = table(spark, root, "sdtm_domains").select(F.col("domain_code").alias("code")).distinct()
    return ct.join(known, "code", "left_semi").withColumn("known", F.lit(True)).unionByName(ct.join(known, "code", "left_anti").withColumn("known", F.lit(False)))


def val_referential(spark: SparkSession, root: str) -> DataFrame:
    """VAL08, JN22: first failing reference of each relationship."""
    ct = table(spark, root, "ct_relationships").select("rel_id", F.upper(F.trim("domain_code")).alias("d"), F.upper(F.trim("variable_name")).alias("v"), F.upper(F.trim("codelist_code")).alias("c"))
    dom = table(spark, root, "sdtm_domains").select(F.col("domain_code").alias("d")).distinct().withColumn("_d", F.lit(1))
    var = table(spark, root, "sdtm_variables").select(F.col("domain_code").alias("d"), F.col("var_name").alias("v")).distinct().withColumn("_v", F.lit(1))
    code = table(spark, root, "ct_codelists").select(F.col("codelist_code").alias("c")).distinct().withColumn("_c", F.lit(1))
    j = ct.join(dom, "d", "left").join(var, ["d", "v"], "left").join(code, "c", "left")
    return j.select("rel_id", F.when(F.col("_d").isNull(), "domain").when(F.col("v").isNotNull() & F.col("_v").isNull(), "variable").when(F.col("c").isNotNull() & F.col("_c").isNull(), "codelist").otherwise("valid").alias("verdict"))


_REFERENTIAL = """WITH c AS (SELECT rel_id, upper(trim(domain_code)) AS d, upper(trim(variable_name)) AS v, upper(trim(codelist_code)) AS c FROM ct_relationships)
SELECT rel_id, CASE WHEN d IS NULL OR d NOT IN (SELECT domain_code FROM sdtm_domains) THEN 'domain'
 WHEN v IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sdtm_variables x WHERE x.domain_code = d AND x.var_name = v) THEN 'variable'
 WHEN c IS NOT NULL AND c NOT IN (SELECT codelist_code FROM ct_codelists) THEN 'codelist' ELSE 'valid' END AS verdict FROM c"""


def fzy_did_you_mean(spark: SparkSession, root: str) -> DataFrame:
    """FZY03: first five variables of the domain that hold the first three letters of an unknown name (the five are the feature)."""
    v = table(spark, root, "sdtm_variables").select("domain_code", "var_name").distinct()
    t = table(spark, root, "typed_entries").filter("length(trim(annotation)) >= 3").select("domain_code", F.upper(F.trim("annotation")).alias("typed")).distinct()
    unknown = t.join(v.withColumnRenamed("var_name", "typed"), ["domain_code", "typed"], "left_anti")
    hit = unknown.join(v, "domain_code").filter(F.contains("var_name", F.substring("typed", 1, 3)))
    w = Window.partitionBy("domain_code", "typed").orderBy("var_name")
    return hit.withColumn("_r", F.row_number().over(w)).filter("_r <= 5").groupBy("domain_code", "typed").agg(F.array_join(F.array_sort(F.collect_list("var_name")), ",").alias("suggestions"))


_MEAN = """WITH v AS (SELECT DISTINCT domain_code, var_name FROM sdtm_variables), t AS (SELECT DISTINCT domain_code, upper(trim(annotation)) AS typed FROM typed_entries WHERE length(trim(annotation)) >= 3),
h AS (SELECT t.domain_code, typed, var_name, row_number() OVER (PARTITION BY t.domain_code, typed ORDER BY var_name) AS rn FROM t JOIN v USING (domain_code)
 WHERE contains(var_name, substring(typed, 1, 3)) AND NOT EXISTS (SELECT 1 FROM v x WHERE x.domain_code = t.domain_code AND x.var_name = typed))
SELECT domain_code, typed, string_agg(var_name, ',' ORDER BY var_name) AS suggestions FROM h WHERE rn <= 5 GROUP BY ALL"""

QUERIES = {f.__name__: f for f in (
    jn_asof_backward, jn_range_section, jn_neighbours, jn_contains_argmax, jn_equi_chain, jn_exact_then_partial, jn_fuzzy_levenshtein, jn_fuzzy_ratio, fzy_known_ratios, jn_alias_ngrams, jn_inject_missing,
    jn_class_lookup, jn_option_match, jn_page_files, flt_required_members, flt_membership, val_referential, fzy_did_you_mean,
)}

from formloom.plans.parsing import _TAGGED  # noqa: E402

ORACLES = {
    "fzy_known_ratios": "SELECT a, b, CAST(r AS DOUBLE) AS ratio, true AS bounded FROM (VALUES " + ", ".join(str(x) for x in KNOWN_RATIOS) + ") t(a, b, r)",
    "jn_asof_backward": _ASOF,
    "jn_range_section": "SELECT event_id, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS section FROM events",
    "jn_neighbours": _TAGGED + " SELECT doc_id, pos, above, below FROM (SELECT doc_id, pos, tag, last_value(CASE WHEN tag = '<Q>' THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above, first_value(CASE WHEN tag = '<Q>' THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS below FROM items) WHERE tag = '<SH>'",
    "jn_contains_argmax": _TAGGED + r""", i AS (SELECT doc_id, text, min(pos) AS item FROM items WHERE tag = '<INPUT>' AND text <> '' GROUP BY ALL),
tok AS (SELECT doc_id, pos, line, list_distinct(list_filter(regexp_split_to_array(lower(line), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM lines),
p AS (SELECT i.doc_id, item, l.pos, len(list_intersect(list_distinct(list_filter(regexp_split_to_array(lower(i.text), '[^a-z0-9]+'), lambda x: x <> '')), l.w)) AS score FROM i JOIN tok l ON i.doc_id = l.doc_id AND (contains(l.line, i.text) OR contains(i.text, l.line))),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item ORDER BY score DESC, pos) AS rn FROM p WHERE score > 0)
SELECT i.doc_id, i.item, r.pos AS line_pos, CAST(coalesce(r.score, 0) AS BIGINT) AS score FROM i LEFT JOIN r ON i.doc_id = r.doc_id AND i.item = r.item AND rn = 1""",
    "jn_equi_chain": _CHAIN,
    "jn_exact_then_partial": _PARTIAL,
    "jn_fuzzy_levenshtein": _LEV,
    "jn_alias_ngrams": _ALIAS,
    "jn_inject_missing": _INJECT,
    "jn_class_lookup": _CLASS,
    "jn_option_match": _OPTION,
    "jn_page_files": _FILES,
    "flt_required_members": "SELECT domain_code FROM sdtm_variables WHERE substring(var_name, 3) IN ('RSLT', 'TSTC', 'LATY') GROUP BY 1 HAVING count(DISTINCT substring(var_name, 3)) = 3",
    "flt_membership": "SELECT DISTINCT study_id, upper(trim(domain_code)) AS code, upper(trim(domain_code)) IN (SELECT domain_code FROM sdtm_domains) AS known FROM ct_relationships",
    "val_referential": _REFERENTIAL,
    "fzy_did_you_mean": _MEAN,
}
