"""Queries of selection rules, detailed checks and renderings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formloom.catalog import table
from formloom.operators import mapping, parse, retrieve
from formloom.plans.parsing import _TAGGED
from formloom.plans.retrieval import _BM25, _RANK, _index, _terms


def _vars(spark, root):
    return table(spark, root, "sdtm_variables").filter("deleted_at IS NULL").select("domain_code", "var_name", "role", "codelist_code").distinct()


_V = "v AS (SELECT DISTINCT domain_code, var_name, role, codelist_code FROM sdtm_variables WHERE deleted_at IS NULL)"


def sel_variable_rules(spark: SparkSession, root: str) -> DataFrame:
    """SEL13: the variable a pattern takes in each domain, by a
    fixed order of name ends, else the first by name."""
    orders = {"conditional": ["RSLT", "TSTC", "OCCR"], "plain": ["ENDT", "BEGD", "VISN"], "supplemental": ["SPID", "SUBG", "EVLR"]}
    v = _vars(spark, root).select("domain_code", "var_name").distinct()
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("pattern"), F.coalesce(*[F.when(F.expr("substring(var_name, 3)") == s, F.lit(i)) for i, s in enumerate(order)], F.lit(9)).alias("ord")) for p, order in orders.items()]))
    return v.select("domain_code", "var_name", rows.alias("x")).groupBy("domain_code", F.col("x.pattern").alias("pattern")).agg(F.min_by("var_name", F.struct("x.ord", "var_name")).alias("variable"))


_RULES = f"""WITH {_V}, o AS (VALUES ('conditional', 'RSLT', 0), ('conditional', 'TSTC', 1), ('conditional', 'OCCR', 2), ('plain', 'ENDT', 0), ('plain', 'BEGD', 1), ('plain', 'VISN', 2), ('supplemental', 'SPID', 0), ('supplemental', 'SUBG', 1), ('supplemental', 'EVLR', 2)),
p AS (SELECT DISTINCT domain_code, var_name FROM v), x AS (SELECT domain_code, var_name, pat, coalesce((SELECT o.col2 FROM o WHERE o.col0 = pat AND o.col1 = substring(var_name, 3)), 9) AS ord FROM p, (VALUES ('conditional'), ('plain'), ('supplemental')) t(pat))
SELECT domain_code, pat AS pattern, var_name AS variable FROM (SELECT *, row_number() OVER (PARTITION BY domain_code, pat ORDER BY ord, var_name) AS rn FROM x) WHERE rn = 1"""


def sel_term_value(spark: SparkSession, root: str) -> DataFrame:
    """SEL17, JN20: the term a row's first option stands for in the lists of its domain, else the option in
    upper case, else 'Y'."""
    pa = table(spark, root, "page_annotations")
    opt = F.upper(F.trim(F.regexp_extract(F.coalesce("option_annotations", F.lit("")), r"^([A-Za-z ]+):", 1)))
    rows = pa.select("row_id", F.upper(F.trim("domain")).alias("domain_code"), F.nullif(opt, F.lit("")).alias("option"))
    lists = _vars(spark, root).filter("codelist_code IS NOT NULL").select("domain_code", "codelist_code").distinct()
    terms = lists.join(table(spark, root, "ct_terms"), "codelist_code").groupBy("domain_code", F.upper("submission_value").alias("option")).agg(F.min("submission_value").alias("term"))
    return rows.join(terms, ["domain_code", "option"], "left").select("row_id", F.coalesce("term", "option", F.lit("Y")).alias("value"), F.col("term").isNotNull().alias("listed"))


_TERM = f"""WITH {_V}, l AS (SELECT DISTINCT domain_code, codelist_code FROM v WHERE codelist_code IS NOT NULL),
t AS (SELECT domain_code, upper(submission_value) AS o, min(submission_value) AS term FROM l JOIN ct_terms USING (codelist_code) GROUP BY ALL),
r AS (SELECT row_id, upper(trim(domain, ' ')) AS d, nullif(upper(trim(regexp_extract(coalesce(option_annotations, ''), '^([A-Za-z ]+):', 1), ' ')), '') AS o FROM page_annotations)
SELECT row_id, coalesce(term, r.o, 'Y') AS value, term IS NOT NULL AS listed FROM r LEFT JOIN t ON t.domain_code = r.d AND t.o = r.o"""


def sel_rule_override(spark: SparkSession, root: str) -> DataFrame:
    """SEL20, SEL23: newest class of each form by its rows, with the raised confidence."""
    pa = table(spark, root, "page_annotations").filter("form IS NOT NULL AND trim(pattern) <> ''")
    last = pa.groupBy("form").agg(F.max_by("pattern", F.struct("annotated_at", "row_id")).alias("pattern"), F.avg("confidence").alias("p"))
    return last.select("form", "pattern", F.round(F.least(F.lit(0.95), 0.7 + 0.3 * F.col("p")), 6).alias("confidence"))


def flt_separate(spark: SparkSession, root: str) -> DataFrame:
    """FLT15, FLT16: rows whose options need annotations of their own: flagged, or with two options."""
    n = F.size(F.filter(F.split(F.coalesce("option_annotations", F.lit("")), "[;|,\\n]"), lambda x: F.trim(x) != ""))
    pa = table(spark, root, "page_annotations").select("row_id", n.cast("long").alias("n_options"), F.coalesce("requires_separate_annotations", F.lit(False)).alias("flagged"))
    return pa.withColumn("separate", (F.col("n_options") > 0) & (F.col("flagged") | (F.col("n_options") == 2))).filter("n_options > 0")


def win_dedupe_keep_first(spark: SparkSession, root: str) -> DataFrame:
    """WIN10: best document of each source per query in rank order; the source filter comes after the cut."""
    top = retrieve.top_k(retrieve.bm25(_index(spark, root), _terms(spark, root), "query_id"), "query_id", "doc_id", 50)
    j = top.join(table(spark, root, "documents").select("doc_id", "source", "lang"), "doc_id")
    w = Window.partitionBy("query_id", "source").orderBy("rank")
    first = j.withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    return first.filter("lang = 'en'").select("query_id", "source", "doc_id", "rank")


def top_ordered_unique(spark: SparkSession, root: str) -> DataFrame:
    """TOP09, ARR01: codes of a row in order of first mention, with a default list."""
    codes = F.array_distinct(F.regexp_extract_all(F.upper(F.coalesce("domain", F.lit(""))), F.lit("[A-Z0-9]+"), F.lit(0)))
    return table(spark, root, "page_annotations").select("row_id", F.when(F.size(codes) > 0, F.array_join(codes, ",")).otherwise("WD,LZ").alias("codes"))


def jn_nearest_question(spark: SparkSession, root: str) -> DataFrame:
    """JN06, MTH05: cost of the question above each input, by distance in lines; options are cheaper."""
    it = parse.tagged(table(spark, root, "documents"), "doc_id", "text")
    it = parse.running(it, ["doc_id"], ["pos"], F.when(F.col("tag") == "<Q>", F.col("pos")), "question_pos").filter("tag = '<INPUT>'")
    d = F.col("pos") - F.col("question_pos")
    return it.select("doc_id", "pos", "question_pos", F.round(d * F.when((F.col("input_type") == "option") & (d < 3), 0.8).otherwise(1.0), 6).alias("cost"))


def val_findings(spark: SparkSession, root: str) -> DataFrame:
    """VAL08: errors and warnings of variable and codelist pairs: existence, role, terms."""
    ct = table(spark, root, "ct_relationships").select("rel_id", F.upper(F.trim("domain_code")).alias("domain_code"), F.upper(F.trim("variable_name")).alias("var_name"), F.upper(F.trim("codelist_code")).alias("code"))
    v = table(spark, root, "sdtm_variables").groupBy("domain_code", "var_name").agg(F.min("role").alias("role"), F.max("codelist_code").alias("own"))
    c = table(spark, root, "ct_codelists").groupBy(F.col("codelist_code").alias("code")).agg(F.max("extensible").alias("ext"))
    j = ct.join(v, ["domain_code", "var_name"], "left").join(c, "code", "left")
    return j.select(
        "rel_id",
        F.concat_ws(";", F.when(F.col("role").isNull(), "unknown variable"), F.when(F.col("role") == "Identifier", "identifier"), F.when(F.col("code").isNotNull() & F.col("ext").isNull(), "unknown codelist")).alias("errors"),
        F.when((F.col("own") != F.col("code")) & F.col("ext"), "other extensible codelist").otherwise("").alias("warnings"),
    )


_FINDINGS = """WITH c AS (SELECT rel_id, upper(trim(domain_code, ' ')) AS d, upper(trim(variable_name, ' ')) AS v, upper(trim(codelist_code, ' ')) AS c FROM ct_relationships),
v AS (SELECT domain_code, var_name, min(role) AS role, max(codelist_code) AS own FROM sdtm_variables GROUP BY ALL), l AS (SELECT codelist_code, bool_or(extensible) AS ext FROM ct_codelists GROUP BY 1)
SELECT rel_id, concat_ws(';', CASE WHEN role IS NULL THEN 'unknown variable' END, CASE WHEN role = 'Identifier' THEN 'identifier' END, CASE WHEN c IS NOT NULL AND ext IS NULL THEN 'unknown codelist' END) AS errors,
 CASE WHEN own <> c AND ext THEN 'other extensible codelist' ELSE '' END AS warnings FROM c LEFT JOIN v ON v.domain_code = c.d AND v.var_name = c.v LEFT JOIN l ON l.codelist_code = c.c"""


def str_term_listing(spark: SparkSession, root: str) -> DataFrame:
    """MSC03, MSC09: the first ten terms of each codelist as text and how many more there are (the ten are the feature)."""
    t = table(spark, root, "ct_terms")
    r = t.withColumn("_r", F.row_number().over(Window.partitionBy("codelist_code").orderBy("submission_value"))).groupBy("codelist_code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_r") <= 10, F.struct("_r", "submission_value")))), lambda x: x["submission_value"]), ", ").alias("shown"), F.count(F.lit(1)).alias("n"))
    return r.select("codelist_code", F.when(F.col("n") > 10, F.concat("shown", F.lit(" and "), (F.col("n") - 10).cast("string"), F.lit(" more"))).otherwise(F.col("shown")).alias("listing"))


def val_test_codes(spark: SparkSession, root: str) -> DataFrame:
    """MSC07: terms of the codelists that test variables of a domain use."""
    v = _vars(spark, root).filter("codelist_code IS NOT NULL AND (var_name LIKE '%TSTC' OR var_name LIKE '%TSTN')").select("domain_code", "codelist_code").distinct()
    return v.join(table(spark, root, "ct_terms"), "codelist_code").select("domain_code", "codelist_code", "submission_value")


def str_agent_prompt(spark: SparkSession, root: str) -> DataFrame:
    """MSC02, MSC14, TRN07: prompts of questions with up to three guidelines first, then the candidates of their domain."""
    guide = table(spark, root, "sdtm_domains").groupBy("domain_code").agg(F.min_by("definition", "domain_row").alias("guide"))
    cand = _vars(spark, root).groupBy("domain_code").agg(F.array_join(F.slice(F.array_sort(F.collect_set("var_name")), 1, 5), ", ").alias("names"))
    q = table(spark, root, "page_annotations").filter("text IS NOT NULL").select("row_id", "text", F.upper(F.trim("domain")).alias("domain_code"))
    j = q.join(guide, "domain_code", "left").join(cand, "domain_code", "left")
    return j.select("row_id", F.concat_ws("\n", F.concat(F.lit("Guide: "), "guide"), F.concat(F.lit("Candidates: "), "names"), F.concat(F.lit("Question: "), "text")).alias("prompt"))


def mth_clip_mean(spark: SparkSession, root: str) -> DataFrame:
    """MTH01: clipped, extreme and mean confidences of each study's patterns."""
    g = table(spark, root, "page_annotations").groupBy("study_id", mapping.pattern_of(F.col("annotation")).alias("kept"))
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence") * 1.2 - 0.1))
    return g.agg(F.round(F.avg(c), 6).alias("mean"), F.min("confidence").alias("low"), F.max("confidence").alias("high"))


from formloom.plans.mapping import _PATTERN, _STRIPPED  # noqa: E402

QUERIES = {f.__name__: f for f in (
    sel_variable_rules, sel_term_value, sel_rule_override, flt_separate, win_dedupe_keep_first, top_ordered_unique, jn_nearest_question, val_findings, str_term_listing, val_test_codes, str_agent_prompt, mth_clip_mean,
)}

ORACLES = {
    "sel_variable_rules": _RULES,
    "sel_term_value": _TERM,
    "sel_rule_override": "SELECT form, arg_max(pattern, (annotated_at, row_id)) AS pattern, round(least(0.95::DOUBLE, 0.7::DOUBLE + 0.3::DOUBLE * avg(confidence)), 6) AS confidence FROM page_annotations WHERE form IS NOT NULL AND trim(pattern, ' ') <> '' GROUP BY 1",
    "flt_separate": "SELECT *, flagged OR n_options = 2 AS separate FROM (SELECT row_id, CAST(len(list_filter(regexp_split_to_array(coalesce(option_annotations, ''), '[;|,\n]'), lambda x: trim(x, ' ') <> '')) AS BIGINT) AS n_options, coalesce(requires_separate_annotations, false) AS flagged FROM page_annotations) WHERE n_options > 0",
    "win_dedupe_keep_first": _BM25 + ", t50 AS (SELECT * FROM (" + _RANK.format("bm") + ") WHERE rank <= 50), j AS (SELECT query_id, source, doc_id, rank, lang, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS rn FROM t50 JOIN documents USING (doc_id)) SELECT query_id, source, doc_id, rank FROM j WHERE rn = 1 AND lang = 'en'",
    "top_ordered_unique": "WITH c AS (SELECT row_id, unnest(regexp_extract_all(upper(domain), '[A-Z0-9]+')) AS c, unnest(range(1, len(regexp_extract_all(upper(domain), '[A-Z0-9]+')) + 1)) AS o FROM page_annotations), f AS (SELECT row_id, c, min(o) AS o FROM c GROUP BY ALL), g AS (SELECT row_id, string_agg(c, ',' ORDER BY o) AS codes FROM f GROUP BY 1) SELECT row_id, coalesce(codes, 'WD,LZ') AS codes FROM page_annotations LEFT JOIN g USING (row_id)",
    "jn_nearest_question": _TAGGED + ", r AS (SELECT doc_id, pos, tag, input_type, last_value(CASE WHEN tag = '<Q>' THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS question_pos FROM items) SELECT doc_id, pos, question_pos, CAST(round((pos - question_pos) * CASE WHEN input_type = 'option' AND pos - question_pos < 3 THEN 0.8::DOUBLE ELSE 1.0 END, 6) AS DOUBLE) AS cost FROM r WHERE tag = '<INPUT>'",
    "val_findings": _FINDINGS,
    "str_term_listing": "SELECT codelist_code, CASE WHEN n > 10 THEN shown || ' and ' || (n - 10) || ' more' ELSE shown END AS listing FROM (SELECT codelist_code, string_agg(submission_value, ', ' ORDER BY submission_value) FILTER (WHERE rn <= 10) AS shown, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY codelist_code ORDER BY submission_value) AS rn FROM ct_terms) GROUP BY 1)",
    "val_test_codes": f"WITH {_V} SELECT domain_code, codelist_code, submission_value FROM (SELECT DISTINCT domain_code, codelist_code FROM v WHERE codelist_code IS NOT NULL AND (var_name LIKE '%TSTC' OR var_name LIKE '%TSTN')) JOIN ct_terms USING (codelist_code)",
    "str_agent_prompt": f"WITH {_V}, g AS (SELECT domain_code, arg_min(definition, domain_row) AS guide FROM sdtm_domains GROUP BY 1), n AS (SELECT domain_code, array_to_string(list_sort(list(DISTINCT var_name))[1:5], ', ') AS names FROM v GROUP BY 1) SELECT row_id, concat_ws(chr(10), 'Guide: ' || guide, 'Candidates: ' || names, 'Question: ' || text) AS prompt FROM page_annotations p LEFT JOIN g ON g.domain_code = upper(trim(p.domain, ' ')) LEFT JOIN n ON n.domain_code = upper(trim(p.domain, ' ')) WHERE text IS NOT NULL",
    "mth_clip_mean": f"WITH s AS ({_STRIPPED}) SELECT study_id, {_PATTERN} AS kept, round(avg(greatest(0, least(1, confidence * 1.2::DOUBLE - 0.1::DOUBLE))), 6) AS mean, min(confidence) AS low, max(confidence) AS high FROM s GROUP BY ALL",
}
