"""Queries of rule tables: value checks, linking with the question's text, selection, generated codes and wordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.catalog import table
from formloom.functions import text as tx
from formloom.operators import mapping, packed, retrieve
from formloom.plans.mapping import _CODES, _PATTERN
from formloom.plans.shaping import packed_sql

#: Rule catalogue: id, severity, the pattern it is about, what its values must look like, and its wording.
RULES = [
    ("R1", "error", "plain", "^[A-Z]{2}[A-Z0-9]*$", "a variable starts with the two letters of its domain"),
    ("R2", "error", "supplemental", "^[A-Z0-9]{1,8} in SUPP", "a supplemental name has at most eight characters"),
    ("R3", "error", "conditional", " = [A-Z0-9]{1,8}$", "a condition compares with a short code"),
    ("R4", "warning", "with_term", " = [A-Z0-9 ]+$", "a term stands in capitals"),
    ("R5", "warning", "none", "^$", "a value keeps one of the patterns"),
]
#: Ordered gates of a question: name, the text tried, and the expression that opens the gate.
GATES = [
    ("instrument", "text", r"\b(scale|score|questionnaire|index)\b"),
    ("criterion", "text", r"^(inc|exc?)[0-9]+|\b(inclusion|exclusion|criteri)"),
    ("unit", "text", r"\b(mmhg|cm|kg|mg|bpm|units?)\b"),
    ("form", "form", r"adverse|medication|imaging|labs"),
]
#: Order of variable stems a pattern prefers.
PREFERRED = {"plain": ["TERM", "TRTX", "RSLT"], "conditional": ["RSLT", "OCCR"], "supplemental": ["WHYN", "EVLR"], "with_term": ["OCCR", "SEVR"]}


def _values(spark, root):
    """Every value of every annotation with its pattern and parts."""
    rows = table(spark, root, "page_annotations").select("row_id", "domain", F.posexplode(packed.split_packed(F.col("annotation"))).alias("_p", "v"))
    return rows.select(
        "row_id", (F.col("_p") + 1).alias("pos"), "v", mapping.pattern_of(F.col("v")).alias("p"), F.regexp_extract("v", "^([A-Z][A-Z0-9]{1,7})( |$)", 1).alias("var"),
        F.regexp_extract("v", "when ([A-Z0-9]+) = ", 1).alias("cond"), F.regexp_extract("v", " = (.+)$", 1).alias("term"),
    )


_VALUES = f"""WITH s AS (SELECT row_id, generate_subscripts(a, 1) AS pos, unnest(a) AS v FROM (SELECT row_id, {packed_sql("annotation")} AS a FROM page_annotations)),
v AS (SELECT row_id, pos, v, {_PATTERN} AS p, regexp_extract(v, '^([A-Z][A-Z0-9]{{1,7}})( |$)', 1) AS var, regexp_extract(v, 'when ([A-Z0-9]+) = ', 1) AS cond, regexp_extract(v, ' = (.+)$', 1) AS term FROM s)"""


def val_value_checks(spark: SparkSession, root: str) -> DataFrame:
    """VAL03, VAL04, VAL11: each annotation value: pattern kept, variables known, role allowed, term in the
    codelist (a warning where the codelist is extensible)."""
    v = table(spark, root, "sdtm_variables").groupBy(F.col("var_name").alias("var")).agg(F.min("role").alias("role"), F.min("codelist_code").alias("code"), F.lit(True).alias("known"))
    names = v.select(F.col("var").alias("cond"), F.col("known").alias("cond_known"))
    lists = table(spark, root, "ct_codelists").groupBy(F.col("codelist_code").alias("code")).agg(F.max(F.col("extensible").cast("int")).alias("ext"))
    terms = table(spark, root, "ct_terms").select(F.col("codelist_code").alias("code"), F.upper("submission_value").alias("term_key")).distinct().withColumn("listed", F.lit(True))
    j = _values(spark, root).withColumn("term_key", F.upper("term")).join(v, "var", "left").join(names, "cond", "left").join(lists, "code", "left").join(terms, ["code", "term_key"], "left")
    named = F.col("p").isin("plain", "conditional", "with_term")
    off_list = (F.col("p") == "with_term") & F.col("code").isNotNull() & F.col("listed").isNull()
    errors = F.array_compact(F.array(
        F.when(F.col("p") == "none", "no pattern"), F.when(named & F.col("known").isNull(), "unknown variable"), F.when((F.col("p") == "plain") & (F.col("role") == "Identifier"), "identifier"),
        F.when((F.col("p") == "conditional") & F.col("cond_known").isNull(), "unknown condition"), F.when(off_list & (F.coalesce("ext", F.lit(0)) == 0), "term not listed"),
    ))
    return j.select("row_id", "pos", "p", F.array_join(errors, ";").alias("errors"), F.when(off_list & (F.col("ext") == 1), "term extends the list").alias("warning"), (F.size(errors) == 0).alias("valid"))


_CHECKS = _VALUES + """,
d AS (SELECT var_name AS var, min(role) AS role, min(codelist_code) AS code FROM sdtm_variables GROUP BY 1), l AS (SELECT codelist_code AS code, max(extensible::INT) AS ext FROM ct_codelists GROUP BY 1),
t AS (SELECT DISTINCT codelist_code AS code, upper(submission_value) AS term_key FROM ct_terms),
j AS (SELECT v.*, d.var IS NOT NULL AS known, d.role AS role, d.code AS code, c.var IS NOT NULL AS cond_known, ext, t.code IS NOT NULL AS listed FROM v LEFT JOIN d ON v.var = d.var LEFT JOIN d c ON v.cond = c.var LEFT JOIN l ON d.code = l.code LEFT JOIN t ON d.code = t.code AND upper(v.term) = t.term_key),
e AS (SELECT *, list_filter([CASE WHEN p = 'none' THEN 'no pattern' END, CASE WHEN p IN ('plain', 'conditional', 'with_term') AND NOT known THEN 'unknown variable' END, CASE WHEN p = 'plain' AND role = 'Identifier' THEN 'identifier' END,
 CASE WHEN p = 'conditional' AND NOT cond_known THEN 'unknown condition' END, CASE WHEN p = 'with_term' AND code IS NOT NULL AND NOT listed AND coalesce(ext, 0) = 0 THEN 'term not listed' END], lambda x: x IS NOT NULL) AS errs FROM j)
SELECT row_id, pos, p, array_to_string(errs, ';') AS errors, CASE WHEN p = 'with_term' AND code IS NOT NULL AND NOT listed AND ext = 1 THEN 'term extends the list' END AS warning, len(errs) = 0 AS valid FROM e"""


def val_rule_checks(spark: SparkSession, root: str) -> DataFrame:
    """VAL12, VAL13, MSC13: each rule of the catalogue with the values it was held against and those that break it."""
    rules = spark.createDataFrame(RULES, "rule_id string, severity string, p string, must string, wording string")
    hits = _values(spark, root).groupBy("p", "v").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(rules), "p")
    return hits.groupBy("rule_id", "severity", "wording").agg(F.sum("n").alias("n_checked"), F.sum(F.when(~F.expr("v RLIKE must"), F.col("n")).otherwise(0)).alias("n_broken"))


_RULES = _VALUES + f""", r(rule_id, severity, p, must, wording) AS (VALUES {", ".join(str(r) for r in RULES)})
SELECT rule_id, severity, wording, count(*) AS n_checked, count(*) FILTER (WHERE NOT regexp_matches(v, must)) AS n_broken FROM v JOIN r USING (p) GROUP BY ALL"""

_STEM_BONUS = [("date", ["BEGD", "ENDT"], 0.8), ("result", ["RSLT"], 0.7), ("treatment", ["TRTX"], 0.7), ("test", ["TSTC", "TSTN"], 0.3)]
_ROLE_BONUS = [("date", "Timing", 1.0), ("result", "Qualifier", 0.8), ("test", "Topic", 0.5)]
_INTENT = [("reason", ["WHYN"]), ("locat", ["LOCN", "LATY"]), ("who ", ["EVLR"]), ("occur", ["OCCR"])]
_SECTIONS = [(1, "symptom", "AE"), (2, "medication", "CM"), (3, "contact", "DM"), (4, "procedure", "PR")]


def ret_link_question(spark: SparkSession, root: str) -> DataFrame:
    """RET08 to RET14: the best variable of each question's domain: word overlap with the label, codelist and
    options, domain, stem, role, section and unit bonuses read from the question, and intent on top, with
    both sets of weights."""
    v = table(spark, root, "sdtm_variables").filter("deleted_at IS NULL").groupBy("var_name", "domain_code").agg(F.min("label").alias("label"), F.min("role").alias("role"), F.min("codelist_code").alias("code"))
    v = v.select("*", F.expr("substring(var_name, 3)").alias("stem"), F.array_distinct(tx.tokens(F.coalesce("label", F.lit("")), 4)).alias("lw"))
    q = table(spark, root, "page_annotations").filter("text IS NOT NULL").select("row_id", F.lower("text").alias("t"), F.lower(F.coalesce("section", F.lit(""))).alias("sec"), F.col("option_annotations").isNotNull().alias("opts"), F.upper(F.trim("domain")).alias("domain_code"), F.array_distinct(tx.tokens(F.col("text"), 4)).alias("qw"))
    has = lambda w: F.contains("t", F.lit(w))
    suffix, role, intent, section = F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(None).cast("string")
    for w, stems, x in reversed(_STEM_BONUS):
        suffix = F.when(has(w) & F.col("stem").isin(stems), x).otherwise(suffix)
    for w, r, x in reversed(_ROLE_BONUS):
        role = F.when(has(w) & (F.col("role") == r), x).otherwise(role)
    for w, stems in reversed(_INTENT):
        intent = F.when(has(w) & F.col("stem").isin(stems), 0.7).otherwise(intent)
    for _, w, d in reversed(_SECTIONS):
        section = F.when(F.contains("sec", F.lit(w)), d).otherwise(section)
    j = q.join(v, "domain_code").select(
        "row_id", "var_name", (F.size(F.array_intersect("qw", "lw")) / F.greatest(F.size("lw"), F.lit(1))).alias("a"), (F.col("opts") & F.col("code").isNotNull()).cast("double").alias("c"), suffix.alias("s"), role.alias("r"), intent.alias("i"),
        F.when(section == F.col("domain_code"), 0.5).otherwise(0.0).alias("x"), F.when(F.col("t").rlike(r"\b(mmhg|cm|kg|mg|bpm|units?)\b") & (F.col("stem") == "RSUN"), 0.5).otherwise(0.0).alias("u"),
    )
    one = F.round(0.45 * F.col("a") + 0.25 * F.col("c") + 0.20 + 0.10 * F.least(F.lit(1.0), F.col("s") + F.col("r") + F.col("x") + F.col("u")) + F.col("i"), 6)
    two = F.round(0.40 * F.col("a") + 0.25 * F.col("c") + 0.15 + 0.10 * F.col("s") + 0.05 * F.col("r") + 0.05 * F.col("x") + F.col("i"), 6)
    best = j.groupBy("row_id").agg(F.min(F.struct((-one).alias("n"), "var_name", two.alias("other_score"))).alias("b"))
    return best.select("row_id", "b.var_name", (-F.col("b.n")).alias("score"), "b.other_score")


def _case(rows, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {x}" for c, x in rows) + f" ELSE {otherwise} END"


def _stems(ws) -> str:
    return "(" + ", ".join(f"'{w}'" for w in ws) + ")"


_LINKQ = f"""WITH v AS (SELECT var_name, domain_code, min(label) AS label, min(role) AS role, min(codelist_code) AS code, substring(var_name, 3) AS stem FROM sdtm_variables WHERE deleted_at IS NULL GROUP BY 1, 2),
w AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(label, '')), '[^a-z0-9]+'), lambda x: length(x) >= 4)) AS lw FROM v),
q AS (SELECT row_id, lower(text) AS t, lower(coalesce(section, '')) AS sec, option_annotations IS NOT NULL AS opts, upper(trim(domain, ' ')) AS domain_code, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 4)) AS qw FROM page_annotations WHERE text IS NOT NULL),
j AS (SELECT row_id, var_name, len(list_intersect(qw, lw)) / greatest(len(lw), 1)::DOUBLE AS a, CASE WHEN opts AND code IS NOT NULL THEN 1 ELSE 0 END::DOUBLE AS c,
 ({_case([(f"contains(t, '{w}') AND stem IN {_stems(s)}", x) for w, s, x in _STEM_BONUS], "0.0")})::DOUBLE AS s, ({_case([(f"contains(t, '{w}') AND role = '{r}'", x) for w, r, x in _ROLE_BONUS], "0.0")})::DOUBLE AS r,
 ({_case([(f"contains(t, '{w}') AND stem IN {_stems(s)}", 0.7) for w, s in _INTENT], "0.0")})::DOUBLE AS i, (CASE WHEN ({_case([(f"contains(sec, '{w}')", f"'{d}'") for _, w, d in _SECTIONS], "NULL")}) = domain_code THEN 0.5 ELSE 0 END)::DOUBLE AS x,
 (CASE WHEN regexp_matches(t, '\\b(mmhg|cm|kg|mg|bpm|units?)\\b') AND stem = 'RSUN' THEN 0.5 ELSE 0 END)::DOUBLE AS u FROM q JOIN w USING (domain_code)),
k AS (SELECT row_id, var_name, round(0.45::DOUBLE * a + 0.25::DOUBLE * c + 0.20::DOUBLE + 0.10::DOUBLE * least(1.0, s + r + x + u) + i, 6) AS score, round(0.40::DOUBLE * a + 0.25::DOUBLE * c + 0.15::DOUBLE + 0.10::DOUBLE * s + 0.05::DOUBLE * r + 0.05::DOUBLE * x + i, 6) AS other_score FROM j)
SELECT row_id, var_name, score, other_score FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, var_name) AS n FROM k) WHERE n = 1"""

_BODY = ["var_name", "label", "definition"]


def _variable_index(spark, root):
    docs = table(spark, root, "sdtm_variables").select("variable_row", tx.tokens(F.concat_ws(" ", *_BODY), 3).alias("w"))
    return retrieve.TextIndex(docs, "variable_row", F.col("w"))


def _domain_terms(spark, root):
    q = table(spark, root, "sdtm_domains").select(F.col("domain_row").alias("query_id"), tx.tokens(F.concat_ws(" ", "domain_name", "definition"), 3).alias("w"))
    return retrieve.query_terms(q, "query_id", F.col("w"))


def _words_sql(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda x: length(x) >= 3)"


_VINDEX = f"""WITH d AS (SELECT variable_row, {_words_sql("concat_ws(' ', var_name, label, definition)")} AS w FROM sdtm_variables), len AS (SELECT variable_row, len(w) AS dl FROM d), st AS (SELECT count(*) AS n, sum(dl) / count(*) AS adl FROM len),
p AS (SELECT variable_row, term, count(*) AS tf FROM (SELECT variable_row, unnest(w) AS term FROM d) GROUP BY ALL), t AS (SELECT term, count(*) AS df, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf0, n FROM p, st GROUP BY term, n), a AS (SELECT avg(idf0) AS aidf FROM t),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT domain_row AS query_id, unnest({_words_sql("concat_ws(' ', domain_name, definition)")}) AS term FROM sdtm_domains) GROUP BY ALL),
bm AS (SELECT query_id, variable_row, round(sum(qtf * CASE WHEN idf0 < 0 THEN 0.25 * aidf ELSE idf0 END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / adl))), 4) AS score FROM q JOIN t USING (term) JOIN p USING (term) JOIN len USING (variable_row), a, st GROUP BY ALL),
w AS (SELECT term, ln((1.0 + n) / (1 + df)) + 1 AS idf FROM t), dn AS (SELECT variable_row, sqrt(sum(tf * idf * tf * idf)) AS dn FROM p JOIN w USING (term) GROUP BY 1), qn AS (SELECT query_id, sqrt(sum(qtf * idf * qtf * idf)) AS qn FROM q JOIN w USING (term) GROUP BY 1),
tf AS (SELECT query_id, variable_row, round(sum(qtf * idf * tf * idf) / (any_value(dn) * any_value(qn)), 4) AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN dn USING (variable_row) JOIN qn USING (query_id) GROUP BY ALL)"""


def ret_tfidf_variables(spark: SparkSession, root: str) -> DataFrame:
    """RET15, RET16: five best variables of each domain by 0.7 of the TF-IDF cosine and 0.3 of a boost for its own
    variables, doubled for results and cut for identifiers."""
    s = retrieve.tfidf(_variable_index(spark, root), _domain_terms(spark, root), "query_id")
    d = table(spark, root, "sdtm_domains").select(F.col("domain_row").alias("query_id"), F.col("domain_code").alias("own"))
    j = s.join(table(spark, root, "sdtm_variables").select("variable_row", "domain_code", "role"), "variable_row").join(d, "query_id")
    boost = F.when(F.col("own") == F.col("domain_code"), 1.0).otherwise(0.0)
    factor = F.when(F.col("role").isin("Qualifier", "Topic"), 2.0).when(F.col("role") == "Identifier", 0.1).otherwise(1.0)
    return retrieve.top_k(j.select("query_id", "variable_row", F.round((0.7 * F.col("score") + 0.3 * boost) * factor, 6).alias("score")), "query_id", "variable_row", 5)


_TFV = _VINDEX + """, b AS (SELECT query_id, variable_row, round((0.7::DOUBLE * score + 0.3::DOUBLE * CASE WHEN g.domain_code = s.domain_code THEN 1 ELSE 0 END) * CASE WHEN role IN ('Qualifier', 'Topic') THEN 2 WHEN role = 'Identifier' THEN 0.1::DOUBLE ELSE 1 END, 6) AS score
 FROM tf JOIN sdtm_variables s USING (variable_row) JOIN sdtm_domains g ON g.domain_row = query_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, variable_row) AS rank FROM b) WHERE rank <= 5"""


def ret_chunk_mix(spark: SparkSession, root: str) -> DataFrame:
    """RET19, RET20, RET23: half raw BM25, half cosine, lifted where the query names the label or the variable; the
    best row of each variable name, and the five best names."""
    index, q = _variable_index(spark, root), _domain_terms(spark, root)
    both = retrieve.bm25(index, q, "query_id").withColumnRenamed("score", "b").join(retrieve.tfidf(index, q, "query_id").withColumnRenamed("score", "c"), ["query_id", "variable_row"], "full")
    text = table(spark, root, "sdtm_domains").select(F.col("domain_row").alias("query_id"), F.lower(F.concat_ws(" ", "domain_name", "definition")).alias("qt"))
    j = both.join(table(spark, root, "sdtm_variables").select("variable_row", "var_name", F.lower("label").alias("lab")), "variable_row").join(text, "query_id")
    named = F.expr(r"qt RLIKE concat('\\b', lower(var_name), '\\b')")
    score = F.round((0.5 * F.coalesce("b", F.lit(0.0)) + 0.5 * F.coalesce("c", F.lit(0.0))) * F.when(F.contains("qt", "lab"), 1.5).otherwise(1.0) * F.when(named, 1.3).otherwise(1.0), 6)
    best = j.select("query_id", "var_name", "variable_row", score.alias("score")).groupBy("query_id", "var_name").agg(F.max("score").alias("score"))
    return retrieve.top_k(best, "query_id", "var_name", 5)


_MIX = _VINDEX + """, m AS (SELECT query_id, variable_row, coalesce(bm.score, 0) AS b, coalesce(tf.score, 0) AS c FROM bm FULL JOIN tf USING (query_id, variable_row)),
x AS (SELECT query_id, var_name, round((0.5::DOUBLE * b + 0.5::DOUBLE * c) * CASE WHEN contains(lower(concat_ws(' ', g.domain_name, g.definition)), lower(label)) THEN 1.5::DOUBLE ELSE 1 END
 * CASE WHEN regexp_matches(lower(concat_ws(' ', g.domain_name, g.definition)), '\\b' || lower(var_name) || '\\b') THEN 1.3::DOUBLE ELSE 1 END, 6) AS score FROM m JOIN sdtm_variables s USING (variable_row) JOIN sdtm_domains g ON g.domain_row = query_id),
y AS (SELECT query_id, var_name, max(score) AS score FROM x GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, var_name) AS rank FROM y) WHERE rank <= 5"""


def ret_term_codes(spark: SparkSession, root: str) -> DataFrame:
    """RET17, RET18, TOP04: five best terms of each question text that shares a word with them: 1.0 for the code as
    a word, 0.8 for the preferred term, 0.6 for a synonym, 0.3 for each shared word. Texts are scored once each."""
    q = table(spark, root, "page_annotations").filter("text IS NOT NULL").select(F.lower("text").alias("t")).distinct()
    t = table(spark, root, "ct_terms").select("term_id", F.lower("submission_value").alias("code"), F.lower("preferred_term").alias("pref"), F.transform(F.coalesce("synonyms", F.array().cast("array<string>")), F.lower).alias("syn"))
    words = t.select("term_id", F.explode(F.array_distinct(tx.tokens(F.col("pref"), 4))).alias("w"))
    shared = q.select("t", F.explode(F.array_distinct(tx.tokens(F.col("t"), 4))).alias("w")).join(words, "w").groupBy("t", "term_id").agg(F.count(F.lit(1)).alias("n"))
    score = F.when(F.expr("concat(' ', t, ' ') LIKE concat('% ', code, ' %')"), 1.0).otherwise(0.0) + F.when(F.contains("t", "pref"), 0.8).otherwise(0.0) + F.when(F.exists("syn", lambda s: F.contains(F.col("t"), s)), 0.6).otherwise(0.0) + 0.3 * F.col("n")
    return retrieve.top_k(shared.join(t, "term_id").select("t", "term_id", F.round(score, 6).alias("score")), "t", "term_id", 5)


_CODESQ = """WITH q AS (SELECT DISTINCT lower(text) AS t FROM page_annotations WHERE text IS NOT NULL), t AS (SELECT term_id, lower(submission_value) AS code, lower(preferred_term) AS pref, list_transform(coalesce(synonyms, []), lambda x: lower(x)) AS syn FROM ct_terms),
w AS (SELECT DISTINCT term_id, unnest(list_filter(regexp_split_to_array(pref, '[^a-z0-9]+'), lambda x: length(x) >= 4)) AS w FROM t), qw AS (SELECT DISTINCT t, unnest(list_filter(regexp_split_to_array(t, '[^a-z0-9]+'), lambda x: length(x) >= 4)) AS w FROM q),
n AS (SELECT t, term_id, count(*) AS n FROM qw JOIN w USING (w) GROUP BY ALL),
s AS (SELECT n.t, term_id, round(CASE WHEN contains(' ' || n.t || ' ', ' ' || code || ' ') THEN 1 ELSE 0 END + CASE WHEN contains(n.t, pref) THEN 0.8::DOUBLE ELSE 0 END + CASE WHEN len(list_filter(syn, lambda x: contains(n.t, x))) > 0 THEN 0.6::DOUBLE ELSE 0 END + 0.3::DOUBLE * n, 6) AS score FROM n JOIN t USING (term_id))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY score DESC, term_id) AS rank FROM s) WHERE rank <= 5"""


def sel_confidences(spark: SparkSession, root: str) -> DataFrame:
    """SEL01, SEL02, SEL03, SEL22: mean of three parts, weighted sum, least of four, and the checked confidence,
    raised where the annotation keeps a pattern (at most 0.9) and lowered where it does not."""
    p = mapping.pattern_of(F.col("annotation"))
    rows = table(spark, root, "page_annotations").filter("trim(annotation) <> ''").select("row_id", F.when(p == "none", 0.5).otherwise(0.9).alias("a"), F.when(F.trim("domain") != "", 0.95).otherwise(0.3).alias("d"), F.coalesce("confidence", F.lit(0.0)).alias("v"), F.when(F.col("valid"), 1.0).otherwise(0.6).alias("k"), (p != "none").alias("fine"))
    return rows.select("row_id", F.round((F.col("a") + F.col("d") + F.col("v")) / 3, 6).alias("mean_of_three"), F.round(0.25 * F.col("a") + 0.45 * F.col("d") + 0.30 * F.col("v"), 6).alias("weighted"), F.round(F.least("a", "d", "v", "k"), 6).alias("least_of_four"), F.round(F.when(F.col("fine"), F.greatest(F.col("v"), F.least(F.col("v") + 0.1, F.lit(0.9)))).otherwise(F.col("v") * 0.8), 6).alias("checked"))


_CONFS = f"""WITH s AS (SELECT *, regexp_replace(annotation, '^\\s+|\\s+$', '', 'g') AS v FROM page_annotations), r AS (SELECT row_id, {_PATTERN} AS p, domain, confidence, valid, annotation FROM s),
x AS (SELECT row_id, CASE WHEN p = 'none' THEN 0.5 ELSE 0.9 END::DOUBLE AS a, CASE WHEN trim(domain, ' ') <> '' THEN 0.95 ELSE 0.3 END::DOUBLE AS d, coalesce(confidence, 0)::DOUBLE AS v, CASE WHEN valid THEN 1.0 ELSE 0.6 END::DOUBLE AS k, p <> 'none' AS fine FROM r WHERE trim(annotation, ' ') <> '')
SELECT row_id, round((a + d + v) / 3, 6) AS mean_of_three, round(0.25::DOUBLE * a + 0.45::DOUBLE * d + 0.30::DOUBLE * v, 6) AS weighted, round(least(a, d, v, k), 6) AS least_of_four, round(CASE WHEN fine THEN greatest(v, least(v + 0.1::DOUBLE, 0.9::DOUBLE)) ELSE v * 0.8::DOUBLE END, 6) AS checked FROM x"""


def sel_gates(spark: SparkSession, root: str) -> DataFrame:
    """SEL07: the first gate of the ordered rule table that opens for a question, null for none."""
    out = F.lit(None).cast("string")
    for name, col, rule in reversed(GATES):
        out = F.when(F.lower(F.coalesce(col, F.lit(""))).rlike(rule), name).otherwise(out)
    return table(spark, root, "page_annotations").select("row_id", out.alias("gate"))


_GATES = "SELECT row_id, " + _case([(f"regexp_matches(lower(coalesce({c}, '')), '{r}')", f"'{n}'") for n, c, r in GATES], "NULL") + " AS gate FROM page_annotations"


def sel_build_annotation(spark: SparkSession, root: str) -> DataFrame:
    """SEL13 to SEL16, SEL21: the variable a row's pattern prefers among those of its domain, and the annotation
    built of it. Without a preferred stem the first name is taken."""
    v = table(spark, root, "sdtm_variables").filter("deleted_at IS NULL").groupBy("domain_code").agg(F.array_sort(F.collect_set("var_name")).alias("names"))
    q = table(spark, root, "page_annotations").select("row_id", "text", F.upper(F.trim("domain")).alias("domain_code"), mapping.pattern_of(F.col("annotation")).alias("p")).filter(F.col("p").isin(list(PREFERRED)))
    wish = F.create_map(*[x for p, stems in PREFERRED.items() for x in (F.lit(p), F.array(*[F.lit(s) for s in stems]))])[F.col("p")]
    found = F.filter(F.transform(wish, lambda s: F.get(F.filter("names", lambda n: F.substring(n, F.lit(3), F.length(n)) == s), F.lit(0))), lambda x: x.isNotNull())
    j = q.join(v, "domain_code").withColumn("variable", F.coalesce(F.get(found, F.lit(0)), F.get("names", F.lit(0))))
    built = mapping.render(F.col("p"), F.col("variable"), F.concat("domain_code", F.lit("TSTC")), mapping.short_code(F.coalesce("text", F.lit(""))), F.col("domain_code"))
    return j.select("row_id", "p", "variable", built.alias("built"))


_SHORT = _CODES[_CODES.index("CASE WHEN len(w) = 0") : _CODES.index(" AS short")]
_STOP_SQL = ", ".join(f"'{w}'" for w in mapping.STOP)
_BUILD = f"""WITH n AS (SELECT domain_code, list_sort(list_distinct(list(var_name))) AS names FROM sdtm_variables WHERE deleted_at IS NULL GROUP BY 1),
s AS (SELECT row_id, text, upper(trim(domain, ' ')) AS domain_code, regexp_replace(annotation, '^\\s+|\\s+$', '', 'g') AS v FROM page_annotations), q AS (SELECT *, {_PATTERN} AS p FROM s),
j AS (SELECT row_id, p, domain_code, names, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '' AND x NOT IN ({_STOP_SQL})) AS w,
 {_case([(f"p = '{p}'", "[" + ", ".join(f"'{x}'" for x in s) + "]") for p, s in PREFERRED.items()], "NULL")} AS wish FROM q JOIN n USING (domain_code) WHERE p IN {_stems(PREFERRED)}),
c AS (SELECT *, coalesce(list_filter(list_transform(wish, lambda s: list_filter(names, lambda x: substring(x, 3) = s)[1]), lambda y: y IS NOT NULL)[1], names[1]) AS variable, {_SHORT} AS code FROM j)
SELECT row_id, p, variable, CASE p WHEN 'conditional' THEN variable || ' when ' || domain_code || 'TSTC = ' || code WHEN 'supplemental' THEN variable || ' in SUPP' || domain_code WHEN 'with_term' THEN variable || ' = ' || code ELSE variable END AS built FROM c"""


def sel_domain_fallback(spark: SparkSession, root: str) -> DataFrame:
    """SEL19: variables of each domain, from the studies' relationships for domains the dictionary does not have."""
    own = table(spark, root, "sdtm_variables").select("domain_code", "var_name", F.lit("dictionary").alias("source")).distinct()
    other = table(spark, root, "ct_relationships").select(F.upper(F.trim("domain_code")).alias("domain_code"), F.upper(F.trim("variable_name")).alias("var_name"), F.lit("studies").alias("source")).filter("domain_code <> '' AND var_name <> ''").distinct()
    return own.unionByName(other.join(own.select("domain_code").distinct(), "domain_code", "left_anti"))


_FALLBACK = """WITH o AS (SELECT DISTINCT domain_code, var_name, 'dictionary' AS source FROM sdtm_variables)
SELECT * FROM o UNION ALL SELECT DISTINCT upper(trim(domain_code, ' ')), upper(trim(variable_name, ' ')), 'studies' FROM ct_relationships
WHERE trim(domain_code, ' ') <> '' AND trim(variable_name, ' ') <> '' AND upper(trim(domain_code, ' ')) NOT IN (SELECT domain_code FROM o WHERE domain_code IS NOT NULL)"""


def str_qnam(spark: SparkSession, root: str) -> DataFrame:
    """STR06: four codes of a label: two words cut, initials, letters in a row, and first letter with consonants."""
    up = F.upper(F.coalesce("label", F.lit("")))
    run = F.substring(F.regexp_replace(up, "[^A-Z0-9]", ""), 1, 8)
    thin = F.substring(F.concat(F.substring(F.regexp_replace(up, "[^A-Z0-9]", ""), 1, 1), F.regexp_replace(F.expr("substring(regexp_replace(upper(coalesce(label, '')), '[^A-Z0-9]', ''), 2)"), "[AEIOU]", "")), 1, 8)
    return table(spark, root, "sdtm_variables").select("variable_row", mapping.short_code(F.col("label")).alias("cut"), mapping.initials_code(F.col("label")).alias("initials"), run.alias("run"), thin.alias("thin"))


_QNAM = _CODES[: _CODES.index("SELECT variable_row, CASE")].replace("SELECT variable_row, var_name,", "SELECT variable_row, label, var_name,") + f"""SELECT variable_row, {_SHORT} AS cut, CASE WHEN s = '' THEN 'MISCOTH' WHEN length(s) < 3 THEN s || 'OTH' ELSE s END AS initials,
 substring(regexp_replace(upper(coalesce(label, '')), '[^A-Z0-9]', '', 'g'), 1, 8) AS run, substring(substring(regexp_replace(upper(coalesce(label, '')), '[^A-Z0-9]', '', 'g'), 1, 1) || regexp_replace(substring(regexp_replace(upper(coalesce(label, '')), '[^A-Z0-9]', '', 'g'), 2), '[AEIOU]', '', 'g'), 1, 8) AS thin FROM i"""


def agg_word_index(spark: SparkSession, root: str) -> DataFrame:
    """STR04: inverted index over words between blanks: documents and occurrences of every word, whatever its count."""
    w = table(spark, root, "documents").select("doc_id", F.explode(F.split(F.lower("text"), r"\s+")).alias("term")).filter("term <> ''")
    p = w.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("tf").alias("n_occurrences"))


_WORDIDX = r"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS n_docs, count(*) AS n_occurrences FROM w WHERE term <> '' GROUP BY 1"""


def flt_has_codelist(spark: SparkSession, root: str) -> DataFrame:
    """FLT10, FLT11: whether a variable has a codelist: of its own, by the studies, or by its stem."""
    v = table(spark, root, "sdtm_variables").groupBy("var_name", "domain_code").agg(F.max(F.col("codelist_code").isNotNull()).alias("own"))
    u = table(spark, root, "ct_relationships").filter("codelist_code IS NOT NULL").select(F.upper(F.trim("variable_name")).alias("var_name"), F.upper(F.trim("domain_code")).alias("domain_code"), F.lit(True).alias("used")).distinct()
    stem = F.expr("substring(var_name, 3)").isin("OCCR", "SEVR")
    return v.join(u, ["var_name", "domain_code"], "left").select("var_name", "domain_code", "own", F.coalesce("used", F.lit(False)).alias("by_studies"), stem.alias("by_stem"), (F.col("own") | F.coalesce("used", F.lit(False)) | stem).alias("has_codelist"))


_HASCT = """WITH v AS (SELECT var_name, domain_code, bool_or(codelist_code IS NOT NULL) AS own, substring(var_name, 3) IN ('OCCR', 'SEVR') AS by_stem FROM sdtm_variables GROUP BY ALL),
u AS (SELECT DISTINCT upper(trim(variable_name, ' ')) AS var_name, upper(trim(domain_code, ' ')) AS domain_code FROM ct_relationships WHERE codelist_code IS NOT NULL)
SELECT v.var_name, v.domain_code, own, u.var_name IS NOT NULL AS by_studies, by_stem, own OR u.var_name IS NOT NULL OR by_stem AS has_codelist FROM v LEFT JOIN u ON v.var_name = u.var_name AND v.domain_code = u.domain_code"""


def kbb_wordings(spark: SparkSession, root: str) -> DataFrame:
    """KBB06: wordings of each variable: its label, the label without a last 'Date', its words in lower case; each once."""
    lab = F.trim("label")
    ws = F.array_distinct(F.array_compact(F.array(lab, F.regexp_replace(lab, " Date$", ""), F.lower(lab), F.array_join(tx.tokens(lab, 3), " "))))
    return table(spark, root, "sdtm_variables").filter("label IS NOT NULL").select("var_name", "domain_code", F.explode(ws).alias("wording")).distinct()


_WORDINGS = """SELECT DISTINCT var_name, domain_code, unnest([trim(label, ' '), regexp_replace(trim(label, ' '), ' Date$', ''), lower(trim(label, ' ')), array_to_string(list_filter(regexp_split_to_array(lower(trim(label, ' ')), '[^a-z0-9]+'), lambda x: length(x) >= 3), ' ')]) AS wording FROM sdtm_variables WHERE label IS NOT NULL"""


def kbb_when_patterns(spark: SparkSession, root: str) -> DataFrame:
    """KBB07: when-patterns of result variables, one for each term of each coded variable of their domain."""
    v = table(spark, root, "sdtm_variables").filter("deleted_at IS NULL")
    res = v.filter("substring(var_name, 3) = 'RSLT'").select("domain_code", "var_name").distinct()
    coded = v.filter("codelist_code IS NOT NULL").select("domain_code", F.col("var_name").alias("test"), "codelist_code").distinct()
    terms = table(spark, root, "ct_terms").select("codelist_code", "submission_value").distinct()
    j = res.join(coded, "domain_code").join(terms, "codelist_code")
    return j.select("domain_code", F.concat("var_name", F.lit(" when "), "test", F.lit(" = "), "submission_value").alias("rule")).distinct()


_WHEN = """WITH v AS (SELECT DISTINCT domain_code, var_name, codelist_code FROM sdtm_variables WHERE deleted_at IS NULL)
SELECT DISTINCT r.domain_code, r.var_name || ' when ' || t.var_name || ' = ' || submission_value AS rule FROM v r JOIN v t USING (domain_code) JOIN ct_terms c ON c.codelist_code = t.codelist_code WHERE substring(r.var_name, 3) = 'RSLT'"""


def kbb_entry_index(spark: SparkSession, root: str) -> DataFrame:
    """KBB09, SRC11: index of alias words and of domains to the variables they lead to."""
    v = table(spark, root, "sdtm_variables").select("var_name", "domain_code", "label")
    alias = v.select(F.lit("alias").alias("kind"), F.explode(tx.tokens(F.col("label"), 3)).alias("key"), "var_name")
    dom = v.select(F.lit("domain").alias("kind"), F.col("domain_code").alias("key"), "var_name").filter("key IS NOT NULL")
    return alias.unionByName(dom).groupBy("kind", "key").agg(F.array_join(F.array_sort(F.collect_set("var_name")), ",").alias("variables"))


_ENTRY = f"""WITH a AS (SELECT 'alias' AS kind, unnest({_words_sql("label")}) AS key, var_name FROM sdtm_variables UNION ALL SELECT 'domain', domain_code, var_name FROM sdtm_variables WHERE domain_code IS NOT NULL)
SELECT kind, key, array_to_string(list_sort(list_distinct(list(var_name))), ',') AS variables FROM a GROUP BY ALL"""


def lk_facade(spark: SparkSession, root: str) -> DataFrame:
    """VAL09, KBB11 to KBB13, MSC15: what the lookups give for each live domain: class, variables by role, codelists,
    and the variables whose label speaks of a date."""
    v = table(spark, root, "sdtm_variables").filter("deleted_at IS NULL")
    s = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    by = v.groupBy("domain_code").agg(F.countDistinct("var_name").alias("n_variables"), s(F.when(F.col("role") == "Topic", F.col("var_name"))).alias("topics"), s(F.when(F.col("role") == "Timing", F.col("var_name"))).alias("timing"), s("codelist_code").alias("codelists"), s(F.when(F.lower("label").contains("date"), F.col("var_name"))).alias("dates"))
    d = table(spark, root, "sdtm_domains").filter("deleted_at IS NULL").groupBy("domain_code").agg(F.min("domain_class").alias("domain_class"), F.min("domain_name").alias("domain_name"))
    return d.join(by, "domain_code", "left")


_S = "coalesce(array_to_string(list_sort(list_distinct(list({0}) FILTER (WHERE {0} IS NOT NULL{1}))), ','), '')"
_FACADE = f"""WITH b AS (SELECT domain_code, count(DISTINCT var_name) AS n_variables, {_S.format("var_name", " AND role = 'Topic'")} AS topics, {_S.format("var_name", " AND role = 'Timing'")} AS timing, {_S.format("codelist_code", "")} AS codelists, {_S.format("var_name", " AND contains(lower(label), 'date')")} AS dates FROM sdtm_variables WHERE deleted_at IS NULL GROUP BY 1),
d AS (SELECT domain_code, min(domain_class) AS domain_class, min(domain_name) AS domain_name FROM sdtm_domains WHERE deleted_at IS NULL GROUP BY 1) SELECT * FROM d LEFT JOIN b USING (domain_code)"""

QUERIES = {f.__name__: f for f in (val_value_checks, val_rule_checks, ret_link_question, ret_tfidf_variables, ret_chunk_mix, ret_term_codes, sel_confidences, sel_gates, sel_build_annotation, sel_domain_fallback, str_qnam, agg_word_index, flt_has_codelist, kbb_wordings, kbb_when_patterns, kbb_entry_index, lk_facade)}

ORACLES = {
    "val_value_checks": _CHECKS, "val_rule_checks": _RULES, "ret_link_question": _LINKQ, "ret_tfidf_variables": _TFV, "ret_chunk_mix": _MIX, "ret_term_codes": _CODESQ, "sel_confidences": _CONFS, "sel_gates": _GATES,
    "sel_build_annotation": _BUILD, "sel_domain_fallback": _FALLBACK, "str_qnam": _QNAM, "agg_word_index": _WORDIDX, "flt_has_codelist": _HASCT, "kbb_wordings": _WORDINGS, "kbb_when_patterns": _WHEN, "kbb_entry_index": _ENTRY, "lk_facade": _FACADE,
}
