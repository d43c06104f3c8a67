"""Queries of annotation texts, validation, rendering and training corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formloom.catalog import table
from formloom.functions import text as tx
from formloom.operators import corpus, mapping

_N = "[A-Z][A-Z0-9]{1,7}"
_PATTERN = rf"""CASE WHEN v <> '' THEN CASE WHEN regexp_matches(v, '^\[NOT SUBMITTED\]$') THEN 'not_submitted' WHEN regexp_matches(v, '^{_N} in SUPP[A-Z]{{2}}$') THEN 'supplemental'
 WHEN regexp_matches(v, '^{_N} when {_N} = [A-Z0-9]+$') THEN 'conditional' WHEN regexp_matches(v, '^{_N} = .+$') THEN 'with_term' WHEN regexp_matches(v, '^{_N}$') THEN 'plain' ELSE 'none' END END"""
_STRIPPED = r"SELECT row_id, study_id, domain, pattern, text, form, annotation, option_annotations, confidence, regexp_replace(annotation, '^\s+|\s+$', '', 'g') AS v FROM page_annotations"


def _pa(spark, root):
    return table(spark, root, "page_annotations")


def val_grammar(spark: SparkSession, root: str) -> DataFrame:
    """VAL01, VAL02, VAL05, VAL06, VAL10: the grammar rule of each annotation and its errors."""
    return _pa(spark, root).select("row_id", mapping.pattern_of(F.col("annotation")).alias("pattern"), mapping.grammar_errors(None, "annotation", "domain").alias("errors")).filter("pattern IS NOT NULL")


_GRAMMAR = f"""WITH s AS ({_STRIPPED}), p AS (SELECT *, {_PATTERN} AS p FROM s)
SELECT row_id, p AS pattern, concat_ws(';', CASE WHEN p = 'none' THEN 'no pattern' END,
 CASE WHEN p = 'supplemental' AND NOT contains(upper(coalesce(domain, '')), regexp_extract(v, ' in SUPP([A-Z]{{2}})$', 1)) THEN 'domain of supplement differs' END,
 CASE WHEN length(regexp_extract(v, '^(\\S+) in SUPP', 1)) > 8 THEN 'name longer than eight' END,
 CASE WHEN p = 'conditional' AND substring(regexp_extract(v, 'when (\\S+)', 1), 1, 2) <> substring(v, 1, 2) THEN 'condition of another domain' END) AS errors FROM p WHERE p IS NOT NULL"""


def val_conformance(spark: SparkSession, root: str) -> DataFrame:
    """VAL10, AGG05: how many annotations of each study keep each rule."""
    return _pa(spark, root).groupBy("study_id", mapping.pattern_of(F.col("annotation")).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def val_companions(spark: SparkSession, root: str) -> DataFrame:
    """VAL07, VAL14: domains in which a result stands without its test code or unit."""
    v = table(spark, root, "sdtm_variables").groupBy("domain_code").agg(F.collect_set(F.expr("substring(var_name, 3)")).alias("s"))
    has = lambda x: F.array_contains("s", x)
    return v.select("domain_code", F.concat_ws(",", F.when(has("RSLT") & ~has("RSUN"), "unit"), F.when(has("RSLT") & ~has("TSTC"), "test code"), F.when(has("BEGD") & ~has("ENDT"), "end date")).alias("missing")).filter("missing <> ''")


_COMPANIONS = """WITH v AS (SELECT domain_code, list(DISTINCT substring(var_name, 3)) AS s FROM sdtm_variables GROUP BY 1)
SELECT * FROM (SELECT domain_code, concat_ws(',', CASE WHEN list_contains(s, 'RSLT') AND NOT list_contains(s, 'RSUN') THEN 'unit' END, CASE WHEN list_contains(s, 'RSLT') AND NOT list_contains(s, 'TSTC') THEN 'test code' END,
 CASE WHEN list_contains(s, 'BEGD') AND NOT list_contains(s, 'ENDT') THEN 'end date' END) AS missing FROM v) WHERE missing <> ''"""


def val_from_json(spark: SparkSession, root: str) -> DataFrame:
    """VAL15, STR17: pattern objects in JSON rendered as annotation texts."""
    v = mapping.pattern_of(F.col("annotation"))
    src = _pa(spark, root).select("row_id", "annotation", v.alias("p")).filter("p IN ('conditional', 'supplemental', 'plain')")
    j = F.to_json(F.struct(F.col("p").alias("pattern"), F.regexp_extract("annotation", r"^\s*(\S+)", 1).alias("variable"), F.regexp_extract("annotation", r"when (\S+)", 1).alias("condition"), F.regexp_extract("annotation", r"= (\S+)", 1).alias("value"), F.regexp_extract("annotation", r"SUPP(\S+)", 1).alias("domain")))
    o = src.select("row_id", F.from_json(j, "pattern string, variable string, condition string, value string, domain string").alias("o"))
    return o.select("row_id", mapping.render(F.col("o.pattern"), F.col("o.variable"), F.col("o.condition"), F.col("o.value"), F.col("o.domain")).alias("annotation"))


def sel_gate_shape(spark: SparkSession, root: str) -> DataFrame:
    """SEL08: shape of the value each question asks for."""
    return _pa(spark, root).select("row_id", mapping.value_shape(F.col("text"), F.col("option_annotations")).alias("shape"))


_SHAPE = r"""WITH s AS (SELECT row_id, lower(coalesce(text, '')) AS t, lower(coalesce(option_annotations, '')) AS o FROM page_annotations)
SELECT row_id, CASE WHEN regexp_matches(t, '\b(mmhg|cm|kg|mg|bpm|units?)\b') THEN 'NUM_UNIT' WHEN regexp_matches(t, '\b(date|time)\b') THEN 'DATE' WHEN contains(o, 'yes') AND regexp_matches(o, '\bno\b') THEN 'YN'
 WHEN contains(o, 'mild') AND contains(o, 'severe') THEN 'ORDINAL' WHEN regexp_matches(t, '\b(number|rate|score|how many)\b') THEN 'NUMERIC' ELSE 'TEXT' END AS shape FROM s"""


def sel_pattern_cascade(spark: SparkSession, root: str) -> DataFrame:
    """SEL09, SEL10, TRN03: one pattern of each row by priority, beside the pattern its text keeps."""
    return _pa(spark, root).select("row_id", corpus.canonical_pattern(F.col("pattern")).alias("named"), mapping.pattern_of(F.col("annotation")).alias("kept"))


_CANON = """CASE WHEN len(w) = 0 OR w IS NULL THEN NULL WHEN len(w) = 1 AND w[1] = 'direct' THEN 'plain' WHEN len(list_filter(w, lambda x: starts_with(x, 'findings'))) > 0 THEN 'findings' WHEN len(list_filter(w, lambda x: starts_with(x, 'conditional'))) > 0 THEN 'conditional'
 WHEN len(list_filter(w, lambda x: starts_with(x, 'supplemental'))) > 0 THEN 'supplemental' WHEN len(list_filter(w, lambda x: starts_with(x, 'direct'))) > 0 THEN 'direct' WHEN len(list_filter(w, lambda x: starts_with(x, 'plain'))) > 0 THEN 'plain' ELSE w[1] END"""
_WORDS = "list_filter(list_transform(string_split(lower(pattern), ','), lambda x: regexp_replace(trim(x, ' '), '_single$', '')), lambda x: x <> '')"


def sel_confidence(spark: SparkSession, root: str) -> DataFrame:
    """FLT05: confidence from three parts and the reason to abstain."""
    kept = mapping.pattern_of(F.col("annotation"))
    parts = [F.when(kept == "none", 0.5).otherwise(0.9), F.coalesce("confidence", F.lit(0.0)), F.when(F.trim("domain") != "", 0.95).otherwise(0.3)]
    conf, why = mapping.settle(parts, 0.5, 0.7)
    return _pa(spark, root).filter("trim(annotation) <> ''").select("row_id", conf.alias("confidence"), why.alias("abstain_reason"))


_CONF = f"""WITH s AS ({_STRIPPED}), p AS (SELECT row_id, CAST(CASE WHEN {_PATTERN} = 'none' THEN 0.5 ELSE 0.9 END AS DOUBLE) AS a, coalesce(confidence, 0) AS b, CAST(CASE WHEN trim(domain, ' ') <> '' THEN 0.95 ELSE 0.3 END AS DOUBLE) AS c FROM s WHERE trim(annotation, ' ') <> '')
SELECT row_id, round(least(a, b, c), 6) AS confidence, CASE WHEN least(a, b, c) < 0.5 THEN 'low confidence' WHEN a < 0.7 THEN 'pattern unsure' END AS abstain_reason FROM p"""


def sel_multi_variable(spark: SparkSession, root: str) -> DataFrame:
    """SEL11: companion variables of each result variable that exist in its domain."""
    v = table(spark, root, "sdtm_variables").select("domain_code", "var_name").distinct()
    need = v.filter("var_name LIKE '%RSLT'").select("domain_code", F.col("var_name").alias("result"), F.explode(F.transform(F.array(F.lit("RSUN"), F.lit("TSTC"), F.lit("TSTN"), F.lit("LATY")), lambda s: F.concat(F.col("domain_code"), s))).alias("var_name"))
    return need.join(v, ["domain_code", "var_name"]).groupBy("domain_code", "result").agg(F.array_join(F.array_sort(F.collect_list("var_name")), " / ").alias("companions"))


def sel_option_annotations(spark: SparkSession, root: str) -> DataFrame:
    """SEL18: question and options as one combined text."""
    q = _pa(spark, root).filter("question_annotation IS NOT NULL OR option_annotations IS NOT NULL")
    return q.select("row_id", F.concat_ws(" | ", F.concat(F.lit("Question: "), "question_annotation"), F.concat(F.lit("Options: "), "option_annotations")).alias("combined"))


def str_codes(spark: SparkSession, root: str) -> DataFrame:
    """STR05, STR07, STR08: generated codes of labels."""
    return table(spark, root, "sdtm_variables").select("variable_row", mapping.short_code(F.col("label")).alias("short"), mapping.initials_code(F.col("label")).alias("initials"), F.when(F.length("var_name") > 5, F.concat(F.substring("var_name", 1, 5), F.lit("OTH"))).otherwise(F.concat("var_name", F.lit("OTH"))).alias("other"))


_STOPS = ", ".join(f"'{w}'" for w in mapping.STOP)
_CODES = f"""WITH w AS (SELECT variable_row, var_name, list_filter(regexp_split_to_array(lower(label), '[^a-z0-9]+'), lambda x: x <> '' AND x NOT IN ({_STOPS})) AS w FROM sdtm_variables),
i AS (SELECT *, upper(array_to_string(list_transform(w[1:4], lambda x: substring(x, 1, 1)), '')) AS s FROM w)
SELECT variable_row, CASE WHEN len(w) = 0 THEN 'MISCOTH' ELSE upper(array_to_string(list_transform(w[1:2], lambda x: substring(x, 1, 4)), '')) END AS short,
 CASE WHEN s = '' THEN 'MISCOTH' WHEN length(s) < 3 THEN s || 'OTH' ELSE s END AS initials, CASE WHEN length(var_name) > 5 THEN substring(var_name, 1, 5) || 'OTH' ELSE var_name || 'OTH' END AS other FROM i"""


def str_query_builder(spark: SparkSession, root: str) -> DataFrame:
    """STR09, STR15, STR16: query texts of questions with abbreviations written out."""
    q = F.replace(F.replace(F.col("text"), F.lit("AE"), F.lit("adverse event")), F.lit("BP"), F.lit("blood pressure"))
    return _pa(spark, root).filter("text IS NOT NULL").select("row_id", F.concat_ws("\n", F.concat(F.lit("Q: "), q), F.concat(F.lit("Options: "), "option_annotations"), F.concat(F.lit("Section: "), "section"), F.concat(F.lit("Form: "), "form")).alias("query"))


def str_embedding_text(spark: SparkSession, root: str) -> DataFrame:
    """STR12, STR13, RET01: texts to embed of variables and terms."""
    v = table(spark, root, "sdtm_variables").select(F.concat(F.lit("v"), F.col("variable_row").cast("string")).alias("id"), F.concat_ws(". ", F.concat_ws(" ", "var_name", "label"), F.concat(F.lit("Domain "), "domain_code"), "definition", F.concat(F.lit("Codelist "), "codelist_name")).alias("body"))
    t = table(spark, root, "ct_terms").select(F.concat(F.lit("t"), F.col("term_id").cast("string")).alias("id"), F.concat_ws(". ", "submission_value", "preferred_term", F.array_join("synonyms", "; "), "codelist_name").alias("body"))
    return v.unionByName(t)


def str_cache_key(spark: SparkSession, root: str) -> DataFrame:
    """STR14, HSH01, ARR01: memo keys of fields; one representative each, joined back."""
    key = F.substring(F.sha1(F.lower(F.concat_ws("|", F.coalesce("form", F.lit("")), F.coalesce("section", F.lit("")), F.coalesce("text", F.lit(""))))), 1, 12)
    k = _pa(spark, root).select("row_id", key.alias("key"))
    memo = k.groupBy("key").agg(F.min("row_id").alias("first_row"), F.count(F.lit(1)).alias("n"))
    return k.join(memo, "key")


def top_additive_keyword(spark: SparkSession, root: str) -> DataFrame:
    """TOP04: domains by an additive score of a question's words, the three best (a top-k report)."""
    q = _pa(spark, root).filter("text IS NOT NULL").select("row_id", F.explode(F.array_distinct(tx.tokens(F.col("text"), 4))).alias("w"))
    v = table(spark, root, "sdtm_domains").select("domain_code", F.explode(F.array_distinct(tx.tokens(F.col("domain_name"), 4))).alias("w")).distinct()
    s = q.join(v, "w").groupBy("row_id", "domain_code").agg(F.round(F.sum(F.lit(0.3) + F.length("w") / 100.0), 6).alias("score"))
    w = Window.partitionBy("row_id").orderBy(F.desc("score"), "domain_code")
    return s.withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 3")


_ADDITIVE = """WITH q AS (SELECT DISTINCT row_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 4)) AS w FROM page_annotations WHERE text IS NOT NULL),
v AS (SELECT DISTINCT domain_code, unnest(list_filter(regexp_split_to_array(lower(domain_name), '[^a-z0-9]+'), lambda x: length(x) >= 4)) AS w FROM sdtm_domains),
s AS (SELECT row_id, domain_code, round(sum(0.3::DOUBLE + length(w) / 100.0::DOUBLE), 6) AS score FROM q JOIN v USING (w) GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, domain_code) AS rank FROM s) WHERE rank <= 3"""


def top_keyword_argmax(spark: SparkSession, root: str) -> DataFrame:
    """TOP07, TOP08, SEL04, SEL05, SEL06: class of a question by keywords, with a default below the threshold."""
    words = {"Events": ["reaction", "breach", "adverse", "reason"], "Findings": ["result", "score", "range", "rate", "reading"], "Interventions": ["dose", "drug", "kit", "stent"]}
    low = F.lower(F.coalesce("text", F.lit("")))
    count = lambda ws: sum((F.contains(low, F.lit(x)).cast("int") for x in ws), F.lit(0))
    best = F.array_max(F.array(*[F.struct(count(ws).alias("n"), F.lit(c).alias("c")) for c, ws in words.items()]))
    return _pa(spark, root).select("row_id", best.alias("b")).select("row_id", F.when(F.col("b.n") >= 1, F.col("b.c")).otherwise("Unknown").alias("class"), F.col("b.n").alias("hits"))


_ARGMAX = """WITH s AS (SELECT row_id, lower(coalesce(text, '')) AS t FROM page_annotations),
c AS (SELECT row_id, unnest([{'n': contains(t, 'reaction')::INT + contains(t, 'breach')::INT + contains(t, 'adverse')::INT + contains(t, 'reason')::INT, 'c': 'Events'},
 {'n': contains(t, 'result')::INT + contains(t, 'score')::INT + contains(t, 'range')::INT + contains(t, 'rate')::INT + contains(t, 'reading')::INT, 'c': 'Findings'},
 {'n': contains(t, 'dose')::INT + contains(t, 'drug')::INT + contains(t, 'kit')::INT + contains(t, 'stent')::INT, 'c': 'Interventions'}]) AS b FROM s),
r AS (SELECT row_id, b.n AS n, b.c AS c, row_number() OVER (PARTITION BY row_id ORDER BY b.n DESC, b.c DESC) AS rn FROM c)
SELECT row_id, CASE WHEN n >= 1 THEN c ELSE 'Unknown' END AS class, n AS hits FROM r WHERE rn = 1"""


def ret_rule_context(spark: SparkSession, root: str) -> DataFrame:
    """RET21: terms gathered by codelist as context of the variables that use it."""
    t = table(spark, root, "ct_terms").groupBy("codelist_code").agg(F.array_join(F.array_sort(F.collect_list("submission_value")), "|").alias("terms"), F.count(F.lit(1)).alias("n_terms"))
    return table(spark, root, "sdtm_variables").filter("codelist_code IS NOT NULL").select("variable_row", "codelist_code").join(t, "codelist_code", "left")


def flt_priority_variables(spark: SparkSession, root: str) -> DataFrame:
    """FLT08: variables that are no identifiers, by priority, the first 15 of a domain (a top-k report)."""
    v = table(spark, root, "sdtm_variables").filter("role <> 'Identifier'").select("domain_code", "var_name", "role", "core").distinct()
    p = F.round(F.lit(0.5) + F.when(F.col("role") == "Topic", 0.3).otherwise(0.0) + F.when(F.col("core") == "Req", 0.2).when(F.col("core") == "Exp", 0.1).otherwise(0.0), 6)
    w = Window.partitionBy("domain_code").orderBy(F.desc("priority"), "var_name", "role", "core")
    return v.withColumn("priority", p).withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 15").select("domain_code", "var_name", "priority", "rank")


_PRIORITY = """WITH v AS (SELECT DISTINCT domain_code, var_name, role, core FROM sdtm_variables WHERE role <> 'Identifier'),
p AS (SELECT *, CAST(round(0.5 + CASE WHEN role = 'Topic' THEN 0.3 ELSE 0 END + CASE core WHEN 'Req' THEN 0.2 WHEN 'Exp' THEN 0.1 ELSE 0 END, 6) AS DOUBLE) AS priority FROM v)
SELECT * FROM (SELECT domain_code, var_name, priority, row_number() OVER (PARTITION BY domain_code ORDER BY priority DESC, var_name, role, core NULLS FIRST) AS rank FROM p) WHERE rank <= 15"""


def kbb_chunks(spark: SparkSession, root: str) -> DataFrame:
    """KBB08: texts cut into numbered sections at numbered headings."""
    d = table(spark, root, "documents").filter("text IS NOT NULL")
    c = d.select("doc_id", F.posexplode(F.split("text", r"\n(?=[0-9]+[.][0-9]+ [A-Z])")).alias("chunk", "body"))
    return c.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.length("body").cast("long").alias("n_chars"), F.md5("body").alias("digest"))


_CHUNKS = r"""WITH m AS (SELECT doc_id, regexp_replace(text, '\n([0-9]+[.][0-9]+ [A-Z])', chr(1) || '\1', 'g') AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, unnest(range(0, len(string_split(t, chr(1))))) AS chunk, unnest(string_split(t, chr(1))) AS body FROM m)
SELECT doc_id, chunk, length(body) AS n_chars, md5(body) AS digest FROM c"""


def kbb_synonyms(spark: SparkSession, root: str) -> DataFrame:
    """KBB06: distinct wordings of each term, exploded."""
    t = table(spark, root, "ct_terms")
    words = F.array_distinct(F.transform(F.array_compact(F.concat(F.array("submission_value", "preferred_term"), F.coalesce("synonyms", F.array().cast("array<string>")))), lambda x: F.lower(x)))
    return t.select("term_id", F.explode(words).alias("wording"))


def trn_steps(spark: SparkSession, root: str) -> DataFrame:
    """TRN01, TRN02, TRN03, FLT17: instruction rows of labelled questions."""
    rows = _pa(spark, root).filter("trim(text) <> ''").withColumn("p", corpus.canonical_pattern(F.col("pattern"))).withColumn("d", F.trim("domain"))
    return corpus.steps(rows, ["row_id"], "text", "d", "p", "annotation")


_STEPS = f"""WITH r AS (SELECT row_id, text, trim(domain, ' ') AS d, annotation, {_CANON} AS p FROM (SELECT *, {_WORDS} AS w FROM page_annotations) WHERE trim(text, ' ') <> '')
SELECT row_id, 'domain' AS step, 'Name the domain. Field: ' || text AS instruction, d AS output FROM r WHERE d <> ''
UNION ALL SELECT row_id, 'pattern', 'Name the pattern. Field: ' || text || '; domain: ' || coalesce(d, 'unknown'), p FROM r WHERE p IS NOT NULL
UNION ALL SELECT row_id, 'variable', 'Write the annotation. Field: ' || text || '; pattern: ' || coalesce(p, 'unknown'), annotation FROM r WHERE annotation <> ''"""


def trn_chat_messages(spark: SparkSession, root: str) -> DataFrame:
    """TRN04, TRN07, SNK06: chat rows rendered as JSON lines."""
    rows = _pa(spark, root).filter("trim(text) <> '' AND trim(annotation) <> ''")
    m = corpus.chat(F.lit("You map form fields."), F.col("text"), F.col("annotation"))
    return rows.select("row_id", F.explode(m).alias("m")).select("row_id", "m.role", "m.content")


def trn_split(spark: SparkSession, root: str) -> DataFrame:
    """RND01, RND02, SNK07: one row in twenty of each study for validation, by hash order."""
    return corpus.split(_pa(spark, root).select("row_id", "study_id"), "study_id", "row_id", 0.05, "17").select("row_id", "study_id", "split")


_SPLIT = """SELECT row_id, study_id, CASE WHEN row_number() OVER (PARTITION BY study_id ORDER BY md5('17|' || row_id), row_id) <= greatest(1, floor(count(*) OVER (PARTITION BY study_id) * 0.05)) THEN 'validation' ELSE 'train' END AS split FROM page_annotations"""


def trn_step_weights(spark: SparkSession, root: str) -> DataFrame:
    """TRN06: weighted mean confidence of each pattern with its dense rank."""
    r = _pa(spark, root).withColumn("p", corpus.canonical_pattern(F.col("pattern"))).filter("p IS NOT NULL")
    wt = F.when(F.col("p") == "conditional", 1.2).when(F.col("p") == "supplemental", 1.1).otherwise(1.0)
    g = r.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("confidence") * wt), 6).alias("weighted"))
    return g.withColumn("step_id", F.dense_rank().over(Window.orderBy("p")).cast("long"))  # one row per pattern


_WEIGHTS = f"""WITH r AS (SELECT confidence, {_CANON} AS p FROM (SELECT *, {_WORDS} AS w FROM page_annotations))
SELECT p, count(*) AS n, round(avg(confidence * CASE p WHEN 'conditional' THEN 1.2::DOUBLE WHEN 'supplemental' THEN 1.1::DOUBLE ELSE 1.0 END), 6) AS weighted, dense_rank() OVER (ORDER BY p) AS step_id FROM r WHERE p IS NOT NULL GROUP BY p"""


def trn_enrich(spark: SparkSession, root: str) -> DataFrame:
    """TRN05, JN12: rows without a form take the form most rows of their page have."""
    pa = _pa(spark, root)
    c = pa.filter("form IS NOT NULL").groupBy("study_id", "page_id", "form").agg(F.count(F.lit(1)).alias("n"))
    best = c.groupBy("study_id", "page_id").agg(F.min_by("form", F.struct(-F.col("n"), F.col("form"))).alias("page_form"))
    return pa.filter("form IS NULL").select("row_id", "study_id", "page_id").join(best, ["study_id", "page_id"], "left").select("row_id", "page_form")


_ENRICH = """WITH c AS (SELECT study_id, page_id, form, count(*) AS n FROM page_annotations WHERE form IS NOT NULL GROUP BY ALL), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY study_id, page_id ORDER BY n DESC, form) AS rn FROM c) WHERE rn = 1)
SELECT row_id, b.form AS page_form FROM page_annotations p LEFT JOIN b ON p.study_id = b.study_id AND p.page_id = b.page_id WHERE p.form IS NULL"""


def trn_shuffle_first(spark: SparkSession, root: str) -> DataFrame:
    """RND03: twenty domains in hash order with the target always among them (a sampling feature)."""
    d = table(spark, root, "sdtm_domains").select("domain_code").distinct()
    first = F.when(F.col("domain_code") == "WD", 0).otherwise(1)
    return d.withColumn("rank", F.row_number().over(Window.orderBy(first, corpus.hash_order(F.col("domain_code"), "3"), "domain_code")).cast("long")).filter("rank <= 20")  # the dictionary's fixed codes


QUERIES = {f.__name__: f for f in (
    val_grammar, val_conformance, val_companions, val_from_json, sel_gate_shape, sel_pattern_cascade, sel_confidence, sel_multi_variable, sel_option_annotations, str_codes, str_query_builder, str_embedding_text,
    str_cache_key, top_additive_keyword, top_keyword_argmax, ret_rule_context, flt_priority_variables, kbb_chunks, kbb_synonyms, trn_steps, trn_chat_messages, trn_split, trn_step_weights, trn_enrich, trn_shuffle_first,
)}

ORACLES = {
    "val_grammar": _GRAMMAR,
    "val_conformance": f"WITH s AS ({_STRIPPED}) SELECT study_id, {_PATTERN} AS pattern, count(*) AS n FROM s GROUP BY ALL",
    "val_companions": _COMPANIONS,
    "val_from_json": f"WITH s AS ({_STRIPPED}) SELECT row_id, v AS annotation FROM s WHERE {_PATTERN} IN ('conditional', 'supplemental', 'plain')",
    "sel_gate_shape": _SHAPE,
    "sel_pattern_cascade": f"WITH s AS (SELECT *, {_WORDS} AS w FROM ({_STRIPPED})) SELECT row_id, {_CANON} AS named, {_PATTERN} AS kept FROM s",
    "sel_confidence": _CONF,
    "sel_multi_variable": "WITH v AS (SELECT DISTINCT domain_code, var_name FROM sdtm_variables) SELECT r.domain_code, r.var_name AS result, string_agg(c.var_name, ' / ' ORDER BY c.var_name) AS companions FROM v r JOIN v c ON r.domain_code = c.domain_code AND c.var_name IN (r.domain_code || 'RSUN', r.domain_code || 'TSTC', r.domain_code || 'TSTN', r.domain_code || 'LATY') WHERE r.var_name LIKE '%RSLT' GROUP BY ALL",
    "sel_option_annotations": "SELECT row_id, concat_ws(' | ', 'Question: ' || question_annotation, 'Options: ' || option_annotations) AS combined FROM page_annotations WHERE question_annotation IS NOT NULL OR option_annotations IS NOT NULL",
    "str_codes": _CODES,
    "str_query_builder": "SELECT row_id, concat_ws(chr(10), 'Q: ' || replace(replace(text, 'AE', 'adverse event'), 'BP', 'blood pressure'), 'Options: ' || option_annotations, 'Section: ' || section, 'Form: ' || form) AS query FROM page_annotations WHERE text IS NOT NULL",
    "str_embedding_text": "SELECT 'v' || variable_row AS id, concat_ws('. ', concat_ws(' ', var_name, label), 'Domain ' || domain_code, definition, 'Codelist ' || codelist_name) AS body FROM sdtm_variables UNION ALL SELECT 't' || term_id, concat_ws('. ', submission_value, preferred_term, array_to_string(synonyms, '; '), codelist_name) FROM ct_terms",
    "str_cache_key": "WITH k AS (SELECT row_id, substring(sha1(lower(coalesce(form, '') || '|' || coalesce(section, '') || '|' || coalesce(text, ''))), 1, 12) AS key FROM page_annotations) SELECT row_id, key, min(row_id) OVER (PARTITION BY key) AS first_row, count(*) OVER (PARTITION BY key) AS n FROM k",
    "top_additive_keyword": _ADDITIVE,
    "top_keyword_argmax": _ARGMAX,
    "ret_rule_context": "WITH t AS (SELECT codelist_code, string_agg(submission_value, '|' ORDER BY submission_value) AS terms, count(*) AS n_terms FROM ct_terms GROUP BY 1) SELECT codelist_code, variable_row, terms, n_terms FROM sdtm_variables LEFT JOIN t USING (codelist_code) WHERE codelist_code IS NOT NULL",
    "flt_priority_variables": _PRIORITY,
    "kbb_chunks": _CHUNKS,
    "kbb_synonyms": "SELECT DISTINCT term_id, lower(w) AS wording FROM (SELECT term_id, unnest(list_concat([submission_value, preferred_term], coalesce(synonyms, []))) AS w FROM ct_terms) WHERE w IS NOT NULL",
    "trn_steps": _STEPS,
    "trn_chat_messages": "SELECT row_id, unnest(['system', 'user', 'assistant']) AS role, unnest(['You map form fields.', text, annotation]) AS content FROM page_annotations WHERE trim(text, ' ') <> '' AND trim(annotation, ' ') <> ''",
    "trn_split": _SPLIT,
    "trn_step_weights": _WEIGHTS,
    "trn_enrich": _ENRICH,
    "trn_shuffle_first": "SELECT * FROM (SELECT domain_code, row_number() OVER (ORDER BY CASE WHEN domain_code = 'WD' THEN 0 ELSE 1 END, md5('3|' || domain_code), domain_code) AS rank FROM (SELECT DISTINCT domain_code FROM sdtm_domains)) WHERE rank <= 20",
}
