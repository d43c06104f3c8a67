"""Queries on tagged pages, lines, labels and packed records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formloom.catalog import spread, table
from formloom.functions import text as tx
from formloom.operators import parse

CUES = ["specify", "describe", "date of", "reason for"]


def _docs(spark, root):
    return spread(table(spark, root, "documents").select("doc_id", "text"))


def _items(spark, root):
    return parse.question_ids(parse.tagged(_docs(spark, root), "doc_id", "text"), "doc_id", ["pos"])


_LINES = r"""
WITH raw AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|\r|\n')) AS l,
                    unnest(range(1, len(regexp_split_to_array(text, '\r\n|\r|\n')) + 1)) AS pos FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, CAST(pos AS BIGINT) AS pos, regexp_replace(l, '^\s+|\s+$', '', 'g') AS line FROM raw WHERE regexp_replace(l, '^\s+|\s+$', '', 'g') <> '')"""
_TAGGED = _LINES + r""",
t0 AS (SELECT doc_id, pos, regexp_extract(line, '^(<FORM>|<SH>|<Q>|<INPUT>)', 1) AS tag, line FROM lines),
t1 AS (SELECT doc_id, pos, tag, regexp_replace(substring(line, length(tag) + 1), '^\s+|\s+$', '', 'g') AS b FROM t0 WHERE tag <> ''),
items AS (SELECT doc_id, pos, tag,
  CASE WHEN tag = '<SH>' THEN regexp_replace(CASE WHEN contains(b, '|') THEN substring(b, 1, instr(b, '|') - 1) ELSE b END, '^\s+|\s+$', '', 'g') ELSE b END AS text,
  CASE WHEN tag = '<SH>' THEN coalesce(CASE WHEN contains(b, '|') THEN nullif(regexp_replace(substring(b, instr(b, '|') + 1), '^\s+|\s+$', '', 'g'), '') END, 'none') END AS below,
  CASE WHEN tag = '<INPUT>' THEN CASE WHEN lower(b) IN ('yes', 'no', 'n/a', 'unknown', 'not done') THEN 'option'
    WHEN contains(lower(b), '___') OR contains(lower(b), 'dd-mmm-yyyy') OR contains(lower(b), 'hh:mm') OR contains(lower(b), '/___/') OR contains(lower(b), '|__|') THEN 'text'
    WHEN length(b) > 50 THEN 'free' WHEN substring(b, 1, 1) IN ('□', '○') THEN 'option' ELSE 'text' END END AS input_type FROM t1)"""
_IDS = _TAGGED + """,
n AS (SELECT *, sum(CASE WHEN tag = '<Q>' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM items),
ids AS (SELECT doc_id, pos, tag, text, below, input_type, CASE WHEN tag = '<Q>' THEN printf('q-%03d', CAST(k - 1 AS BIGINT)) END AS qid,
  CASE WHEN tag = '<INPUT>' THEN CASE WHEN k > 0 THEN printf('q-%03d', CAST(k - 1 AS BIGINT)) ELSE 'orphan' END END AS parent_qid FROM n)"""


def prj_parse_tagged_lines(spark: SparkSession, root: str) -> DataFrame:
    """PRJ01, PRJ02, PRJ04: tagged lines with input kinds and split section headers."""
    return parse.tagged(_docs(spark, root), "doc_id", "text")


def prj_assign_ids(spark: SparkSession, root: str) -> DataFrame:
    """PRJ03, PRJ07, PRJ08, WIN01, WIN05: question ids and the parents of inputs."""
    return _items(spark, root).select("doc_id", "pos", "tag", "qid", "parent_qid")


def prj_field_builder(spark: SparkSession, root: str) -> DataFrame:
    """PRJ12, PRJ13, PRJ23, PRJ24, JN05: one field per question with its inputs."""
    return parse.fields(_items(spark, root), "doc_id")


_FIELDS = _IDS + r""",
q AS (SELECT doc_id, qid, text AS label FROM ids WHERE tag = '<Q>'),
i AS (SELECT doc_id, parent_qid AS qid, count(*) AS n_inputs, count(*) FILTER (WHERE input_type = 'option') AS n_options,
  bool_or(regexp_matches(lower(text), 'yyyy|date')) AS d, string_agg(text, '|' ORDER BY pos) FILTER (WHERE input_type = 'option') AS options
  FROM ids WHERE tag = '<INPUT>' AND parent_qid <> 'orphan' GROUP BY ALL)
SELECT q.doc_id, q.qid, label, CASE WHEN n_options > 0 THEN CASE WHEN n_inputs > 2 THEN 'checkbox' ELSE 'radio' END WHEN d THEN 'date' ELSE 'text' END AS input_type,
  coalesce(options, '') AS options, coalesce(n_inputs, 0) AS n_inputs, nullif(regexp_extract(label, '\(([^)]+)\)$', 1), '') AS units
FROM q LEFT JOIN i USING (doc_id, qid)"""


def prj_section_context(spark: SparkSession, root: str) -> DataFrame:
    """WIN02, WIN03, JN08: the form, the section and the next header of each question."""
    items = parse.tagged(_docs(spark, root), "doc_id", "text")
    items = parse.running(items, ["doc_id"], ["pos"], F.when(F.col("tag") == "<FORM>", F.col("text")), "form")
    items = parse.running(items, ["doc_id"], ["pos"], F.when(F.col("tag") == "<SH>", F.col("text")), "section")
    ahead = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    nxt = F.first(F.when(F.col("tag") == "<SH>", F.col("pos")), ignorenulls=True).over(ahead)
    return items.withColumn("next_header", nxt).filter("tag = '<Q>'").select("doc_id", "pos", "form", "section", "next_header")


_SECTION = _TAGGED + """
SELECT * FROM (SELECT doc_id, pos, tag, last_value(CASE WHEN tag = '<FORM>' THEN text END IGNORE NULLS) OVER w AS form,
  last_value(CASE WHEN tag = '<SH>' THEN text END IGNORE NULLS) OVER w AS section,
  first_value(CASE WHEN tag = '<SH>' THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_header
FROM items WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE tag = '<Q>'"""


def prj_page_context(spark: SparkSession, root: str) -> DataFrame:
    """PRJ22: first form and first section of a page beside its number of questions."""
    it = parse.tagged(_docs(spark, root), "doc_id", "text")
    return it.groupBy("doc_id").agg(
        F.min_by("text", F.when(F.col("tag") == "<FORM>", F.col("pos"))).alias("form"),
        F.min_by("text", F.when(F.col("tag") == "<SH>", F.col("pos"))).alias("section"),
        F.count_if(F.col("tag") == "<Q>").alias("n_questions"),
    )


def prj_fallback_questions(spark: SparkSession, root: str) -> DataFrame:
    """PRJ09, WIN04: questions of untagged text."""
    return parse.fallback_questions(parse.lines(_docs(spark, root), "doc_id", "text"), "doc_id", CUES).select("doc_id", "pos", "reason")


_FALLBACK = _LINES + """,
w AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM lines),
r AS (SELECT doc_id, pos, CASE WHEN ends_with(line, '?') THEN 'mark' WHEN ends_with(line, ':') AND length(line) > 5 AND regexp_matches(nxt, '[□○☐]') THEN 'box'
  WHEN contains(lower(line), 'specify') OR contains(lower(line), 'describe') OR contains(lower(line), 'date of') OR contains(lower(line), 'reason for') THEN 'cue' END AS reason FROM w)
SELECT * FROM r WHERE reason IS NOT NULL"""


def prj_supplements(spark: SparkSession, root: str) -> DataFrame:
    """PRJ10, JN19: lines of a page that no item covers, typed as headers or text."""
    docs = _docs(spark, root)
    rest = parse.supplements(parse.lines(docs, "doc_id", "text"), parse.tagged(docs, "doc_id", "text"), "doc_id")
    return rest.select("doc_id", "pos", F.when(F.col("line").rlike(r"^[0-9]+[.][0-9]* [A-Z]"), "section_header").otherwise("text").alias("type"))


_SUPPLEMENTS = _TAGGED + r"""
SELECT doc_id, pos, CASE WHEN regexp_matches(line, '^[0-9]+[.][0-9]* [A-Z]') THEN 'section_header' ELSE 'text' END AS type
FROM lines l WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.doc_id = l.doc_id AND (contains(l.line, i.text) OR contains(i.text, l.line)))"""


def prj_line_context(spark: SparkSession, root: str) -> DataFrame:
    """PRJ11, TOP10: the first 50 lines of each page as one context text (a feature of the operator)."""
    ln = parse.lines(_docs(spark, root), "doc_id", "text")
    ln = ln.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))).filter("_r <= 50")
    row = F.struct("pos", F.format_string("line_%03d: %s", "pos", "line").alias("t"))
    return ln.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda s: s["t"]), "\n").alias("context"), F.count(F.lit(1)).alias("n_lines"))


_CONTEXT = _LINES + """,
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM lines)
SELECT doc_id, string_agg(printf('line_%03d: %s', pos, line), chr(10) ORDER BY pos) AS context, count(*) AS n_lines FROM r WHERE rn <= 50 GROUP BY doc_id"""


def prj_label_normalise(spark: SparkSession, root: str) -> DataFrame:
    """PRJ14, PRJ15, PRJ25, PRJ26, STR01, STR02, STR10, STR18: normal forms of question texts."""
    return table(spark, root, "page_annotations").select(
        "row_id",
        tx.normal_space(F.col("text")).alias("plain"),
        tx.trailing_code(F.col("text")).alias("code"),
        tx.bare_option(F.col("option_annotations")).alias("option"),
        tx.slug(F.col("form")).alias("slug"),
        F.replace(F.lower("form"), F.lit(" "), F.lit("_")).alias("chunk_id"),
    )


_NORMALISE = r"""SELECT row_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g'), ' ') AS plain, nullif(regexp_extract(text, '\(([A-Z0-9_]+)\)$', 1), '') AS code,
 regexp_replace(regexp_replace(option_annotations, '^[\s\[\]()○●□■☐☑]+', ''), '^\s+|\s+$', '', 'g') AS option,
 regexp_replace(form, '[^A-Za-z0-9_-]', '_', 'g') AS slug, replace(lower(form), ' ', '_') AS chunk_id FROM page_annotations"""


def prj_features(spark: SparkSession, root: str) -> DataFrame:
    """PRJ16, FLT01, FLT02, FLT03, FLT13: what a question text tells."""
    t = F.col("text")
    low = F.lower(t)
    return table(spark, root, "page_annotations").select(
        "row_id",
        tx.contains_any(low, ["page number", "investigator", "signature", "site", "visit date"]).alias("operational"),
        tx.contains_any(low, ["date", "time", "day"]).alias("dated"),
        low.rlike(r"\b(number|result|unit|score|rate|weight|length)s?\b").alias("numeric"),
        low.rlike("other,? *specify").alias("other_specify"),
        F.array_join(F.regexp_extract_all(t, F.lit(r"([A-Z]{2}_[0-9A-Z]+)"), F.lit(1)), ",").alias("codes"),
    )


_FEATURES = r"""SELECT row_id,
 contains(lower(text), 'page number') OR contains(lower(text), 'investigator') OR contains(lower(text), 'signature') OR contains(lower(text), 'site') OR contains(lower(text), 'visit date') AS operational,
 contains(lower(text), 'date') OR contains(lower(text), 'time') OR contains(lower(text), 'day') AS dated,
 regexp_matches(lower(text), '\b(number|result|unit|score|rate|weight|length)s?\b') AS "numeric", regexp_matches(lower(text), 'other,? *specify') AS other_specify,
 array_to_string(regexp_extract_all(text, '([A-Z]{2}_[0-9A-Z]+)', 1), ',') AS codes FROM page_annotations"""


def prj_json_salvage(spark: SparkSession, root: str) -> DataFrame:
    """PRJ05, PRJ06, PRJ21, JSN01: JSON records out of lines with text around them."""
    lines = table(spark, root, "result_lines").select("line_id", F.concat(F.lit("note "), "line_text", F.lit(" end")).alias("t"))
    return lines.select("line_id", parse.salvage_json(F.col("t"), "qid string, seq bigint, text string, page_id string").alias("r")).filter("r.qid IS NOT NULL").select("line_id", "r.qid", "r.seq", "r.text")


_SALVAGE = r"""WITH s AS (SELECT line_id, regexp_extract('note ' || line_text || ' end', '(?s)(\{.*\})', 1) AS j FROM result_lines),
v AS (SELECT line_id, CASE WHEN j <> '' AND json_valid(j) THEN j END AS j FROM s)
SELECT line_id, j ->> '$.qid' AS qid, CAST(j ->> '$.seq' AS BIGINT) AS seq, j ->> '$.text' AS text FROM v WHERE j ->> '$.qid' IS NOT NULL"""


def prj_prefixed_response(spark: SparkSession, root: str) -> DataFrame:
    """PRJ19, PRJ20, WIN11: answers in prefixed lines, confidence by wording."""
    src = table(spark, root, "page_annotations").select(
        "row_id",
        F.concat_ws("\n", F.concat(F.lit("DOMAIN: "), F.coalesce("domain", F.lit(""))), F.concat(F.lit("PATTERN: "), F.coalesce("pattern", F.lit(""))), F.concat(F.lit("REASONING: "), F.when(F.col("confidence") >= 0.9, "certain").when(F.col("confidence") >= 0.8, "likely").otherwise("possible"))).alias("t"),
    )
    reason = parse.prefixed(F.col("t"), "REASONING")
    return src.select("row_id", parse.prefixed(F.col("t"), "DOMAIN").alias("domain"), parse.prefixed(F.col("t"), "PATTERN").alias("pattern"), F.when(reason == "certain", 0.9).when(reason == "likely", 0.6).otherwise(0.75).alias("confidence"))


_PREFIXED = r"""SELECT row_id, nullif(regexp_replace(regexp_extract(coalesce(domain, ''), '^[^\r\n]*'), '^\s+|\s+$', '', 'g'), '') AS domain,
 nullif(regexp_replace(regexp_extract(coalesce(pattern, ''), '^[^\r\n]*'), '^\s+|\s+$', '', 'g'), '') AS pattern,
 CAST(CASE WHEN confidence >= 0.9 THEN 0.9 WHEN confidence >= 0.8 THEN 0.6 ELSE 0.75 END AS DOUBLE) AS confidence FROM page_annotations"""


def prj_structured_mappings(spark: SparkSession, root: str) -> DataFrame:
    """PRJ17, PRJ18, SNK11: mapping texts to variable, condition and value, and back."""
    src = table(spark, root, "page_annotations").filter("annotation IS NOT NULL AND annotation <> ''")
    rows = src.select("row_id", F.explode(F.split("annotation", " / ")).alias("part")).withColumn("part", tx.strip(F.col("part"))).filter("part <> ''")
    head = F.split("part", " when ", 2)
    cond = F.get(head, F.lit(1))
    sides = F.split(cond, "=", 2)
    out = rows.select(
        "row_id",
        tx.strip(head[0]).alias("variable"),
        F.nullif(tx.strip(sides[0]), F.lit("")).alias("condition"),
        F.nullif(F.regexp_replace(tx.strip(F.get(sides, F.lit(1))), "^[\"']|[\"']$", ""), F.lit("")).alias("value"),
    )
    return out.withColumn("rendered", F.concat("variable", F.coalesce(F.concat(F.lit(" when "), "condition", F.coalesce(F.concat(F.lit(" = "), "value"), F.lit(""))), F.lit(""))))


_MAPPINGS = r"""WITH p AS (SELECT row_id, regexp_replace(unnest(string_split(annotation, ' / ')), '^\s+|\s+$', '', 'g') AS part FROM page_annotations WHERE annotation <> ''),
h AS (SELECT row_id, CASE WHEN contains(part, ' when ') THEN substring(part, 1, instr(part, ' when ') - 1) ELSE part END AS v, CASE WHEN contains(part, ' when ') THEN substring(part, instr(part, ' when ') + 6) END AS c FROM p WHERE part <> ''),
s AS (SELECT row_id, regexp_replace(v, '^\s+|\s+$', '', 'g') AS variable,
 nullif(regexp_replace(CASE WHEN contains(c, '=') THEN substring(c, 1, instr(c, '=') - 1) ELSE c END, '^\s+|\s+$', '', 'g'), '') AS condition,
 nullif(regexp_replace(regexp_replace(CASE WHEN contains(c, '=') THEN substring(c, instr(c, '=') + 1) END, '^\s+|\s+$', '', 'g'), '^["'']|["'']$', '', 'g'), '') AS value FROM h)
SELECT *, variable || coalesce(' when ' || condition || coalesce(' = ' || value, ''), '') AS rendered FROM s"""


def src_explode_pages(spark: SparkSession, root: str) -> DataFrame:
    """SRC04, SRC05, SRC06: page files as nested rows, exploded; a malformed page gives one error row."""
    schema = "page_id int, annotations array<struct<qid string, seq int, text string, annotation string, domain string>>, broken string"
    pages = table(spark, root, "page_results").filter(F.trim(F.coalesce("payload", F.lit(""))) != "")
    p = pages.select("result_id", F.from_json("payload", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}).alias("p"))
    return p.select("result_id", F.explode_outer("p.annotations").alias("a")).filter("a.qid IS NOT NULL").select("result_id", "a.qid", "a.seq", "a.text", "a.domain")


_EXPLODE = r"""WITH v AS (SELECT result_id, CASE WHEN json_valid(payload) THEN payload::JSON END AS j FROM page_results),
a AS (SELECT result_id, unnest(from_json(CASE WHEN json_type(j -> '$.annotations') = 'ARRAY' THEN j -> '$.annotations' END, '["JSON"]')) AS q FROM v WHERE j IS NOT NULL)
SELECT result_id, q ->> '$.qid' AS qid, CAST(q ->> '$.seq' AS INTEGER) AS seq, q ->> '$.text' AS text, q ->> '$.domain' AS domain FROM a WHERE json_type(q) = 'OBJECT' AND q ->> '$.qid' IS NOT NULL"""


def prj_json_props(spark: SparkSession, root: str) -> DataFrame:
    """JSN01, MAP01: values out of JSON properties with a default."""
    return table(spark, root, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("bigint"), F.lit(-1).cast("bigint")).alias("k"))


QUERIES = {f.__name__: f for f in (
    prj_parse_tagged_lines, prj_assign_ids, prj_field_builder, prj_section_context, prj_page_context, prj_fallback_questions, prj_supplements, prj_line_context, prj_label_normalise,
    prj_features, prj_json_salvage, prj_prefixed_response, prj_structured_mappings, src_explode_pages, prj_json_props,
)}

ORACLES = {
    "prj_parse_tagged_lines": _TAGGED + " SELECT * FROM items",
    "prj_assign_ids": _IDS + " SELECT doc_id, pos, tag, qid, parent_qid FROM ids",
    "prj_field_builder": _FIELDS,
    "prj_section_context": "SELECT doc_id, pos, form, section, next_header FROM (" + _SECTION + ")",
    "prj_page_context": _TAGGED + " SELECT doc_id, arg_min(text, pos) FILTER (WHERE tag = '<FORM>') AS form, arg_min(text, pos) FILTER (WHERE tag = '<SH>') AS section, count(*) FILTER (WHERE tag = '<Q>') AS n_questions FROM items GROUP BY doc_id",
    "prj_fallback_questions": _FALLBACK,
    "prj_supplements": _SUPPLEMENTS,
    "prj_line_context": _CONTEXT,
    "prj_label_normalise": _NORMALISE,
    "prj_features": _FEATURES,
    "prj_json_salvage": _SALVAGE,
    "prj_prefixed_response": _PREFIXED,
    "prj_structured_mappings": _MAPPINGS,
    "src_explode_pages": _EXPLODE,
    "prj_json_props": "SELECT event_id, coalesce(CAST(props ->> '$.k' AS BIGINT), -1) AS k FROM events",
}
