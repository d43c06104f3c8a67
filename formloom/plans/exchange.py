"""Queries of files written and read back, streams with expiry, geometry, weighted losses, prompts and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formloom.catalog import table
from formloom.operators import joins, parse
from formloom.plans.parsing import _LINES, _TAGGED
from formloom.session import scratch_path
from formloom.sources import sinks
from formloom.streaming import pages


def src_mapping(spark: SparkSession, root: str) -> DataFrame:
    """SRC15: variables and their domains, saved as sorted lists and read back as pairs."""
    path = scratch_path(spark, "mapping")
    sinks.write_mapping(table(spark, root, "sdtm_variables").filter("domain_code IS NOT NULL"), "var_name", "domain_code", path)
    return sinks.read_mapping(spark, path, "var_name", "domain_code")


_MAPPING = "SELECT DISTINCT var_name, domain_code FROM sdtm_variables WHERE domain_code IS NOT NULL AND var_name IS NOT NULL"


def _dictionary(spark, root):
    return {
        "domains": table(spark, root, "sdtm_domains").select("domain_code", "domain_name", "domain_class", "deleted_at"),
        "variables": table(spark, root, "sdtm_variables").select("var_name", "domain_code", "codelist_code"),
        "terms": table(spark, root, "ct_terms").select("term_id", "codelist_code", "submission_value", "synonyms"),
    }


def snk_dictionary(spark: SparkSession, root: str) -> DataFrame:
    """SNK04, SNK05, SRC11: the dictionary written as files and read back; terms with their number of synonyms."""
    path = scratch_path(spark, "dictionary")
    sinks.write_dictionary(_dictionary(spark, root), path)
    t = sinks.read_dictionary(spark, path)
    n = t["variables"].groupBy("codelist_code").agg(F.count(F.lit(1)).alias("n_variables"))
    return t["terms"].join(n, "codelist_code", "left").select("term_id", "submission_value", F.coalesce(F.size("synonyms"), F.lit(0)).alias("n_synonyms"), "n_variables")


_DICTIONARY = "SELECT term_id, submission_value, CAST(coalesce(len(synonyms), 0) AS INTEGER) AS n_synonyms, n AS n_variables FROM ct_terms LEFT JOIN (SELECT codelist_code, count(*) AS n FROM sdtm_variables GROUP BY 1) USING (codelist_code)"


def snk_package(spark: SparkSession, root: str) -> DataFrame:
    """SNK10: a training package written and read back: examples by step, beside the size of its dictionary."""
    path = scratch_path(spark, "package")
    ex = table(spark, root, "page_annotations").filter("trim(annotation) <> ''").select(F.coalesce("pattern", F.lit("")).alias("step"), F.coalesce("text", F.lit("")).alias("instruction"), F.col("annotation").alias("output"))
    sinks.write_package(ex, _dictionary(spark, root), {"seed": "17", "layout": "alpaca"}, path)
    size = sinks.read_dictionary(spark, f"{path}/dictionary")["terms"].agg(F.count(F.lit(1)).alias("n_terms"))
    given = spark.read.schema("setting string, given string").json(f"{path}/settings").filter("setting = 'seed'").select(F.col("given").alias("seed"))
    return spark.read.schema("step string, n bigint").json(f"{path}/corpus/metadata").crossJoin(size).crossJoin(given)  # one row each


_PACKAGE = "SELECT coalesce(pattern, '') AS step, count(*) AS n, (SELECT count(*) FROM ct_terms) AS n_terms, '17' AS seed FROM page_annotations WHERE trim(annotation, ' ') <> '' GROUP BY 1"


def snk_document(spark: SparkSession, root: str) -> DataFrame:
    """SNK01: pages, item lines and summaries of the tagged documents; the summaries against the lines."""
    path = scratch_path(spark, "document")
    items = parse.tagged(table(spark, root, "documents"), "doc_id", "text").select((F.col("doc_id") % 50).alias("shelf"), "doc_id", "pos", "tag", "text")
    sinks.write_document(items, path, "shelf")
    lines = spark.read.schema("shelf bigint, doc_id bigint, pos bigint, tag string, text string").json(f"{path}/all_items")
    told = spark.read.schema("shelf bigint, n_items bigint, n_tags bigint").json(f"{path}/summary")
    paged = spark.read.schema("doc_id bigint, pos bigint, tag string, text string, shelf bigint").json(f"{path}/pages").groupBy("shelf").agg(F.count(F.lit(1)).alias("n_paged"))
    return told.join(lines.groupBy("shelf").agg(F.count(F.lit(1)).alias("n_lines")), "shelf").join(paged, "shelf")


_SHELVES = _TAGGED + " SELECT doc_id % 50 AS shelf, count(*) AS n_items, count(DISTINCT tag) AS n_tags, count(*) AS n_lines, count(*) AS n_paged FROM items GROUP BY 1"


def snk_second_look(spark: SparkSession, root: str) -> DataFrame:
    """SNK02: rows of low confidence queued for a second look; a queue without rows is not written."""
    path = scratch_path(spark, "queue")
    rows = table(spark, root, "page_annotations").select("row_id", "confidence")
    if sinks.write_queue(rows, f"{path}/none", "confidence > 2") or not sinks.write_queue(rows, f"{path}/low", "confidence < 0.7"):
        return rows.limit(0)
    return spark.read.schema("row_id bigint, confidence double").json(f"{path}/low")


_SECOND = "SELECT row_id, confidence FROM page_annotations WHERE confidence < 0.7"


def stm_memo(spark: SparkSession, root: str) -> DataFrame:
    """STM02, STM04: a stream that lets the first event of each user and kind pass and drops later ones until the memo
    expires after seven days of event time."""
    path = scratch_path(spark, "memo")
    src = table(spark, root, "events").select(F.concat_ws("|", "user_id", "event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    src.write.parquet(path)
    stream = pages.memo(spark.readStream.schema(src.schema).parquet(path), "key", "ts").select("key")
    return pages.run_to_end(stream, scratch_path(spark, "memo-out"), scratch_path(spark, "memo-state"))


_MEMO = "SELECT DISTINCT concat_ws('|', user_id, event_type) AS key FROM events"


def stm_arrivals(spark: SparkSession, root: str) -> DataFrame:
    """STM05: page files taken up as they arrive, a bounded number a batch; lines by file."""
    path = scratch_path(spark, "arrivals")
    src = table(spark, root, "result_lines").select("file_id", "line_no")
    src.repartition(6).write.parquet(path)
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 2).parquet(path)
    got = pages.run_to_end(stream, scratch_path(spark, "arrivals-out"), scratch_path(spark, "arrivals-state"))
    return got.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_lines"), F.max("line_no").alias("last_line"))


_ARRIVALS = "SELECT file_id, count(*) AS n_lines, max(line_no) AS last_line FROM result_lines GROUP BY 1"


def jn_boxes(spark: SparkSession, root: str) -> DataFrame:
    """JN09, JN06: boxes laid out from the rows of a page, each joined with the region it overlaps most (ties to the
    smaller region); pages share no pairs."""
    r = table(spark, root, "page_annotations").filter("seq IS NOT NULL AND qid IS NOT NULL")
    page = F.concat_ws("#", "study_id", "file", F.col("page_id").cast("string"))
    box = r.select("row_id", page.alias("page"), (F.col("seq") * 10.0).alias("y0"), (F.col("seq") * 10.0 + 8).alias("y1"), (F.length("qid") * 1.0).alias("x0"), (F.length("qid") * 1.0 + 30).alias("x1"))
    last = box.groupBy("page").agg(F.max("y1").alias("_y"))
    region = last.select("page", F.explode(F.sequence(F.lit(0), F.floor(F.col("_y") / 35).cast("int"))).alias("k")).select("page", F.col("k").alias("region"), (F.col("k") * 35.0).alias("ry0"), (F.col("k") * 35.0 + 35).alias("ry1"), F.lit(0.0).alias("rx0"), F.lit(25.0).alias("rx1"))
    hit = joins.overlapping(box, region, "page", ("x0", "y0", "x1", "y1"), ("rx0", "ry0", "rx1", "ry1"), 50.0)
    best = hit.groupBy("row_id").agg(F.min(F.struct((-F.col("area")).alias("n"), "region")).alias("b"))
    return best.select("row_id", "b.region", (-F.col("b.n")).alias("area"))


_BOXES = """WITH b AS (SELECT row_id, concat_ws('#', study_id, file, page_id) AS page, seq * 10.0::DOUBLE AS y0, seq * 10.0::DOUBLE + 8 AS y1, length(qid)::DOUBLE AS x0, length(qid)::DOUBLE + 30 AS x1 FROM page_annotations WHERE seq IS NOT NULL AND qid IS NOT NULL),
r AS (SELECT page, k AS region, k * 35.0::DOUBLE AS ry0, k * 35.0::DOUBLE + 35 AS ry1 FROM (SELECT page, unnest(range(0, floor(max(y1) / 35)::INT + 1))::INT AS k FROM b GROUP BY page)),
h AS (SELECT row_id, region, (least(x1, 25.0) - greatest(x0, 0.0)) * (least(y1, ry1) - greatest(y0, ry0)) AS area FROM b JOIN r USING (page) WHERE x0 < 25.0 AND x1 > 0 AND y0 < ry1 AND y1 > ry0)
SELECT row_id, region, area FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY area DESC, region) AS n FROM h) WHERE n = 1"""


def trn_weighted_loss(spark: SparkSession, root: str) -> DataFrame:
    """AGG16, TRN06, TRN08: step numbers by name, the mean loss of each step, and the loss weighted by step over the
    valid tokens; the loss of a row stands in as what its confidence lacks to one."""
    rows = table(spark, root, "page_annotations").filter("confidence IS NOT NULL").select(F.coalesce(F.split("pattern", ",")[0], F.lit("")).alias("step"), (1 - F.col("confidence")).alias("loss"), F.coalesce(F.size(F.split(F.trim("annotation"), r"\s+")), F.lit(0)).alias("tokens"))
    by = rows.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.sum("loss").alias("_l"), F.sum(F.col("loss") * F.col("tokens")).alias("_w"), F.sum("tokens").alias("n_tokens"))
    weight = F.when(F.col("step").startswith("conditional"), 1.2).when(F.col("step").startswith("supplemental"), 1.1).when(F.col("step") == "not_submitted", 0.9).otherwise(1.0)
    order = Window.orderBy("step")  # a row a step
    return by.select((F.dense_rank().over(order) - 1).alias("step_id"), "step", "n", F.round(F.col("_l") / F.col("n"), 6).alias("mean_loss"), F.round(weight * F.col("_w") / F.greatest("n_tokens", F.lit(1)), 6).alias("weighted_loss"), "n_tokens")


_LOSS = """WITH r AS (SELECT coalesce(string_split(pattern, ',')[1], '') AS step, 1 - confidence AS loss, coalesce(len(regexp_split_to_array(trim(annotation, ' '), '\\s+')), 0) AS tokens FROM page_annotations WHERE confidence IS NOT NULL),
b AS (SELECT step, count(*) AS n, sum(loss) AS l, sum(loss * tokens) AS w, sum(tokens)::BIGINT AS n_tokens FROM r GROUP BY 1)
SELECT dense_rank() OVER (ORDER BY step) - 1 AS step_id, step, n, round(l / n, 6) AS mean_loss, round(CASE WHEN starts_with(step, 'conditional') THEN 1.2 WHEN starts_with(step, 'supplemental') THEN 1.1 WHEN step = 'not_submitted' THEN 0.9 ELSE 1.0 END::DOUBLE * w / greatest(n_tokens, 1), 6) AS weighted_loss, n_tokens FROM b"""

#: Turn markers of chat templates: before and after a turn's role, and after its text.
TEMPLATES = {"chatml": ("<|im_start|>", "\n", "<|im_end|>\n"), "plain": ("### ", ":\n", "\n\n"), "bracket": ("[", "] ", "\n")}


def str_chat_template(spark: SparkSession, root: str) -> DataFrame:
    """UDF09, TRN07: question and annotation of each row as chat text under each template."""
    out = []
    for name, (a, b, c) in TEMPLATES.items():
        turn = lambda role, text, a=a, b=b, c=c: F.concat(F.lit(a + role + b), text, F.lit(c))
        out.append(F.struct(F.lit(name).alias("template"), F.concat(turn("user", F.col("text")), turn("assistant", F.col("annotation"))).alias("chat")))
    rows = table(spark, root, "page_annotations").filter("text IS NOT NULL AND annotation IS NOT NULL")
    return rows.select("row_id", F.explode(F.array(*out)).alias("t")).select("row_id", "t.template", "t.chat")


def _lit(text: str) -> str:
    return " || ".join([f"'{x}'" for x in text.split("\n")]).replace(" || '", " || chr(10) || '") if "\n" in text else f"'{text}'"


_CHAT = " UNION ALL ".join(f"SELECT row_id, '{n}' AS template, {_lit(a + 'user' + b)} || text || {_lit(c)} || {_lit(a + 'assistant' + b)} || annotation || {_lit(c)} AS chat FROM page_annotations WHERE text IS NOT NULL AND annotation IS NOT NULL" for n, (a, b, c) in TEMPLATES.items())

#: Extraction passes over a page's lines: name, instruction and the lines a rule-based stand-in keeps.
PASSES = [("questions", "List the questions of the page.", r"\?\s*$"), ("form", "Name the form of the page.", r"(?i)\b(form|log|exam|questionnaire)\b"), ("sections", "List the section headers of the page.", r"^[^a-z]*[A-Z][^a-z]*$")]


def hook_passes(spark: SparkSession, root: str) -> DataFrame:
    """DIG01, DIG02, MSC04, UDF07: the lines each extraction pass keeps of every document, each pass with its own
    instruction; a model takes the rule's place through the hooks."""
    lines = parse.lines(table(spark, root, "documents"), "doc_id", "text")
    text = [c for c in lines.columns if c not in ("doc_id", "pos")][0]
    kept = [F.when(F.col(text).rlike(rule), F.lit(name)) for name, _, rule in PASSES]
    rows = lines.select("doc_id", F.explode(F.array_compact(F.array(*kept))).alias("pass"))
    prompts = F.create_map(*[F.lit(x) for name, prompt, _ in PASSES for x in (name, prompt)])
    return rows.groupBy("doc_id", "pass").agg(F.count(F.lit(1)).alias("n_lines")).withColumn("instruction", prompts[F.col("pass")])


_PASSED = _LINES + ", k AS (SELECT doc_id, unnest([" + ", ".join(f"CASE WHEN regexp_matches(line, '{r}') THEN '{n}' END" for n, _, r in PASSES) + """]) AS pass FROM lines)
SELECT doc_id, pass, count(*) AS n_lines, CASE pass """ + " ".join(f"WHEN '{n}' THEN '{t}'" for n, t, _ in PASSES) + " END AS instruction FROM k WHERE pass IS NOT NULL GROUP BY ALL"


def msc_error_rows(spark: SparkSession, root: str) -> DataFrame:
    """MSC01: every delivered page gives a row that says whether it holds a page, or why not."""
    v = F.try_parse_json("payload")
    obj = F.schema_of_variant(v).startswith("OBJECT")
    blank = F.coalesce(F.trim("payload"), F.lit("")) == ""
    return table(spark, root, "page_results").select("result_id", F.when(blank, "empty").when(v.isNull(), "broken").when(~obj, "no page").otherwise("ok").alias("status"))


_ERRORS = """SELECT result_id, CASE WHEN coalesce(trim(payload, ' '), '') = '' THEN 'empty' WHEN NOT json_valid(payload) THEN 'broken' WHEN json_type(payload) <> 'OBJECT' THEN 'no page' ELSE 'ok' END AS status FROM page_results"""


def ext_dates(spark: SparkSession, root: str) -> DataFrame:
    """DTE02, an extension: month arithmetic, day differences, a time zone, an interval and decimal sums."""
    o = table(spark, root, "lineitem")
    d = F.to_date("l_shipdate")
    rows = o.select(F.date_format(F.add_months(d, 1), "yyyy-MM").alias("next_month"), F.datediff(F.last_day(d), d).alias("days_left"), F.hour(F.from_utc_timestamp(F.col("l_shipdate").cast("timestamp"), "Asia/Tokyo")).alias("tokyo_hour"), F.col("l_extendedprice").cast("decimal(12,2)").alias("price"), F.dayofweek(d + F.expr("INTERVAL 10 DAYS")).alias("weekday"))
    return rows.groupBy("next_month", "tokyo_hour", "weekday").agg(F.sum("days_left").alias("days_left"), F.sum("price").cast("double").alias("price"))


_DATES = """WITH r AS (SELECT strftime(l_shipdate::DATE + INTERVAL 1 MONTH, '%Y-%m') AS next_month, date_diff('day', l_shipdate::DATE, last_day(l_shipdate::DATE)) AS days_left, hour(l_shipdate + INTERVAL 9 HOUR)::INT AS tokyo_hour,
 l_extendedprice::DECIMAL(12,2) AS price, (dayofweek(l_shipdate::DATE + INTERVAL 10 DAY) + 1)::INT AS weekday FROM lineitem)
SELECT next_month, tokyo_hour, weekday, sum(days_left)::BIGINT AS days_left, sum(price)::DOUBLE AS price FROM r GROUP BY ALL"""

QUERIES = {f.__name__: f for f in (src_mapping, snk_dictionary, snk_package, snk_document, snk_second_look, stm_memo, stm_arrivals, jn_boxes, trn_weighted_loss, str_chat_template, hook_passes, msc_error_rows, ext_dates)}

ORACLES = {
    "snk_document": _SHELVES, "hook_passes": _PASSED, "src_mapping": _MAPPING, "snk_dictionary": _DICTIONARY, "snk_package": _PACKAGE, "snk_second_look": _SECOND, "stm_memo": _MEMO, "stm_arrivals": _ARRIVALS, "jn_boxes": _BOXES, "trn_weighted_loss": _LOSS,
    "str_chat_template": _CHAT, "msc_error_rows": _ERRORS, "ext_dates": _DATES,
}
