"""Queries of source files: boxes, CSV, gold pages, variable lists, corpora; audits and vectors; sections and search details."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.catalog import table
from formloom.functions import text as tx
from formloom.operators import parse, retrieve
from formloom.plans.parsing import _TAGGED
from formloom.plans.rules import _TFV, RULES, _VALUES, _values, ret_tfidf_variables
from formloom.session import scratch_path
from formloom.sources import pages, sinks


def src_boxes(spark: SparkSession, root: str) -> DataFrame:
    """SRC01 to SRC03, where lines were extracted before: boxes as shares of their page; a page without size has none."""
    r = table(spark, root, "page_annotations").filter("seq IS NOT NULL").select("row_id", F.lit(40.0).alias("x1"), (F.col("seq") * 12.0).alias("y1"), F.lit(300.0).alias("x2"), (F.col("seq") * 12.0 + 9).alias("y2"), F.lit(595.0).alias("w"), F.when(F.col("page_id") % 10 != 0, 842.0).otherwise(0.0).alias("h"))
    return pages.normalise_box(r, "w", "h").select("row_id", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


_BOX = "SELECT row_id, round(40.0::DOUBLE / 595, 6) AS x1, CASE WHEN page_id % 10 <> 0 THEN round(seq * 12.0::DOUBLE / 842, 6) END AS y1, round(300.0::DOUBLE / 595, 6) AS x2, CASE WHEN page_id % 10 <> 0 THEN round((seq * 12.0::DOUBLE + 9) / 842, 6) END AS y2 FROM page_annotations WHERE seq IS NOT NULL"


def src_csv(spark: SparkSession, root: str) -> DataFrame:
    """SRC16: terms written as CSV with quotes and line breaks and read back with their types."""
    path = scratch_path(spark, "csv")
    t = table(spark, root, "ct_terms").select("term_id", "submission_value", "preferred_term", F.concat(F.lit('say "'), F.col("definition"), F.lit('",\nthen')).alias("definition"))
    t.write.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return pages.read_csv(spark, path, "term_id bigint, submission_value string, preferred_term string, definition string")


_CSV = "SELECT term_id, submission_value, preferred_term, 'say \"' || definition || '\",' || chr(10) || 'then' AS definition FROM ct_terms"


def src_gold_files(spark: SparkSession, root: str) -> DataFrame:
    """SRC12, SNK03: annotation results written as gold page files, one a page number, and the usable rows read back."""
    path = scratch_path(spark, "gold")
    r = table(spark, root, "page_annotations").filter("page_id IS NOT NULL").withColumn("page", F.col("page_id") % 40)
    got = r.groupBy("page").agg(F.collect_list(F.struct("qid", "seq", "text", "annotation", "domain", "pattern", "confidence", "valid", "form", "section")).alias("annotations"))
    got.select(F.col("page").alias("n"), F.to_json(F.struct(F.col("page").alias("page_id"), "annotations")).alias("value")).repartition("n").write.partitionBy("n").text(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    for part in fs.listStatus(hadoop):  # at most 40 folders, each with one file
        if part.isDirectory():
            for f in fs.listStatus(part.getPath()):
                if f.getPath().getName().startswith("part-"):
                    fs.rename(f.getPath(), spark._jvm.org.apache.hadoop.fs.Path(f"{path}/page_{part.getPath().getName()[2:]}_result.json"))
                    fs.delete(part.getPath(), True)
    usable = pages.usable_gold(pages.read_gold(spark, path))
    return usable.groupBy("page").agg(F.count(F.lit(1)).alias("n_rows"), F.min("qid").alias("first_qid"), F.round(F.sum("confidence"), 4).alias("confidence"))


_GOLD = "SELECT (page_id % 40)::INT AS page, count(*) AS n_rows, min(qid) AS first_qid, round(sum(confidence), 4) AS confidence FROM page_annotations WHERE page_id IS NOT NULL AND trim(text, ' ') <> '' AND trim(annotation, ' ') <> '' GROUP BY 1"


def src_variable_files(spark: SparkSession, root: str) -> DataFrame:
    """SRC09, MSC06, MSC10: the variables as one list and as one object by domain, written and read by the same reader."""
    one, two = scratch_path(spark, "variables-list"), scratch_path(spark, "variables-map")
    v = table(spark, root, "sdtm_variables").filter("var_name IS NOT NULL AND domain_code IS NOT NULL")
    row = F.struct(F.col("domain_code").alias("domain"), F.col("var_name").alias("name"), "label", "role", "core", F.col("codelist_code").alias("codelist"))
    v.agg(F.to_json(F.collect_list(row)).alias("value")).coalesce(1).write.text(one)  # a dictionary table
    by = v.groupBy("domain_code").agg(F.collect_list(row).alias("rows"))
    by.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("domain_code", "rows")))).alias("value")).coalesce(1).write.text(two)
    both = pages.read_variables(spark, one).withColumn("shape", F.lit("list")).unionByName(pages.read_variables(spark, two).withColumn("shape", F.lit("map")))
    return both.groupBy("shape", "domain").agg(F.count(F.lit(1)).alias("n"), F.count("codelist").alias("n_coded"))


_VARFILES = "SELECT shape, domain_code AS domain, count(*) AS n, count(codelist_code) AS n_coded FROM sdtm_variables, (VALUES ('list'), ('map')) s(shape) WHERE var_name IS NOT NULL AND domain_code IS NOT NULL GROUP BY ALL"


def src_alpaca(spark: SparkSession, root: str) -> DataFrame:
    """MSC16, MSC12, SNK06: the corpus in its three layouts, and the instruction layout read back."""
    path = scratch_path(spark, "corpus")
    ex = table(spark, root, "page_annotations").filter("text IS NOT NULL AND annotation IS NOT NULL").select(F.coalesce("pattern", F.lit("")).alias("step"), F.col("text").alias("instruction"), F.col("annotation").alias("output"))
    sinks.write_corpus(ex, path)
    return spark.read.schema("instruction string, input string, output string").json(f"{path}/alpaca").groupBy("instruction").agg(F.count(F.lit(1)).alias("n"), F.max("output").alias("last_output"))


_ALPACA = "SELECT text AS instruction, count(*) AS n, max(annotation) AS last_output FROM page_annotations WHERE text IS NOT NULL AND annotation IS NOT NULL GROUP BY 1"


def snk_audit(spark: SparkSession, root: str) -> DataFrame:
    """SNK08, MSC08: two sessions' steps appended to one audit table, counted by step."""
    path = scratch_path(spark, "audit")
    steps = table(spark, root, "page_annotations").select(F.coalesce("pattern", F.lit("")).alias("step"))
    for session in (1, 2):
        sinks.append_audit(steps.withColumn("session", F.lit(session)), path)
    return spark.read.parquet(path).filter("written_at IS NOT NULL").groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("session").alias("n_sessions"))


_AUDIT = "SELECT coalesce(pattern, '') AS step, 2 * count(*) AS n, 2 AS n_sessions FROM page_annotations GROUP BY 1"


def snk_vectors(spark: SparkSession, root: str) -> DataFrame:
    """SNK09: vectors kept under the key of their model and counts, and read back by the same key."""
    v, folder = table(spark, root, "embeddings"), scratch_path(spark, "vectors")
    counts = [v.count()]
    sinks.write_vectors(v, folder, "default", counts)
    return spark.read.parquet(f"{folder}/{sinks.vector_cache_key('default', counts)}").select("vec_id", F.size("embedding").alias("n"), F.round(F.element_at("embedding", 1).cast("double"), 5).alias("first"))


_VECTORS = "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, round(embedding[1]::DOUBLE, 5) AS first FROM embeddings"


def flt_section_similarity(spark: SparkSession, root: str) -> DataFrame:
    """FLT04: section headers that are no question of the same document in other dress (similarity under 0.8)."""
    items = parse.tagged(table(spark, root, "documents"), "doc_id", "text").select("doc_id", "pos", "tag", F.lower("text").alias("t"))
    heads, asked = items.filter("tag = '<SH>'").select("doc_id", "pos", "t"), items.filter("tag = '<Q>'").select("doc_id", F.col("t").alias("q")).distinct()
    # Texts whose lengths differ too much cannot be that similar.
    near = heads.join(asked, "doc_id").filter(F.least(F.length("t"), F.length("q")) >= 0.8 * F.greatest(F.length("t"), F.length("q"))).filter(tx.edit_ratio(F.col("t"), F.col("q")) >= 0.8)
    return heads.join(near.select("doc_id", "pos").distinct(), ["doc_id", "pos"], "left_anti").select("doc_id", "pos", F.col("t").alias("section"))


_SECTIONS = _TAGGED + """, h AS (SELECT doc_id, pos, lower(text) AS t FROM items WHERE tag = '<SH>'), q AS (SELECT DISTINCT doc_id, lower(text) AS q FROM items WHERE tag = '<Q>')
SELECT doc_id, pos, t AS section FROM h WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.doc_id = h.doc_id AND CASE WHEN greatest(length(t), length(q.q)) = 0 THEN 1 ELSE 1 - levenshtein(t, q.q) / greatest(length(t), length(q.q))::DOUBLE END >= 0.8)"""


def ret_details(spark: SparkSession, root: str) -> DataFrame:
    """RET06, RET21, RET22: search details of each domain: its best variables, the size and first term of the codelist of
    each, and the rank among variables that have one."""
    best = ret_tfidf_variables(spark, root)
    t = table(spark, root, "ct_terms").groupBy("codelist_code").agg(F.count(F.lit(1)).alias("n_terms"), F.min("submission_value").alias("first_term"))
    v = table(spark, root, "sdtm_variables").select("variable_row", "var_name", "codelist_code")
    return best.join(v, "variable_row").join(t, "codelist_code", "left").select("query_id", "rank", "var_name", "score", F.coalesce("n_terms", F.lit(0)).alias("n_terms"), "first_term")


_DETAILS = _TFV.replace("SELECT * FROM (SELECT *, row_number()", ", best AS (SELECT * FROM (SELECT *, row_number()") + """), tt AS (SELECT codelist_code, count(*) AS n_terms, min(submission_value) AS first_term FROM ct_terms GROUP BY 1)
SELECT query_id, rank, s.var_name, best.score, coalesce(n_terms, 0) AS n_terms, first_term FROM best JOIN sdtm_variables s USING (variable_row) LEFT JOIN tt ON tt.codelist_code = s.codelist_code"""


def ret_rules_of_domain(spark: SparkSession, root: str) -> DataFrame:
    """RET21, MSC14: the rules that bear on what each study domain's annotations look like, at most three a domain,
    those about the most values first."""
    r = spark.createDataFrame(RULES, "rule_id string, severity string, p string, must string, wording string").select("rule_id", "p", "wording")
    n = _values(spark, root).select(F.substring("v", 1, 2).alias("prefix"), "p").groupBy("prefix", "p").agg(F.count(F.lit(1)).alias("score")).join(F.broadcast(r), "p")
    return retrieve.top_k(n.select("prefix", "rule_id", "wording", "score"), "prefix", "rule_id", 3)


_RULES_OF = _VALUES + f""", r(rule_id, p, wording) AS (VALUES {", ".join(str((a, c, e)) for a, _, c, _, e in RULES)}), n AS (SELECT substring(v, 1, 2) AS prefix, rule_id, wording, count(*) AS score FROM v JOIN r USING (p) GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY score DESC, rule_id) AS rank FROM n) WHERE rank <= 3"""

QUERIES = {f.__name__: f for f in (src_boxes, src_csv, src_gold_files, src_variable_files, src_alpaca, snk_audit, snk_vectors, flt_section_similarity, ret_details, ret_rules_of_domain)}

ORACLES = {
    "src_boxes": _BOX, "src_csv": _CSV, "src_gold_files": _GOLD, "src_variable_files": _VARFILES, "src_alpaca": _ALPACA, "snk_audit": _AUDIT, "snk_vectors": _VECTORS, "flt_section_similarity": _SECTIONS,
    "ret_details": _DETAILS, "ret_rules_of_domain": _RULES_OF,
}
