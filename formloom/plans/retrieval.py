"""Queries of ranked retrieval. The dictionary's domain names are asked of all documents; stated
sets of vectors are those whose id is divisible by 50."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom import hooks
from formloom.catalog import spread, table
from formloom.functions import text as tx
from formloom.operators import retrieve
from formloom.session import materialise


def _index(spark, root):
    return retrieve.TextIndex(spread(table(spark, root, "documents").select("doc_id", "text")), "doc_id", tx.tokens(F.coalesce("text", F.lit("")), 3))


def _queries(spark, root):
    return table(spark, root, "sdtm_domains").select(F.col("domain_row").alias("query_id"), "domain_code", "domain_name")


def _terms(spark, root):
    return retrieve.query_terms(_queries(spark, root), "query_id", tx.tokens(F.col("domain_name"), 3))


_BM25 = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: length(x) >= 3) AS w FROM documents),
len AS (SELECT doc_id, len(w) AS dl FROM d),
st AS (SELECT count(*) AS n, avg(dl) AS adl FROM len),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL),
t AS (SELECT term, count(*) AS df, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf0, n FROM p, st GROUP BY term, n),
a AS (SELECT avg(idf0) AS aidf FROM t),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT domain_row AS query_id, unnest(list_filter(regexp_split_to_array(lower(domain_name), '[^a-z0-9]+'), lambda x: length(x) >= 3)) AS term FROM sdtm_domains) GROUP BY ALL),
bm AS (SELECT query_id, doc_id, round(sum(qtf * CASE WHEN idf0 < 0 THEN 0.25 * aidf ELSE idf0 END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / adl))), 4) AS score
  FROM q JOIN t USING (term) JOIN p USING (term) JOIN len USING (doc_id), a, st GROUP BY ALL)"""
_RANK = "SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {0}"


def ret_bm25_topk(spark: SparkSession, root: str) -> DataFrame:
    """MTH03, TOP01, RET02: ten best documents of each domain name."""
    return retrieve.top_k(retrieve.bm25(_index(spark, root), _terms(spark, root), "query_id"), "query_id", "doc_id", 10)


def ret_tfidf_topk(spark: SparkSession, root: str) -> DataFrame:
    """MTH04, TOP03: the same by TF-IDF cosine."""
    return retrieve.top_k(retrieve.tfidf(_index(spark, root), _terms(spark, root), "query_id"), "query_id", "doc_id", 10)


_TFIDF = _BM25 + """,
w AS (SELECT term, ln((1.0 + n) / (1 + df)) + 1 AS idf FROM t),
dn AS (SELECT doc_id, sqrt(sum(tf * idf * tf * idf)) AS dn FROM p JOIN w USING (term) GROUP BY 1),
qn AS (SELECT query_id, sqrt(sum(qtf * idf * qtf * idf)) AS qn FROM q JOIN w USING (term) GROUP BY 1),
s AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * idf) / (any_value(dn) * any_value(qn)), 4) AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN dn USING (doc_id) JOIN qn USING (query_id) GROUP BY ALL)
SELECT * FROM (""" + _RANK.format("s") + ") WHERE rank <= 10"


def _vectors(spark, root):
    return table(spark, root, "embeddings").select("vec_id", "embedding")


def ret_dense_topk(spark: SparkSession, root: str) -> DataFrame:
    """MTH02, UDF05: ten nearest vectors of each vector of the stated set."""
    v = _vectors(spark, root)
    q = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q_vec"))
    return retrieve.top_k(retrieve.dense(q, "query_id", "q_vec", v, "vec_id", "embedding", 10)[0], "query_id", "vec_id", 10)


_DENSE = """SELECT * FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM
 (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)) WHERE rank <= 10"""


def _hybrid(spark, root, k, alpha=0.6):
    """Domain names against all documents, by BM25 and by vectors of the default encoder."""
    docs = spread(table(spark, root, "documents").select("doc_id", "text"))
    words = tx.tokens(F.coalesce("text", F.lit("")), 3)
    vectors = materialise(retrieve.text_vectors(docs, "doc_id", words), "document-vectors")
    q = materialise(retrieve.text_vectors(_queries(spark, root), "query_id", tx.tokens(F.col("domain_name"), 3)), "query-vectors")
    sparse = materialise(retrieve.bm25(retrieve.TextIndex(docs, "doc_id", words), _terms(spark, root), "query_id"), "bm25-scores")
    return retrieve.hybrid(q, "query_id", "vec", vectors, "doc_id", "vec", sparse, docs.count(), alpha, k)


_HYBRID = _BM25 + """,
nd AS (SELECT n FROM st),
dv AS (SELECT doc_id, ('0x' || substring(md5(term), 1, 4))::INT % 64 AS b, sum(tf) AS x FROM p GROUP BY ALL), qv AS (SELECT query_id, ('0x' || substring(md5(term), 1, 4))::INT % 64 AS b, sum(qtf) AS x FROM q GROUP BY ALL),
dl2 AS (SELECT doc_id, sqrt(sum(x * x)) AS nrm FROM dv GROUP BY 1), ql2 AS (SELECT query_id, sqrt(sum(x * x)) AS nrm FROM qv GROUP BY 1),
dt AS (SELECT query_id, doc_id, sum(qv.x * dv.x) AS dot FROM qv JOIN dv USING (b) GROUP BY ALL),
dn AS (SELECT query_id, doc_id, round(coalesce(dot, 0) / (ql2.nrm * dl2.nrm), 4) AS score FROM ql2 CROSS JOIN dl2 LEFT JOIN dt USING (query_id, doc_id)),
mm1 AS (SELECT query_id, doc_id, score, count(*) OVER w < n AS zero, min(score) OVER w AS lo, max(score) OVER w AS hi FROM dn, nd WINDOW w AS (PARTITION BY query_id)),
mm2 AS (SELECT query_id, doc_id, score, count(*) OVER w < n AS zero, min(score) OVER w AS lo, max(score) OVER w AS hi FROM bm, nd WINDOW w AS (PARTITION BY query_id)),
n1 AS (SELECT query_id, doc_id, CASE WHEN zero THEN least(lo, 0) ELSE lo END AS lo, CASE WHEN zero THEN greatest(hi, 0) ELSE hi END AS hi, score FROM mm1),
n2 AS (SELECT query_id, doc_id, CASE WHEN zero THEN least(lo, 0) ELSE lo END AS lo, CASE WHEN zero THEN greatest(hi, 0) ELSE hi END AS hi, score FROM mm2),
s1 AS (SELECT query_id, doc_id, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1 END AS v FROM n1),
s2 AS (SELECT query_id, doc_id, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1 END AS v FROM n2),
hy AS (SELECT query_id, doc_id, round(0.6::DOUBLE * coalesce(s1.v, 0) + 0.4::DOUBLE * coalesce(s2.v, 0), 6) AS score FROM s1 FULL JOIN s2 USING (query_id, doc_id)),
cand AS (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS dr FROM dn) WHERE dr <= 50 UNION ALL BY NAME SELECT query_id, doc_id, NULL AS dr FROM bm),
hc AS (SELECT hy.* FROM hy JOIN (SELECT DISTINCT query_id, doc_id FROM cand) USING (query_id, doc_id))"""


def ret_hybrid(spark: SparkSession, root: str) -> DataFrame:
    """RET01, RET02, RET03, WIN06, RET05: vectors and BM25 normalised over the whole corpus and mixed."""
    return retrieve.top_k(_hybrid(spark, root, 20), "query_id", "doc_id", 20)


def ret_margin_gate(spark: SparkSession, root: str) -> DataFrame:
    """FLT06, WIN07, SEL12: the lead of the first over the second, and whether it decides."""
    return retrieve.margin(_hybrid(spark, root, 2), "query_id", "doc_id", 0.05)


def ret_rerank_cut(spark: SparkSession, root: str) -> DataFrame:
    """RET04, TOP02, TOP05, TOP06, UDF06: a pool of 40 scored by the default reranker, lifted by language and source,
    cut to 10."""
    pool = retrieve.top_k(_hybrid(spark, root, 40), "query_id", "doc_id", 40).select("query_id", "doc_id")
    docs = table(spark, root, "documents").select("doc_id", "text", "lang", "source")
    j = pool.join(docs, "doc_id").join(_queries(spark, root), "query_id")
    j = j.select("query_id", "doc_id", "lang", "source", hooks.shared_words(F.col("domain_name"), F.coalesce("text", F.lit(""))).alias("score"))
    return retrieve.top_k(retrieve.boosted(j, [(F.col("lang") == "en", 1.3), (F.col("source") == "edc_export_main", 1.5)]).select("query_id", "doc_id", "score"), "query_id", "doc_id", 10)


def ret_spill_over(spark: SparkSession, root: str) -> DataFrame:
    """FLT07: of all documents that share a word with a query or are among its 50 nearest, all in the target
    language, and of the others a bounded share."""
    j = _hybrid(spark, root, 50).join(table(spark, root, "documents").select("doc_id", "lang"), "doc_id")
    return retrieve.spill_over(j, "query_id", "doc_id", F.coalesce(F.col("lang") == "en", F.lit(False))).select("query_id", "doc_id", "score", "in_target")


def ret_link_score(spark: SparkSession, root: str) -> DataFrame:
    """RET07: variables linked to domain, codelist and relationships, scored by weighted parts and bonuses."""
    v = table(spark, root, "sdtm_variables").filter("deleted_at IS NULL").select("var_name", "domain_code", "role", "codelist_code", "core").distinct()
    d = table(spark, root, "sdtm_domains").filter("deleted_at IS NULL").select("domain_code").distinct().withColumn("_d", F.lit(1.0))
    t = table(spark, root, "ct_terms").groupBy("codelist_code").agg(F.count(F.lit(1)).alias("n_terms"))
    u = table(spark, root, "ct_relationships").groupBy(F.upper(F.trim("variable_name")).alias("var_name"), F.upper(F.trim("domain_code")).alias("domain_code")).agg(F.count(F.lit(1)).alias("uses"))
    j = v.join(d, "domain_code", "left").join(t, "codelist_code", "left").join(u, ["var_name", "domain_code"], "left")
    stem = F.expr("substring(var_name, 3)")
    parts = {
        "var": F.coalesce("uses", F.lit(0)) / 20.0,
        "ct": F.coalesce("n_terms", F.lit(0)) / 15.0,
        "domain": F.coalesce("_d", F.lit(0.0)),
        "shape": F.when(stem.isin("RSLT", "TRT"), 0.7).when(stem.isin("BEGD", "ENDT"), 0.8).when(stem.isin("TSTC", "TSTN"), 0.3).otherwise(0.0) + F.when(F.col("role").isin("Timing", "Result"), 1.0).when(F.col("role") == "Topic", 0.5).otherwise(0.0),
    }
    score = retrieve.link_score(parts, {"var": 0.45, "ct": 0.25, "domain": 0.20, "shape": 0.10}, F.when(F.col("core") == "Req", 0.7).otherwise(0.0))
    return j.withColumn("score", score).select("var_name", "domain_code", "codelist_code", "role", "core", "score")


_LINK = """WITH v AS (SELECT DISTINCT var_name, domain_code, role, codelist_code, core FROM sdtm_variables WHERE deleted_at IS NULL),
d AS (SELECT DISTINCT domain_code, 1.0 AS d FROM sdtm_domains WHERE deleted_at IS NULL), t AS (SELECT codelist_code, count(*) AS n FROM ct_terms GROUP BY 1),
u AS (SELECT upper(trim(variable_name, ' ')) AS var_name, upper(trim(domain_code, ' ')) AS domain_code, count(*) AS uses FROM ct_relationships GROUP BY ALL),
j AS (SELECT v.*, d.d, t.n, u.uses, substring(v.var_name, 3) AS stem FROM v LEFT JOIN d USING (domain_code) LEFT JOIN t ON v.codelist_code = t.codelist_code LEFT JOIN u ON u.var_name = v.var_name AND u.domain_code = v.domain_code)
SELECT var_name, domain_code, codelist_code, role, core, round(CASE WHEN core = 'Req' THEN 0.7::DOUBLE ELSE 0 END + 0.45::DOUBLE * least(1.0, coalesce(uses, 0) / 20.0) + 0.25::DOUBLE * least(1.0, coalesce(n, 0) / 15.0) + 0.20::DOUBLE * coalesce(d, 0)
 + 0.10::DOUBLE * least(1.0, CASE WHEN stem IN ('RSLT', 'TRT') THEN 0.7 WHEN stem IN ('BEGD', 'ENDT') THEN 0.8 WHEN stem IN ('TSTC', 'TSTN') THEN 0.3 ELSE 0 END + CASE WHEN role IN ('Timing', 'Result') THEN 1.0 WHEN role = 'Topic' THEN 0.5 ELSE 0 END), 4) AS score FROM j"""

QUERIES = {f.__name__: f for f in (ret_bm25_topk, ret_tfidf_topk, ret_dense_topk, ret_hybrid, ret_margin_gate, ret_rerank_cut, ret_spill_over, ret_link_score)}

ORACLES = {
    "ret_bm25_topk": _BM25 + " SELECT * FROM (" + _RANK.format("bm") + ") WHERE rank <= 10",
    "ret_tfidf_topk": _TFIDF,
    "ret_dense_topk": _DENSE,
    "ret_hybrid": _HYBRID + " SELECT * FROM (" + _RANK.format("hy") + ") WHERE rank <= 20",
    "ret_margin_gate": _HYBRID + ", r AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS s2 FROM hy WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, doc_id)) SELECT query_id, doc_id, score, round(score - coalesce(s2, 0), 4) AS lead, s2 IS NULL OR round(score - coalesce(s2, 0), 4) >= 0.05 AS decided FROM r WHERE rn = 1",
    "ret_rerank_cut": _HYBRID + ", pool AS (SELECT * FROM (" + _RANK.format("hy") + ") WHERE rank <= 40), tk AS (SELECT query_id, pool.doc_id, lang, source, list_distinct(list_filter(regexp_split_to_array(lower(g.domain_name), '[^a-z0-9]+'), lambda x: length(x) >= 1)) AS qw, regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+') AS dw FROM pool JOIN documents USING (doc_id) JOIN sdtm_domains g ON g.domain_row = query_id), b AS (SELECT query_id, doc_id, round(CASE WHEN len(qw) > 0 THEN len(list_intersect(qw, dw)) / len(qw)::DOUBLE ELSE 0 END * CASE WHEN lang = 'en' THEN 1.3::DOUBLE ELSE 1.0 END * CASE WHEN source = 'edc_export_main' THEN 1.5::DOUBLE ELSE 1.0 END, 8) AS score FROM tk) SELECT * FROM (" + _RANK.format("b") + ") WHERE rank <= 10",
    "ret_spill_over": _HYBRID + ", g AS (SELECT query_id, hc.doc_id, score, coalesce(lang = 'en', false) AS in_target FROM hc JOIN documents USING (doc_id)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, in_target ORDER BY score DESC, doc_id) AS rn, count(*) OVER (PARTITION BY query_id) AS n FROM g) SELECT query_id, doc_id, score, in_target FROM r WHERE in_target OR rn <= greatest(5, floor(n * 0.1))",
    "ret_link_score": _LINK,
}
