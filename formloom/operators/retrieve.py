"""Ranked retrieval: BM25, TF-IDF and vectors, normalised, mixed, cut, boosted and linked.

Scores come from joins of query terms with postings and the corpus statistics, so only documents
that share a term with a query are touched; documents without any have score zero and are dealt
with by their count, not by a grid of all queries and documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from formloom.operators.aggregate import postings

#: Scores are rounded so that ranks do not hang on the order of floating-point sums.
DIGITS = 4


class TextIndex:
    """Postings and statistics of a corpus: p (term, doc, tf), lengths (doc, dl), terms (term, df), and
    the totals n_docs, avg_dl, avg_idf as a one-row table."""

    def __init__(self, docs: DataFrame, doc: str, words: Column):
        from formloom.session import materialise

        self.doc = doc
        self.p = materialise(postings(docs, doc, words), "postings")
        self.lengths = self.p.groupBy(doc).agg(F.sum("tf").alias("dl"))
        stats = docs.agg(F.count(F.lit(1)).alias("n_docs")).crossJoin(self.p.agg(F.sum("tf").alias("_all")))  # one row each
        stats = stats.select("n_docs", (F.col("_all") / F.col("n_docs")).alias("avg_dl"))
        df = self.p.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        self.terms = materialise(df.crossJoin(F.broadcast(stats)).withColumn("idf0", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)), "terms")
        self.stats = stats.crossJoin(self.terms.agg(F.avg("idf0").alias("avg_idf")))  # one row each


def query_terms(queries: DataFrame, q: str, words: Column) -> DataFrame:
    """(q, term, qtf); repeated words of a query count each time."""
    return queries.select(F.col(q), F.explode(words).alias("term")).groupBy(q, "term").agg(F.count(F.lit(1)).alias("qtf"))


def bm25(index: TextIndex, qterms: DataFrame, q: str, k1: float = 1.5, b: float = 0.75, eps: float = 0.25) -> DataFrame:
    """(q, doc, score) of every document that shares a term with a query. A term in more than half of
    all documents gets ``eps`` of the mean idf instead of its negative one."""
    s = F.broadcast(index.stats.select(F.col("avg_dl").alias("_adl"), F.col("avg_idf").alias("_aidf")))
    idf = index.terms.join(qterms.select("term").distinct(), "term", "left_semi").crossJoin(s).select("term", F.when(F.col("idf0") < 0, eps * F.col("_aidf")).otherwise(F.col("idf0")).alias("idf"), F.col("_adl"))
    hit = qterms.join(idf, "term").join(index.p, "term").join(index.lengths, index.doc)
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("_adl")))
    return hit.groupBy(q, index.doc).agg(F.round(F.sum(part), DIGITS).alias("score"))


def tfidf(index: TextIndex, qterms: DataFrame, q: str) -> DataFrame:
    """(q, doc, score): cosine of tf * smooth idf vectors."""
    w = index.terms.select("term", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    d = index.p.join(w, "term").withColumn("x", F.col("tf") * F.col("idf"))
    dn = d.groupBy(index.doc).agg(F.sqrt(F.sum(F.col("x") ** 2)).alias("dn"))
    qx = qterms.join(w, "term").withColumn("y", F.col("qtf") * F.col("idf"))
    qn = qx.groupBy(q).agg(F.sqrt(F.sum(F.col("y") ** 2)).alias("qn"))
    dots = qx.select(q, "term", "y").join(d.select("term", index.doc, "x"), "term").groupBy(q, index.doc).agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    return dots.join(dn, index.doc).join(qn, q).select(q, index.doc, F.round(F.col("dot") / (F.col("dn") * F.col("qn")), DIGITS).alias("score"))


def text_vectors(docs: DataFrame, doc: str, words: Column, size: int = 64, encode=None) -> DataFrame:
    """(doc, vec): a vector of each document by ``encode`` (lists of words to a matrix), by default counts of words
    hashed to ``size`` slots. Null texts and texts without words get null."""
    kind = docs.schema[doc].dataType.simpleString()

    def run(batches):
        slot: dict[str, int] = {}

        def counts(texts):
            out = np.zeros((len(texts), size), np.float32)
            for i, ws in enumerate(texts):
                at = []
                for w in ws:
                    n = slot.get(w)
                    if n is None:
                        if len(slot) > 500_000:
                            slot.clear()
                        n = slot[w] = int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % size
                    at.append(n)
                if at:
                    out[i] = np.bincount(at, minlength=size)
            return out

        for batch in batches:
            texts = batch.column(1).to_pylist()
            mat = (encode or counts)([t or [] for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.tolist() if t else None for t, m in zip(texts, mat)], pa.list_(pa.float32()))], names=[doc, "vec"])

    return docs.select(doc, words.alias("_w")).mapInArrow(run, f"`{doc}` {kind}, vec array<float>")


def dense(queries: DataFrame, q: str, q_vec: str, docs: DataFrame, doc: str, d_vec: str, k: int, block: int = 4096, others_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """Cosines of every query of a stated set with every vector: the ``k`` best of each query as (q, doc, score),
    ties by the smaller document, and (q, n, lo, hi) over all of them.

    The queries are sent out in blocks of at most ``block`` vectors, and the vectors stream past each
    block as matrix products; a batch sends on its ``k`` best and its bounds only. With ``others_only``
    a vector is not held against the query of its own id. Null vectors, vectors of another length and
    of norm 0 give nothing.
    """
    from formloom.session import materialise

    spark = docs.sparkSession
    types = (queries.schema[q].dataType.simpleString(), docs.schema[doc].dataType.simpleString())
    arrow = (to_arrow_type(queries.schema[q].dataType), to_arrow_type(docs.schema[doc].dataType))
    schema = f"q {types[0]}, d {types[1]}, s double, n bigint, lo double, hi double"
    out, held = None, []

    def against(rows: list) -> DataFrame:
        ids = np.asarray([r[0] for r in rows])
        mat = np.asarray([r[1] for r in rows], float)
        mat /= np.linalg.norm(mat, axis=1, keepdims=True)
        sent = spark.sparkContext.broadcast((ids, mat))

        def run(batches):
            own_ids, own = sent.value
            for batch in batches:
                keep = [(i, v) for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if v is not None and len(v) == own.shape[1] and any(v)]
                if not keep:
                    continue
                m = np.asarray([v for _, v in keep], float)
                m /= np.linalg.norm(m, axis=1, keepdims=True)
                d = np.asarray([i for i, _ in keep])
                scores = np.round(m @ own.T, DIGITS)
                qs, ds, ss, ns, los, his = [], [], [], [], [], []
                for j, qid in enumerate(own_ids.tolist()):
                    x, at = scores[:, j], d
                    if others_only:
                        x, at = x[d != qid], d[d != qid]
                    if not x.size:
                        continue
                    least = np.partition(x, -k)[-k] if x.size > k else x.min()
                    c = np.flatnonzero(x >= least)
                    c = c[np.lexsort((at[c], -x[c]))[:k]]
                    qs += [qid] * (c.size + 1)
                    ds += at[c].tolist() + [None]
                    ss += x[c].tolist() + [None]
                    ns += [None] * c.size + [x.size]
                    los += [None] * c.size + [float(x.min())]
                    his += [None] * c.size + [float(x.max())]
                yield pa.RecordBatch.from_arrays([pa.array(qs, arrow[0]), pa.array(ds, arrow[1]), pa.array(ss, pa.float64()), pa.array(ns, pa.int64()), pa.array(los, pa.float64()), pa.array(his, pa.float64())], names=["q", "d", "s", "n", "lo", "hi"])

        return docs.select(doc, d_vec).mapInArrow(run, schema)

    good = queries.filter(F.col(q_vec).isNotNull() & F.exists(q_vec, lambda x: x != 0)).select(q, q_vec)
    for row in good.toLocalIterator():
        held.append((row[0], row[1]))
        if len(held) == block:
            out, held = (against(held) if out is None else out.unionByName(against(held))), []
    if held:
        out = against(held) if out is None else out.unionByName(against(held))
    found = materialise(out if out is not None else spark.createDataFrame([], schema), "dense-scores")
    best = found.filter("n IS NULL").select(F.col("q").alias(q), F.col("d").alias(doc), F.col("s").alias("score"))
    bounds = found.filter("n IS NOT NULL").groupBy(F.col("q").alias(q)).agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return top_k(best, q, doc, k).drop("rank"), bounds


def pair_scores(pairs: DataFrame, queries: DataFrame, q: str, q_vec: str, vectors: DataFrame, doc: str, d_vec: str, block: int = 4096) -> DataFrame:
    """(q, doc, score): cosines of stated pairs (q, doc). The queries of a document, at most the stated ones, are
    gathered and joined with its vector; queries go out in blocks. Null vectors and those of norm 0 give nothing."""
    spark = pairs.sparkSession
    types = (queries.schema[q].dataType.simpleString(), vectors.schema[doc].dataType.simpleString())
    arrow = (to_arrow_type(queries.schema[q].dataType), to_arrow_type(vectors.schema[doc].dataType))
    of_doc = pairs.groupBy(doc).agg(F.collect_list(q).alias("_qs")).join(vectors.filter(F.col(d_vec).isNotNull()).select(doc, F.col(d_vec).alias("_v")), doc).select(doc, "_qs", "_v")
    out, held = None, []

    def against(rows: list) -> DataFrame:
        mat = np.asarray([r[1] for r in rows], float)
        sent = spark.sparkContext.broadcast(({r[0]: i for i, r in enumerate(rows)}, mat / np.linalg.norm(mat, axis=1, keepdims=True)))

        def run(batches):
            at, own = sent.value
            for batch in batches:
                m = np.asarray(batch.column(2).to_pylist(), float).reshape(batch.num_rows, -1)
                norm = np.linalg.norm(m, axis=1)
                lists = batch.column(1).to_pylist()
                flat = [(i, x, at[x]) for i, qs in enumerate(lists) for x in qs if x in at and norm[i] > 0]
                i, j = np.asarray([f[0] for f in flat], np.int64), np.asarray([f[2] for f in flat], np.int64)
                scores = np.round(np.einsum("ij,ij->i", m[i] / norm[i][:, None], own[j]), DIGITS) if flat else np.zeros(0)
                yield pa.RecordBatch.from_arrays([pa.array([f[1] for f in flat], arrow[0]), batch.column(0).take(pa.array(i)).cast(arrow[1]), pa.array(scores)], names=[q, doc, "score"])

        return of_doc.mapInArrow(run, f"`{q}` {types[0]}, `{doc}` {types[1]}, score double")

    good = queries.filter(F.col(q_vec).isNotNull() & F.exists(q_vec, lambda x: x != 0)).select(q, q_vec)
    for row in good.toLocalIterator():
        held.append((row[0], row[1]))
        if len(held) == block:
            out, held = (against(held) if out is None else out.unionByName(against(held))), []
    if held:
        out = against(held) if out is None else out.unionByName(against(held))
    return out if out is not None else spark.createDataFrame([], f"`{q}` {types[0]}, `{doc}` {types[1]}, score double")


def hybrid(queries: DataFrame, q: str, q_vec: str, vectors: DataFrame, doc: str, d_vec: str, sparse: DataFrame, n_docs: int, alpha: float, k: int) -> DataFrame:
    """(q, doc, score): alpha * dense + (1 - alpha) * sparse, each scaled to 0..1 over the whole corpus, of every
    document with a sparse score and of the ``k`` best by vectors. The best ``k`` of all documents are among
    these: one without a sparse score stands behind ``k`` that are at least as near by vectors."""
    best, bounds = dense(queries, q, q_vec, vectors, doc, d_vec, k, others_only=False)
    rest = sparse.select(q, doc).join(best, [q, doc], "left_anti")
    scored = best.unionByName(pair_scores(rest, queries, q, q_vec, vectors, doc, d_vec))
    own = sparse.groupBy(q).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi"))
    return mix(scale(scored, bounds, q, n_docs), scale(sparse, own, q, n_docs), q, doc, alpha)


def top_k(scored: DataFrame, q: str, doc: str, k: int, score: str = "score") -> DataFrame:
    """The k best of each query, ties by the smaller document."""
    w = Window.partitionBy(q).orderBy(F.col(score).desc(), F.col(doc))
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def scale(scored: DataFrame, bounds: DataFrame, q: str, n_docs: int, score: str = "score", name: str = "norm") -> DataFrame:
    """Scores of a query scaled to 0..1 by its ``bounds`` (q, n, lo, hi): documents without a score count as zero.
    Constant scores become 1."""
    some_zero = F.col("n") < n_docs
    b = bounds.select(q, F.when(some_zero, F.least("lo", F.lit(0.0))).otherwise(F.col("lo")).alias("_lo"), F.when(some_zero, F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi")).alias("_hi"))
    return scored.join(b, q).withColumn(name, F.when(F.col("_hi") > F.col("_lo"), (F.col(score) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(1.0)).drop("_lo", "_hi")


def min_max(scored: DataFrame, q: str, n_docs: int, score: str = "score", name: str = "norm") -> DataFrame:
    """``scale`` by the bounds of ``scored`` itself."""
    return scale(scored, scored.groupBy(q).agg(F.count(F.lit(1)).alias("n"), F.min(score).alias("lo"), F.max(score).alias("hi")), q, n_docs, score, name)


def mix(dense_norm: DataFrame, sparse_norm: DataFrame, q: str, doc: str, alpha: float) -> DataFrame:
    """alpha * dense + (1 - alpha) * sparse of the normalised scores; a missing side counts as 0."""
    a = dense_norm.select(q, doc, F.col("norm").alias("_d"))
    b = sparse_norm.select(q, doc, F.col("norm").alias("_s"))
    return a.join(b, [q, doc], "full").select(q, doc, F.round(alpha * F.coalesce("_d", F.lit(0.0)) + (1 - alpha) * F.coalesce("_s", F.lit(0.0)), 6).alias("score"))


def margin(ranked: DataFrame, q: str, doc: str, least: float, score: str = "score") -> DataFrame:
    """First of each query with its lead over the second, and whether the lead decides."""
    two = top_k(ranked.select(q, doc, score), q, doc, 2, score)
    w = Window.partitionBy(q).orderBy("rank")  # two rows a query
    rows = two.withColumn("_s2", F.lead(score).over(w)).filter("rank = 1").drop("rank")
    lead = F.round(F.col(score) - F.coalesce("_s2", F.lit(0.0)), DIGITS)
    return rows.select(q, doc, score, lead.alias("lead"), (F.col("_s2").isNull() | (lead >= least)).alias("decided"))


def spill_over(ranked: DataFrame, q: str, doc: str, in_target: Column, least: int = 5, share: float = 0.1, score: str = "score") -> DataFrame:
    """All candidates in target, and of the others the best max(least, share of all), ties by the smaller document.

    The cut of each query is found from the counts of its distinct scores, so only rows of the score
    at the cut are put in order."""
    t = ranked.withColumn("in_target", in_target)
    others = t.filter(~F.col("in_target"))
    counts = t.groupBy(q, score).agg(F.count(F.lit(1)).alias("_all"), F.sum((~F.col("in_target")).cast("long")).alias("_n"))
    w = Window.partitionBy(q).orderBy(F.col(score).desc())  # rounded scores: a bounded number a query
    room = F.greatest(F.lit(least), F.floor(F.sum("_all").over(Window.partitionBy(q)) * share))
    cut = counts.withColumn("_left", room - (F.sum("_n").over(w) - F.col("_n"))).filter("_left > 0 AND _n > 0").select(q, score, "_n", "_left")
    near = others.join(cut, [q, score])
    tied = near.filter("_n > _left").withColumn("_r", F.row_number().over(Window.partitionBy(q, score).orderBy(doc))).filter("_r <= _left").select(t.columns)
    return t.filter("in_target").unionByName(near.filter("_n <= _left").select(t.columns)).unionByName(tied)


def boosted(scored: DataFrame, factors: list[tuple[Column, float]], score: str = "score", digits: int = 8) -> DataFrame:
    """Scores times the factor of each condition that holds."""
    s = F.col(score)
    for cond, f in factors:
        s = s * F.when(cond, f).otherwise(1.0)
    return scored.withColumn(score, F.round(s, digits))


def link_score(parts: dict[str, Column], weights: dict[str, float], extra: Column) -> Column:
    """Weighted sum of parts clipped to 0..1, plus an extra outside the weights."""
    s = extra
    for name, w in weights.items():
        s = s + w * F.greatest(F.lit(0.0), F.least(F.lit(1.0), parts[name]))
    return F.round(s, DIGITS)
