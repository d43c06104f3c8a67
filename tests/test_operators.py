import datetime as dt
import difflib
import json
import math
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from formloom import hooks
from formloom.functions import text as tx
from formloom.functions.fuzzy import sequence_ratio
from formloom.functions.vector import cosine
from formloom.operators import aggregate, corpus, joins, mapping, parse, retrieve
from formloom.sources import pages as src
from formloom.sources import seeds, sinks
from formloom.streaming import pages as stream

PAGE = """<INPUT> stray
<Q> Eligible? (INC1)
<INPUT> Yes
<INPUT> □ Other
<Q> Visit day
<INPUT> dd-mmm-yyyy
<INPUT> abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyz
<SH> Vitals | Pulse
<SH> Notes
<FORM> Screening"""


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_tagged_page(spark):
    items = parse.question_ids(parse.tagged(docs(spark, [(1, PAGE), (2, None), (3, ""), (4, "no tags"), (5, "<Q>")]), "doc_id", "text"), "doc_id", ["pos"])
    rows = {r.pos: r for r in items.filter("doc_id = 1").collect()}
    assert [rows[p].input_type for p in (1, 3, 4, 6, 7)] == ["text", "option", "option", "text", "free"]
    assert [rows[p].parent_qid for p in (1, 3, 4, 6)] == ["orphan", "q-000", "q-000", "q-001"]
    assert (rows[8].text, rows[8].below, rows[9].below) == ("Vitals", "Pulse", "none")
    assert items.filter("doc_id IN (2, 3, 4)").count() == 0
    assert items.filter("doc_id = 5").first().text == ""
    fields = {r.qid: r for r in parse.fields(items.filter("doc_id = 1"), "doc_id").collect()}
    assert (fields["q-000"].input_type, fields["q-000"].options, fields["q-000"].units) == ("radio", "Yes|□ Other", "INC1")
    assert fields["q-001"].input_type == "date"


def test_abort_words_drop_a_pass(spark):
    items = parse.tagged(docs(spark, [(1, "<SH> A\nSH_NOT_FOUND\n<Q> B"), (2, "<SH> A\nSH_NOT_FOUND so\n<Q> B")]), "doc_id", "text")
    assert sorted((r.doc_id, r.tag) for r in items.collect()) == [(1, "<Q>"), (2, "<Q>"), (2, "<SH>")]


def test_supplements(spark):
    d = docs(spark, [(1, "<Q> Pulse\nPulse rate note\nunrelated"), (2, "only\nlines"), (3, "<Q>\nany")])
    out = parse.supplements(parse.lines(d, "doc_id", "text"), parse.tagged(d, "doc_id", "text"), "doc_id")
    assert sorted((r.doc_id, r.line) for r in out.collect()) == [(1, "unrelated"), (2, "lines"), (2, "only")]


def test_salvage_and_prefix(spark):
    df = spark.createDataFrame([(1, 'so: {"qid": "q", "seq": 2} end'), (2, "{broken"), (3, None), (4, "none")], "i int, t string")
    got = {r.i: r.r for r in df.select("i", parse.salvage_json(F.col("t"), "qid string, seq bigint").alias("r")).collect()}
    assert got[1].qid == "q" and got[3] is None and got[4] is None
    p = spark.createDataFrame([("X: a\r\nDOMAIN:  AE \nY: b",), ("DOMAIN:",), (None,)], "t string").select(parse.prefixed(F.col("t"), "DOMAIN").alias("d"))
    assert [r.d for r in p.collect()] == ["AE", None, None]


def test_asof_against_brute_force(spark):
    rng = random.Random(5)
    base = dt.datetime(2024, 1, 1)
    left = [(i, "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None]), base + dt.timedelta(hours=rng.randint(0, 3000)) if rng.random() < 0.95 else None) for i in range(300)]
    right = [(i, rng.choice(["hot", "hot", "a", None]), base + dt.timedelta(hours=rng.randint(0, 3000))) for i in range(120)]
    l = spark.createDataFrame(left, "id int, k string, t timestamp_ntz")
    r = spark.createDataFrame(right, "v int, k string, at timestamp_ntz")
    for bucket in ("month", "day", "year"):
        got = {x.id: x.v for x in joins.asof_backward(l, r, "k", "t", "at", ["v"], bucket).collect()}
        for i, k, t in left:
            before = [(at, v) for v, kk, at in right if k is not None and kk == k and t is not None and at <= t]
            assert got[i] == (max(before)[1] if before else None)
    assert joins.asof_backward(l.limit(0), r, "k", "t", "at", ["v"]).count() == 0
    assert joins.asof_backward(l, r.limit(0), "k", "t", "at", ["v"]).filter("v IS NOT NULL").count() == 0


def test_best_line_and_partial(spark):
    lines = spark.createDataFrame([(1, 1, "pulse rate of the left arm"), (1, 2, "pulse"), (2, 1, "pulse rate")], "p int, pos int, line string")
    items = spark.createDataFrame([(1, 10, "pulse rate"), (1, 11, "arm"), (1, 12, "foot"), (1, 13, "")], "p int, item int, text string")
    got = {r.item: (r.line_pos, r.score) for r in joins.best_line(items, lines, ["p"], "item", "text", "pos", "line").collect()}
    assert got == {10: (1, 2), 11: (1, 1), 12: (None, 0), 13: (None, 0)}
    e = spark.createDataFrame([(1, "Arm"), (2, "Left Arm"), (3, "arm")], "o int, e string")
    q = spark.createDataFrame([(1, "the left arm"), (2, "arm"), (3, "farm"), (4, None), (5, "")], "id int, q string")
    got = {r.id: (r.entry, r.how) for r in joins.exact_then_partial(q, "id", "q", e, "o", "e").collect()}
    assert got == {1: ("Arm", "partial"), 2: ("arm", "exact"), 3: (None, None), 4: (None, None), 5: (None, None)}
    assert joins.exact_then_partial(q, "id", "q", e.limit(0), "o", "e").filter("entry IS NOT NULL").count() == 0


def test_division_and_inject(spark):
    df = spark.createDataFrame([("x", "a"), ("x", "b"), ("x", "a"), ("y", "a"), (None, "a")], "g string, m string")
    assert [r.g for r in joins.division(df, "g", "m", ["a", "b", "a"]).collect()] == ["x"]
    ranked = spark.createDataFrame([("q", "a", 1.0), ("q", "b", 3.0)], "k string, i string, score double")
    targets = spark.createDataFrame([("q", "a"), ("q", "c"), ("q", "c"), ("z", "a")], "k string, i string")
    assert sorted((r.i, r.score, r.injected) for r in joins.inject_missing(ranked, targets, "k", "i", "score").collect()) == [("a", 1.0, False), ("b", 3.0, False), ("c", 5.0, True)]


def test_fuzzy_ratio(spark):
    pairs = [("abc", "abd"), ("", ""), (None, "a"), ("WDSEVR", "wdsevr"), ("a" * 250, "a" * 240 + "b")]
    got = [r.s for r in spark.createDataFrame(pairs, "a string, b string").select(sequence_ratio("a", "b").alias("s")).collect()]
    assert got == [None if None in p else pytest.approx(difflib.SequenceMatcher(None, *p).ratio()) for p in pairs]


def test_text_functions(spark):
    df = spark.createDataFrame([("  A  b\tC (X1)", "[ ] ○ Yes"), (None, None), ("", "")], "t string, o string")
    r = df.select(tx.normal_space(F.col("t")).alias("n"), tx.trailing_code(F.col("t")).alias("c"), tx.bare_option(F.col("o")).alias("o"), tx.phrases(tx.tokens(F.col("t")), 3).alias("p")).collect()
    assert (r[0].n, r[0].c, r[0].o) == ("a b c (x1)", "X1", "Yes")
    assert set(r[0].p) == {"a", "b", "c", "x1", "a b", "b c", "c x1", "a b c", "b c x1"}
    assert r[1].n is None and r[2].n == "" and r[2].p == []


def test_outliers_qc_case(spark):
    df = spark.createDataFrame([("d", i, 10) for i in range(9)] + [("d", 9, 0)], "doc string, page int, n int")
    got = aggregate.outliers(df, ["doc"], "page", "n").collect()
    assert [(r.page, r.reasons) for r in got] == [(9, "statistical_outlier,zero,low")]
    assert aggregate.outliers(df.limit(0), ["doc"], "page", "n").count() == 0


def test_last_wins_and_three_way(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), (None, 1, "n")], "k string, o int, v string")
    assert {(r.k, r.v) for r in aggregate.last_wins(df, ["k"], "o").collect()} == {("a", "z"), (None, "n")}
    l, r = (spark.createDataFrame(x, "k string") for x in ([("a",), ("b",), ("a",)], [("b",), ("c",)]))
    assert {tuple(x) for x in aggregate.three_way(l, r, "k").collect()} == {("a", "left"), ("b", "both"), ("c", "right")}


def test_bm25_against_brute_force(spark):
    corpus_rows = [(1, "red barn red"), (2, "blue barn"), (3, "green mill by the river"), (4, ""), (5, None), (6, "barn barn mill")]
    d = docs(spark, corpus_rows)
    ix = retrieve.TextIndex(d, "doc_id", tx.tokens(F.coalesce("text", F.lit(""))))
    q = retrieve.query_terms(spark.createDataFrame([(1, "red barn barn"), (2, "nothing here")], "q int, t string"), "q", tx.tokens(F.col("t")))
    got = {(r.q, r.doc_id): r.score for r in retrieve.bm25(ix, q, "q").collect()}
    words = {i: (t or "").split() for i, t in corpus_rows}
    n, avg = len(words), sum(map(len, words.values())) / len(words)
    df = {}
    for w in words.values():
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in idf.items()}
    want = {}
    for i, w in words.items():
        s = [idf[t] * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / avg)) for t in "red barn barn".split() if t in w]
        if s:
            want[1, i] = round(sum(s), 4)
    assert got == pytest.approx(want, abs=2e-4)


def test_min_max_counts_absent_documents(spark):
    s = spark.createDataFrame([(1, 1, 2.0), (1, 2, 4.0), (2, 1, 3.0)], "q int, d int, score double")
    got = {(r.q, r.d): r.norm for r in retrieve.min_max(s, "q", 3).collect()}
    assert got == {(1, 1): 0.5, (1, 2): 1.0, (2, 1): 1.0}
    full = {(r.q, r.d): r.norm for r in retrieve.min_max(s, "q", 1).collect()}
    assert full[(2, 1)] == 1.0 and full[(1, 1)] == 0.0


def test_dense_blocks(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(30)] + [(99, None), (98, [0.0] * 4), (97, [1.0])]
    v = spark.createDataFrame(rows, "d int, v array<double>")
    q = v.filter("d % 5 = 0 AND d < 30").select(F.col("d").alias("q"), F.col("v").alias("qv"))
    a, bounds = retrieve.dense(q, "q", "qv", v, "d", "v", 100)
    a = {tuple(r) for r in a.collect()}
    b = {tuple(r) for r in retrieve.dense(q, "q", "qv", v, "d", "v", 100, block=2)[0].collect()}
    pairs = v.filter("d < 30").crossJoin(q).filter("q <> d").select("q", "d", F.round(cosine(F.col("qv"), F.col("v")), 4))
    want = {tuple(r) for r in pairs.collect()}
    assert a == b == want
    for r in bounds.collect():
        own = [s for x, _, s in want if x == r.q]
        assert (r.n, r.lo, r.hi) == (len(own), min(own), max(own))
    few = {tuple(r) for r in retrieve.dense(q, "q", "qv", v.repartition(5), "d", "v", 3)[0].collect()}
    assert few == {p for x in {q for q, _, _ in want} for p in sorted((p for p in want if p[0] == x), key=lambda p: (-p[2], p[1]))[:3]}


def test_hybrid_equals_all_pairs(spark):
    rng = random.Random(3)
    v = spark.createDataFrame([(i, [float(rng.randint(0, 3)) for _ in range(4)]) for i in range(60)], "d int, v array<double>")
    q = spark.createDataFrame([(i, [float(rng.randint(1, 3)) for _ in range(4)]) for i in range(3)], "q int, qv array<double>")
    sparse = spark.createDataFrame([(x, rng.randrange(60), round(rng.random(), 4)) for x in range(3) for _ in range(6)], "q int, d int, score double").dropDuplicates(["q", "d"])
    got = retrieve.top_k(retrieve.hybrid(q, "q", "qv", v, "d", "v", sparse, 60, 0.6, 5), "q", "d", 5).select("q", "d", "score")
    every = v.crossJoin(q).select("q", "d", F.round(cosine(F.col("qv"), F.col("v")), 4).alias("score")).filter("score IS NOT NULL")
    want = retrieve.top_k(retrieve.mix(retrieve.min_max(every, "q", 60), retrieve.min_max(sparse, "q", 60), "q", "d", 0.6), "q", "d", 5).select("q", "d", "score")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_overlapping_boxes(spark):
    rng = random.Random(5)
    box = lambda n, size: [(i, rng.randint(0, 2), *(lambda x, y: (x, y, x + rng.randint(0, size), y + rng.randint(0, size)))(rng.randint(0, 100), rng.randint(0, 300))) for i in range(n)]
    b, r = box(60, 30), box(40, 90)
    left = spark.createDataFrame([(i, p, *map(float, c)) for i, p, *c in b] + [(99, 1, None, 1.0, 2.0, 3.0)], "i int, page int, x0 double, y0 double, x1 double, y1 double")
    right = spark.createDataFrame([(i, p, *map(float, c)) for i, p, *c in r], "k int, page int, a0 double, b0 double, a1 double, b1 double")
    got = {(x.i, x.k): x.area for x in joins.overlapping(left, right, "page", ("x0", "y0", "x1", "y1"), ("a0", "b0", "a1", "b1"), 25.0).collect()}
    want = {}
    for i, p, x0, y0, x1, y1 in b:
        for k, p2, a0, b0, a1, b1 in r:
            wide, tall = min(x1, a1) - max(x0, a0), min(y1, b1) - max(y0, b0)
            if p == p2 and wide > 0 and tall > 0:
                want[i, k] = wide * tall
    assert got == want and len(got) > 10
    assert joins.overlapping(left.limit(0), right, "page", ("x0", "y0", "x1", "y1"), ("a0", "b0", "a1", "b1"), 25.0).count() == 0


def test_top_margin_spill(spark):
    s = spark.createDataFrame([(1, i, float(10 - i // 2)) for i in range(12)], "q int, d int, score double")
    assert [r.d for r in retrieve.top_k(s, "q", "d", 3).orderBy("rank").collect()] == [0, 1, 2]
    m = retrieve.margin(s, "q", "d", 0.1).first()
    assert (m.d, m.lead, m.decided) == (0, 0.0, False)
    kept = retrieve.spill_over(s, "q", "d", F.col("d") >= 10, least=2).collect()
    assert sorted(r.d for r in kept) == [0, 1, 10, 11]


def test_grammar(spark):
    vals = [("AETERM", "plain"), ("IEORRES when IETESTCD = INC1", "conditional"), ("AEOTH in SUPPAE", "supplemental"), ("[NOT SUBMITTED]", "not_submitted"), ("X = A, B", "none"), ("LBORRES = A, B", "with_term"), ("ieorres", "none"), ("", None), (None, None), (" AETERM ", "plain")]
    df = spark.createDataFrame([(i, v, "AE") for i, (v, _) in enumerate(vals)], "i int, annotation string, domain string")
    got = [r.p for r in df.orderBy("i").select(mapping.pattern_of(F.col("annotation")).alias("p")).collect()]
    assert got == [p for _, p in vals]


def test_corpus(spark):
    pats = [("direct", "plain"), ("conditional_single", "conditional"), ("direct, conditional_single", "conditional"), ("direct, variable_with_ct", "direct"), ("multiple_response_checkboxes, supplemental_multiple", "supplemental"), ("", None), (None, None)]
    df = spark.createDataFrame([(p,) for p, _ in pats], "p string")
    assert [r.c for r in df.select(corpus.canonical_pattern(F.col("p")).alias("c")).collect()] == [c for _, c in pats]
    rows = spark.createDataFrame([(i, "g" if i < 153 else None) for i in range(160)], "id int, g string")
    out = corpus.split(rows.filter("g = 'g'"), "g", "id", 0.05, "17")
    assert {r.split: r["count"] for r in out.groupBy("split").count().collect()} == {"validation": 7, "train": 146}
    assert corpus.split(rows.limit(0), "g", "id", 0.05, "17").count() == 0


def test_stream_equals_batch(spark, tmp_path):
    parts = [[(1, 1, "<FORM>", "F1"), (1, 2, "<Q>", "a"), (2, 1, "<Q>", "x")], [(1, 3, "<SH>", "S"), (1, 4, "<Q>", "b"), (2, 2, "<INPUT>", "y")]]
    folder = str(tmp_path / "in")
    for n, p in enumerate(parts):
        spark.createDataFrame(p, stream.ITEM_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    s = stream.carry_context(spark.readStream.schema(stream.ITEM_SCHEMA).parquet(folder))
    got = {tuple(r) for r in stream.run_to_end(s, str(tmp_path / "out"), str(tmp_path / "cp")).select("doc_id", "pos", "form", "section", "qid").collect()}
    whole = spark.createDataFrame([r for p in parts for r in p], stream.ITEM_SCHEMA)
    want = {tuple(r) for r in stream.carry_context_batch(whole).select("doc_id", "pos", "form", "section", "qid").collect()}
    assert got == want


def test_stream_windows(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    folder = str(tmp_path / "ev")
    spark.createDataFrame([(base + dt.timedelta(minutes=m), "u") for m in (0, 5, 70, 500)], "ts timestamp, u string").write.parquet(folder)
    ev = spark.readStream.schema("ts timestamp, u string").parquet(folder)
    t = stream.run_to_end(stream.tumbling(ev, "ts", "1 hour", "1 minute", ["u"]), str(tmp_path / "o1"), str(tmp_path / "c1"))
    assert {r.n for r in t.collect()} <= {1, 2}
    m = stream.run_to_end(stream.memo(ev, "u", "ts"), str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert m.count() == 1


def test_page_sources(spark, tmp_path):
    (tmp_path / "page_001.json").write_text(json.dumps({"page_id": 1, "items": [{"seq": 1, "tag": "<Q>", "text": "a"}, {"seq": 2, "tag": "<INPUT>", "text": "b", "bbox_xyxy": [0, 0, 1, 1]}]}))
    (tmp_path / "page_002.json").write_text("{broken")
    (tmp_path / "page_003_result.json").write_text(json.dumps({"page_id": 3, "annotations": [{"qid": "q", "text": "t", "annotation": "X", "confidence": 1, "option_annotations": {"Yes": "A"}}, {"qid": "r", "text": "", "annotation": "", "option_annotations": ["a"]}]}))
    rows = src.read_pages(spark, str(tmp_path), "page_00?.json").collect()
    assert sum(r.tag is not None for r in rows) == 2 and sum(r.broken is not None for r in rows) == 1
    gold = src.read_gold(spark, str(tmp_path))
    assert gold.count() == 2 and src.usable_gold(gold).count() == 1
    (tmp_path / "v1.json").write_text(json.dumps([{"domain": "AE", "name": "AETERM"}]))
    (tmp_path / "v2.json").write_text(json.dumps({"CM": [{"name": "CMTRT"}]}))
    assert {(r.domain, r.name) for f in ("v1", "v2") for r in src.read_variables(spark, str(tmp_path / f"{f}.json")).collect()} == {("AE", "AETERM"), ("CM", "CMTRT")}
    (tmp_path / "p.json").write_text("version https://git-lfs.github.com/spec/v1\n")
    assert src.first_readable([str(tmp_path / "none"), str(tmp_path / "p.json"), str(tmp_path / "v1.json")]) == str(tmp_path / "v1.json")
    assert src.first_readable([str(tmp_path / "none"), str(tmp_path / "p.json"), str(tmp_path / "v1.json")], spark) == str(tmp_path / "v1.json")


def test_cached_source(tmp_path):
    calls = []

    def fetch(e):
        calls.append(e)
        if len(calls) > 1:
            raise OSError("down")
        return {"n": len(calls)}

    s = src.CachedSource(str(tmp_path), fetch, pause=0)
    assert s.get("/a/b") == {"n": 1} and s.get("/a/b") == {"n": 1} and len(calls) == 1
    old = time.time() - 8 * 86400
    os.utime(tmp_path / "a_b.json", (old, old))
    assert s.get("/a/b") == {"n": 1} and len(calls) == 2
    assert src.CachedSource(str(tmp_path), None).get("/missing") is None


def test_sinks(spark, tmp_path):
    ex = spark.createDataFrame([("domain", "i1", "o1"), ("domain", "i2", "o2"), ("pattern", "i3", "o3")], "step string, instruction string, output string")
    sinks.write_corpus(ex, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c/alpaca")).count() == 3
    assert {(r.step, r.n) for r in spark.read.json(str(tmp_path / "c/metadata")).collect()} == {("domain", 2), ("pattern", 1)}
    assert not sinks.write_queue(ex, str(tmp_path / "q"), "step = 'none'") and not (tmp_path / "q").exists()
    assert sinks.write_queue(ex, str(tmp_path / "q"), "step = 'domain'")
    assert len(sinks.vector_cache_key("m", [1, 2])) == 12


def test_hooks(spark):
    df = spark.createDataFrame([(1, "Other, specify"), (2, None), (3, "Result of x")], "id int, p string")
    assert [r.a for r in hooks.generate(df, "p", "a").orderBy("id").collect()] == ["supplemental", "direct", "findings"]
    own = hooks.generate(df, "p", "a", load=lambda: lambda xs: [str(len(x or "")) for x in xs])
    assert [r.a for r in own.orderBy("id").collect()] == ["14", "0", "11"]
    v = df.select(hooks.hashed_vector(tx.tokens(F.coalesce("p", F.lit(""))), 8).alias("v")).collect()
    assert sum(v[0].v) == 2 and sum(v[1].v) == 0


def test_seeds(spark):
    assert seeds.domains(spark).count() == 37 and seeds.terms(spark).count() == 27 and seeds.identifier_variables(spark).count() == 148
    by_class = {r["class"]: r["count"] for r in seeds.domains(spark).groupBy("class").count().collect()}
    assert by_class == {"Events": 6, "Findings": 9, "Findings About": 2, "Interventions": 5, "Relationship": 4, "Special Purpose": 4, "Trial Design": 7}


def test_entry_registry():
    import __spark_entry__ as entry

    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 100
