import collections
import datetime as dt
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from formloom.operators import drift, jsonindex, nested, orphans, packed, skew


# --- packed fields ------------------------------------------------------------------------------

CASES = [
    ("A; B", ["A", "B"]), ("A,B|C", ["A", "B", "C"]), ("A / B", ["A", "B"]), ("N/A, Past/present", ["N/A", "Past/present"]), ("A\t|\tB\nC", ["A", "B", "C"]),
    ('"a, b"; c', ["a, b", "c"]), ("'x | y'\nDon't know", ["x | y", "Don't know"]), ('“k = "A, B"”, z', ['k = "A, B"', "z"]), ('"say ""hi""", b', ['say "hi"', "b"]), ('K = "A, B", C', ['K = "A, B"', "C"]),
    ("; A;;B ;", ["A", "B"]), (None, []), ("", []), (" \t", []), (";|,", []), ("one", ["one"]), ('open "quote, b', ['open "quote', "b"]), ("Patient's choice; it's", ["Patient's choice", "it's"]),
    ("0, ", ["0", ""]), ("A:B-C (d); e", ["A:B-C (d)", "e"]), (" A , B", ["A", "B"]), ("A /", ["A"]), ('""', []), ("'it''s so', b", ["it's so", "b"]),
]


def test_split_packed(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    got = {r.i: list(r.v) for r in df.select("i", packed.split_packed(F.col("t")).alias("v")).collect()}
    for i, (text, want) in enumerate(CASES):
        assert got[i] == want, text


def test_explode_packed(spark):
    df = spark.createDataFrame([(1, "a;b", "x", 0), (1, "a;b", "x", 1), (None, "c|d", None, 2), (2, "one", "", 3)], "row_id long, annotation string, option_annotations string, pos int")
    rows = collections.Counter(map(tuple, packed.explode_packed(df, "row_id", ["annotation", "option_annotations"]).collect()))
    assert rows == {(1, "annotation", 1, "a"): 2, (1, "annotation", 2, "b"): 2, (None, "annotation", 1, "c"): 1, (None, "annotation", 2, "d"): 1}
    assert packed.explode_packed(df.limit(0), "row_id", ["annotation"]).count() == 0


def test_long_packed_text(spark):
    text = ";".join(f'"v{i}, x"' for i in range(20_000))
    df = spark.createDataFrame([(1, text)], "row_id long, annotation string")
    out = packed.explode_packed(df, "row_id", ["annotation"])
    assert out.count() == 20_000 and out.filter("pos = 20000").first().part_value == "v19999, x"


# --- JSON index ---------------------------------------------------------------------------------

BROKEN = ['{"a":1,}', "[1,]", "[1 2]", '{"a" 1}', "{a:1}", "1 2", "", "nul", '{"a":tru}', "[1,2", "[1,2]]", '"\\x"', '"\\u12g4"', '{"a":1}{"b":2}', "[,1]", "{,}", '{"a":}', "{:1}", "[}", "{]", '"a', '"a\nb"', "01", '["a":1]', '{"a","b"}', '"a" "b"', "[1]2", "\\", '{"a":"x\\"}', "[1}", '{"a":1]']
WHOLE = ["{}", "[]", '{"a":1}', '"x"', "1", '{"a":{"b":[1,{"c":"\\""}]}}', '"\\u1234"', '[1,{"a":"]"}]', "-0.5e+3", "[[[[]]]]", ' {"a" : [ ] } ', '{"a":"\\\\"}', '{"a":"\\\\\\""}', "[true,false,null]"]


def test_validity():
    _, ok = jsonindex.build([t.encode() for pair in zip(BROKEN, WHOLE * 3) for t in pair])
    assert ok[0::2].sum() == 0 and ok[1::2].all()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=6), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4), x, max_size=4), max_leaves=20), min_size=1, max_size=5), st.randoms())
def test_index_agrees_with_parser(values, rng):
    texts = []
    for v in values:
        t = json.dumps(v, ensure_ascii=rng.random() < 0.5)
        if rng.random() < 0.4 and t:
            k = rng.randrange(len(t))
            t = t[:k] + rng.choice(["", '"', "{", "]", ",", "\\", ":"]) + t[k + 1 :]
        texts.append(t)

    def fine(t):
        try:
            json.loads(t, parse_constant=lambda c: 1 / 0)
            return True
        except Exception:
            return False

    _, ok = jsonindex.build([t.encode("utf-8", "surrogatepass") for t in texts])
    assert ok.tolist() == [fine(t) for t in texts]


def test_half_surrogates_and_odd_annotations(spark):
    """Half of a surrogate pair is no character; an object or array in place of an annotation comes as written."""
    texts = [
        r'{"annotations":[{"qid":"q1","option_annotations":{"A":"x \ud83d y","B \udc00":"z"}}]}',
        r'{"annotations":[{"qid":"q2","question_annotation":[ "X", {"a":1} ],"option_annotations":[{"option":"O","annotation":{"k":"v"}}]}]}',
        r'{"annotations":[{"qid":"q3","question_annotation":"\ud83d\ude00"}]}',
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "result_id long, payload string")
    got = sorted(map(tuple, nested.flatten_options(df).collect()))
    assert got == sorted([
        (0, "q1", "", "A", "x \ufffd y"), (0, "q1", "", "B \ufffd", "z"), (1, "q2", "", "", '[ "X", {"a":1} ]'), (1, "q2", "", "O", '{"k":"v"}'), (2, "q3", "", "", "\U0001f600"),
    ])


def brute_options(rows):
    out = collections.Counter()

    def inner(v):
        if isinstance(v, str) and v.strip()[:1] in ("{", "["):
            try:
                return inner(json.loads(v))
            except ValueError:
                return v
        return v

    def options(i, qid, parent, v):
        v = inner(v)
        items = ([v] if "option" in v else [{"option": k, "annotation": x} for k, x in v.items()]) if isinstance(v, dict) else v if isinstance(v, list) else []
        for it in items:
            if isinstance(it, str):
                a, _, b = it.partition(": ")
                out[i, qid, parent, a, b] += 1
                continue
            label = it.get("option") or ""
            out[i, qid, parent, label, it.get("annotation") or ""] += 1
            options(i, qid, label, it.get("sub_options"))
            if it.get("follow_up"):
                question(i, inner(it["follow_up"]), label)

    def question(i, q, parent):
        if (q.get("question_annotation") or "").strip():
            out[i, q["qid"], "", "", q["question_annotation"]] += 1
        options(i, q["qid"], parent, q.get("option_annotations"))

    for i, text in rows:
        try:
            page = inner(json.loads(text))
        except (TypeError, ValueError):
            continue
        for q in inner(page.get("annotations") or []):
            question(i, inner(q), "")
    return out


def random_page(rng):
    n = iter(range(10_000))
    word = lambda: rng.choice(["Yes", "No", 'So "far"', "Été", "a: b", "[NOT SUBMITTED]", "x\\y", "Other, specify"])

    def packed_text(v):
        return json.dumps(v) if rng.random() < 0.15 else v

    def option(depth):
        o = {"option": word()}
        if rng.random() < 0.8:
            o["annotation"] = rng.choice([word(), None, ""])
        if depth < 4 and rng.random() < 0.4:
            o["sub_options"] = packed_text([option(depth + 1) for _ in range(rng.randint(0, 3))])
        if depth < 3 and rng.random() < 0.2:
            o["follow_up"] = packed_text(question(depth + 1))
        return o

    def question(depth):
        q = {"qid": f"q-{next(n)}", "text": word()}
        if rng.random() < 0.6:
            q["question_annotation"] = rng.choice([word(), "", None])
        kind = rng.choice(["list", "dict", "strings", "none", "missing"])
        if kind == "list":
            q["option_annotations"] = packed_text([option(depth) for _ in range(rng.randint(0, 4))])
        elif kind == "dict":
            q["option_annotations"] = packed_text({word() + str(k): rng.choice([word(), None]) for k in range(3)})
        elif kind == "strings":
            q["option_annotations"] = packed_text([rng.choice(["Yes", "No: XA", "May: be: so"]) for _ in range(3)])
        elif kind == "none":
            q["option_annotations"] = None
        return q

    return {"file": "f", "annotations": [packed_text(question(0)) for _ in range(rng.randint(0, 5))]}


def test_flatten_options(spark):
    rng = random.Random(11)
    rows = [(i, json.dumps(random_page(rng), indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "  "), (103, rows[0][1][:-3]), (104, "null"), (105, "[]"), (106, rows[1][1]), (0, rows[0][1])]
    df = spark.createDataFrame([(i, p, "extra") for i, p in rows], "result_id long, payload string, qid string")
    got = collections.Counter(map(tuple, nested.flatten_options(df).collect()))
    assert got == brute_options([r for r in rows if r[0] not in (104, 105)])
    assert nested.flatten_options(df.limit(0)).count() == 0


def test_flatten_in_small_chunks(spark, monkeypatch):
    rng = random.Random(12)
    rows = [(i, json.dumps(random_page(rng)).encode()) for i in range(30)]
    one = nested._rows([p for _, p in rows])
    parts = [nested._rows([p]) for _, p in rows]
    assert len(one[0]) == sum(len(p[0]) for p in parts)
    assert collections.Counter(one[3]) == collections.Counter(x for p in parts for x in p[3])


# --- orphans ------------------------------------------------------------------------------------

DAY = dt.datetime


def test_orphans(spark):
    dom = spark.createDataFrame([("AE", DAY(2020, 1, 1), DAY(2020, 3, 10)), ("ae ", DAY(2020, 6, 1), None), ("CM", DAY(2020, 5, 15), None), (None, DAY(2020, 1, 1), None), ("ZZ", None, None)], "code string, loaded_at timestamp_ntz, deleted_at timestamp_ntz")
    rows = [
        (1, "ae", DAY(2020, 2, 1)), (2, "AE", DAY(2020, 3, 9)), (3, "AE", DAY(2020, 3, 10)), (4, "AE", DAY(2019, 12, 31)), (5, " AE ", DAY(2020, 6, 1)), (6, "CM, AE", DAY(2020, 5, 14)), (7, "CM", DAY(2020, 5, 15)),
        (8, "XX; xx", DAY(2020, 5, 1)), (9, None, DAY(2020, 5, 1)), (10, "", DAY(2020, 5, 1)), (11, "AE", None), (8, "XX", DAY(2020, 5, 1)), (12, "ZZ", DAY(2020, 5, 1)),
    ]
    df = spark.createDataFrame([(*r, "k") for r in rows], "row_id long, domain string, at timestamp_ntz, ref_key string")
    keys = F.regexp_extract_all(F.upper("domain"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    refs = orphans.references(df, "t", "domain", "row_id", keys, "at")
    want = {
        ("t", 3, "domain", "AE", "deleted", "2020-03"), ("t", 4, "domain", "AE", "late", "2019-12"), ("t", 6, "domain", "CM", "late", "2020-05"), ("t", 6, "domain", "AE", "deleted", "2020-05"),
        ("t", 8, "domain", "XX", "missing", "2020-05"), ("t", 12, "domain", "ZZ", "missing", "2020-05"),
    }
    for share in (0.001, 0.5, 1.0):
        got = list(map(tuple, orphans.orphan_references(refs, [orphans.dimension("domain", dom, "code")], heavy_share=share).collect()))
        assert set(got) == want and len(got) == len(want)
    assert orphans.orphan_references(refs.limit(0), [orphans.dimension("domain", dom, "code")]).count() == 0
    assert orphans.orphan_references(refs, [orphans.dimension("domain", dom.limit(0), "code")]).filter("reason <> 'missing'").count() == 0


def test_split_join(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)] + [(999, None)], "id int, k string")
    lookup = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3)], "k string, v int")
    got = sorted((r.id, r.v) for r in skew.split_join(rows, lookup, ["k"], heavy_share=0.1).collect())
    assert got == sorted((r.id, r.v) for r in rows.join(lookup, "k").collect())
    assert skew.split_join(rows, lookup, ["k"], heavy_share=0.1, how="left").count() == 301


# --- drift --------------------------------------------------------------------------------------

def lines_of(spark, files):
    rows = []
    for n, (fid, study, at, recs) in enumerate(files):
        rows += [(n * 100 + k, fid, study, at, k, r if isinstance(r, (str, type(None))) else json.dumps(r)) for k, r in enumerate(recs)]
    return spark.createDataFrame(rows, "line_id long, file_id long, study_id string, delivered_at timestamp_ntz, line_no int, line_text string")


def test_schema_changes(spark):
    forms = ["Year 1 Labs", "Baseline Exam", "Month 6 Labs", "Screening Exam"]
    f1 = (1, "A", DAY(2021, 1, 1), [{"qid": f"q{i}", "form": forms[i % 4], "page": i, "note": None} for i in range(8)] + ['{"qid": "broken', "", None, "[1]"])
    f3 = (3, "A", DAY(2021, 1, 2), [{"qid": f"q{i}", "formTitle": forms[(i + 1) % 4], "page": str(i), "note": "x"} for i in range(8)])
    f2 = (2, "A", DAY(2021, 1, 3), [{"qid": f"q{i}", "formTitle": {"name": forms[i % 4]}, "Page": str(i), "extra": True} for i in range(8)])
    g1 = (4, "B", DAY(2021, 1, 1), [{"qid": "q"}])
    df = lines_of(spark, [f2, f1, f3, g1])
    got = {(r.file_id, r.field_name, r.change_kind) for r in drift.schema_changes(df).collect()}
    assert got == {(3, "formTitle", "renamed"), (3, "page", "retyped"), (2, "formTitle", "retyped"), (2, "Page", "renamed"), (2, "extra", "added"), (2, "note", "removed")}
    assert drift.schema_changes(df.limit(0)).count() == 0


def test_unify_reports_failed_casts(spark):
    df = lines_of(spark, [(1, "A", DAY(2021, 1, 1), [{"qid": "a", "page": 1, "valid": True}, {"qid": "b", "pageId": "x7", "valid": 0}, {"qid": None}, "{"])])
    got = drift.unify(df, {"qid": "string", "page": "bigint", "valid": "boolean"}, {"pageId": "page"}).orderBy("line_id").collect()
    assert [(r.qid, r.page, r.valid, [(c.field, c.json_type, c.raw) for c in r.failed_casts]) for r in got] == [
        ("a", 1, True, []), ("b", None, False, [("pageId", "string", "x7")]),
    ] or [(r.qid, r.page, r.valid, len(r.failed_casts)) for r in got] == [("a", 1, True, 0), ("b", None, False, 1), (None, None, None, 0)]


def test_unify_keeps_all_records_and_fields(spark):
    recs = [{"qid": "a", "page": 1, "pageId": 2, "extra": [1]}, {"note": None}, {}, {"pageId": 3, "section": "s", "form": "f"}]
    df = lines_of(spark, [(1, "A", DAY(2021, 1, 1), recs)])
    got = drift.unify(df, {"qid": "string", "page": "bigint", "form": "string", "section": "string"}, {"pageId": "page", "section": "form"}).orderBy("line_id").collect()
    assert [(r.qid, r.page, r.form, r.section, {k: tuple(v) for k, v in r.rest.items()}) for r in got] == [
        ("a", 1, None, None, {"extra": ("array", "[1]"), "pageId": ("number", "2")}), (None, None, None, None, {"note": (None, None)}), (None, None, None, None, {}), (None, 3, "f", "s", {}),
    ]


def test_renames_hold_for_their_source_and_span(spark):
    files = [(1, "A", {"form": 1}), (2, "A", {"frm": 1}), (3, "A", {"sect": 1}), (4, "B", {"frm": 1}), (5, "B", {"form": 1, "frm": 1}), (6, "B", {"sect": 1}), (7, "C", {"section": 1}), (8, "C", {"sect": 1})]
    df = lines_of(spark, [(f, s, DAY(2021, f, 1), [rec]) for f, s, rec in files])
    changes = spark.createDataFrame([(2, "frm", "renamed", "form"), (8, "sect", "renamed", "section"), (3, "sect", "renamed", "frm")], "file_id long, field_name string, change_kind string, old_name string")
    got = {(r.file_id, r.field_name): r.to for r in drift.file_names(df, changes, {"form": "string", "section": "string"}).collect()}
    assert got == {(2, "frm"): "form", (3, "sect"): "form", (4, "frm"): "form", (8, "sect"): "section"}
    assert drift._targets([(2, "a", "x"), (4, "x", "b"), (6, "b", "x")], {"a", "b"}) == [("x", 2, 3, "a"), ("x", 6, (1 << 30) - 1, "b")]


def test_objects_do_not_pass_as_text(spark):
    """An object or array fails to cast to a single value, and any value passes as JSON; no field is lost."""
    lines = ['{"form":{"a":1},"opts":[1,"x"],"n":"7","extra":null}', '{"form":"F","opts":"t","n":"seven","Form":"G","extra":{"k":[]}}', "{}", "[1]", "{", None, '{"form":null,"Form":"H"}']
    df = spark.createDataFrame(list(enumerate(lines)), "line_id long, line_text string")
    rows = {r.line_id: r for r in drift.unify(df, {"form": "string", "opts": drift.JSON, "n": "bigint"}, {"Form": "form"}, keep=("line_id",)).collect()}
    assert set(rows) == {0, 1, 2, 6}
    assert (rows[0].form, rows[0].opts, rows[0].n) == (None, '[1,"x"]', 7)
    assert [tuple(x) for x in rows[0].failed_casts] == [("form", "object", '{"a":1}')] and {k: tuple(v) for k, v in rows[0].rest.items()} == {"extra": (None, None)}
    assert (rows[1].form, rows[1].opts, rows[1].n) == ("F", "t", None) and [tuple(x) for x in rows[1].failed_casts] == [("n", "string", "seven")]
    assert {k: tuple(v) for k, v in rows[1].rest.items()} == {"Form": ("string", "G"), "extra": ("object", '{"k":[]}')}
    assert rows[2].rest == {} and rows[6].form == "H" and rows[6].rest == {}
