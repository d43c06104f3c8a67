import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from formloom.llm import dedup, entries, leak, quality, queries, tokenizer

PASSAGE = (
    "The central laboratory translates the derived eligibility item under the monthly shipping form after the joint rest period "
    "while the second pharmacist again returns the unpaired pain rating and keeps every earlier folder in the reading room of the site"
)


# --- p7 -----------------------------------------------------------------------------------------

def reference_encoder():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(tokenizer.DEFAULT_VOCABULARY)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_encoding_equals_library():
    want, enc = reference_encoder(), tokenizer.Encoder()
    rng = random.Random(7)
    alphabet = list(" abcdefghijklmnopqrstuvwxyzABC0123456789'.,;:-_=*#\n\t\r é€😀　") + ["'s", "'ll", "  ", "\n\n", "the", "ing", "<|endoftext|>"]
    texts = ["", " ", "a" * 5000, "=-" * 4000, "hello world", "I'll we've it's"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(3000)]
    for t in texts:
        assert enc.encode(t) == want(t), repr(t)


def test_encode_documents_keeps_rows(spark):
    df = spark.createDataFrame([(1, "some text", 5), (2, None, 5), (3, "", 5), (1, "some text", 6)], "doc_id long, text string, ids int")
    rows = sorted((r.doc_id, tuple(r.ids)) for r in tokenizer.encode_documents(df).collect())
    want = tuple(tokenizer.Encoder().encode("some text"))
    assert rows == [(1, want), (1, want), (2, ()), (3, ())]
    assert tokenizer.encode_documents(df.limit(0)).count() == 0


# --- p8 -----------------------------------------------------------------------------------------

def brute_leak(item, text):
    """Whether some window of half the item's words is within one edit in ten of a stretch of the text."""
    own, theirs = leak.words(item), leak.words(text)
    n = len(own)
    half = -(-n // 2)
    for a in range(n - half + 1):
        for size in range(half, n - a + 1):
            w = own[a : a + size]
            row = [0] * (len(theirs) + 1)
            for i, x in enumerate(w):
                new = [row[0] + 1]
                for j, y in enumerate(theirs):
                    new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
                row = new
            if min(row) <= int(size * 0.1):
                return True
    return False


def test_leaks_against_brute_force(spark):
    rng = random.Random(3)
    words = PASSAGE.split()
    noise = "other words of no passage stand here and there in many kinds of order for all readers".split()
    docs = []
    for i in range(40):
        share = rng.choice([0.3, 0.42, 0.5, 0.6, 0.8, 1.0])
        size = math.ceil(len(words) * share)
        at = rng.randint(0, len(words) - size)
        part = words[at : at + size]
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            k = rng.randrange(len(part))
            what = rng.choice(["swap", "drop", "add"])
            part = part[:k] + ([rng.choice(noise)] if what == "swap" else [] if what == "drop" else [rng.choice(noise), part[k]]) + part[k + 1 :]
        lead, tail = (" ".join(rng.choice(noise) for _ in range(rng.randint(0, 60))) for _ in range(2))
        text = f"{lead}\n{' '.join(part)} {tail}"
        if rng.random() < 0.3:
            text = text.upper().replace(" THE ", ",  THE\n> ")
        docs.append((i, text))
    docs += [(90, None), (91, ""), (92, "word"), (93, PASSAGE.replace("laboratory", "labora-\ntory")), (94, "x " * 500_000 + PASSAGE)]
    items = [(7, PASSAGE), (8, None), (9, ""), (10, "...")]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item_id int")
    it = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in leak.leaks(df, it).collect()}
    want = {(i, 7) for i, t in docs if t and i != 94 and brute_leak(PASSAGE, t)} | {(94, 7)}
    assert got == want
    assert leak.leaks(df.limit(0), it).count() == 0
    assert leak.leaks(df, it.limit(0)).count() == 0
    small = {tuple(r) for r in leak.leaks(df, it, block_chars=1).collect()}
    assert small == want


def test_short_items_are_found(spark):
    df = spark.createDataFrame([(1, "we met at the old red barn today"), (2, "a barn"), (3, "the old mill")], "doc_id long, text string")
    it = spark.createDataFrame([(1, "old red barn"), (2, "mill")], "item_id long, text string")
    got = {tuple(r) for r in leak.leaks(df, it).collect()}
    assert got == {(1, 1), (3, 2)}


def long_item(rng, n, least=2):
    letters = "abcdefghijklmnopqrstuvwxyz"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(least, 9))) for _ in range(n)]


@pytest.mark.parametrize("n", [17, 18, 30, 38, 58, 78, 118])
def test_windows_beyond_half_are_found(n):
    """Windows of the next multiple of ten words, with one word in ten wrong, evenly spread."""
    rng = random.Random(n)
    size = -(-n // 2) + -(-n // 2) * -1 % 10
    items = [long_item(rng, n) for _ in range(30)]
    texts = []
    for own in items:
        part, errors = own[:size], size // 10
        for k in range(errors):
            part[(2 * k + 1) * size // (2 * errors)] = "zzqzz"
        texts.append(" ".join([*long_item(rng, 20), *part, *long_item(rng, 20)]))
    assert all(brute_leak(" ".join(own), t) for own, t in zip(items[:3], texts))
    index = leak.ItemIndex([(i, " ".join(own)) for i, own in enumerate(items)])
    assert {(i, i) for i in range(30)} == set(leak.search(index, texts, 1000))


def passages(rng, own):
    """Passages of half, the next ten beyond half, and all words, with one word in ten changed, missing or put in."""
    n = len(own)
    half = -(-n // 2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    for size in {half, min(n, half + -half % 10), n}:
        for what in ("changed", "missing", "put in"):
            at = rng.randint(0, n - size)
            part = own[at : at + size]
            for k in sorted(rng.sample(range(1, size - 1), size // 10), reverse=True):
                part[k : k + (what != "put in")] = [] if what == "missing" else [word()]
            yield " ".join([*long_item(rng, 30), *part, *long_item(rng, 30)])


@pytest.mark.parametrize("n,count", [(12, 20), (38, 20), (58, 20), (98, 20), (400, 3), (800, 2), (1500, 1)])
def test_passages_at_the_limit_are_found(n, count):
    rng = random.Random(n)
    items = [long_item(rng, n) for _ in range(count)]
    texts, owner = [], []
    for i, own in enumerate(items):
        made = list(passages(rng, own))
        texts += made
        owner += [i] * len(made)
    got = set(leak.search(leak.ItemIndex([(i, " ".join(own)) for i, own in enumerate(items)]), texts, 30 * n + 1000))
    assert sum(pair in got for pair in enumerate(owner)) >= 0.99 * len(texts)
    assert all(owner[doc] == item for doc, item in got)


@pytest.mark.parametrize("n", [300, 600, 900, 1400])
def test_missing_words_of_long_items_move_the_passage(n):
    """Half and full copies, every tenth word missing or put in."""
    rng = random.Random(n)
    items = [long_item(rng, n, 4) for _ in range(4)]
    texts, want = [], set()
    for i, own in enumerate(items):
        for part in (own[: n // 2], own):
            missing = [w for k, w in enumerate(part) if k % 10 != 5]
            put_in = [x for k, w in enumerate(part) for x in ([w] if k % 11 != 5 else [w, "zzqzzqzz"])]
            for words in (missing, put_in):
                want.add((len(texts), i))
                texts.append(" ".join([*long_item(rng, 30, 4), *words, *long_item(rng, 30, 4)]))
    index = leak.ItemIndex([(i, " ".join(own)) for i, own in enumerate(items)])
    assert want == set(leak.search(index, texts, 30000))


# --- p6 -----------------------------------------------------------------------------------------

def test_duplicates(spark):
    rows = [
        (1, "A", "Was it seen? (X_1)", "B, C", 1), (2, "A", "was it seen x 1", "c; b", 2), (3, "A", "WAS IT SEEN X1", "B", 3), (4, "B", "was it seen x 1", "c; b", 1),
        (5, "A", None, "B", 1), (6, "A", "  ", "B", 1), (7, "A", "t", None, 1), (8, "A", "T.", "", 3), (9, None, "t", None, 1), (10, None, "T", "", 2), (8, "A", "T.", "", 3),
    ]
    df = spark.createDataFrame(rows, "row_id long, study_id string, text string, annotation string, key int")
    got = {tuple(r) for r in dedup.duplicate_members(df, batch=F.col("key")).collect()}
    assert got == {(1, 2), (7, 8), (9, 10)}
    one = {tuple(r) for r in dedup.duplicate_members(df).collect()}
    assert one == got
    counts = {(r.first_id, r.n_copies) for r in dedup.duplicate_counts(df, batch=F.col("key")).collect()}
    assert counts == {(1, 2), (3, 1), (4, 1), (7, 3), (9, 2)}
    assert dedup.duplicate_members(df.limit(0)).count() == 0


KEYS = "id long, grp string, key binary"


def rows_of(*keys):
    return [(i, "s", k.encode()) for i, k in keys]


def test_ledger_keeps_earliest_over_batches(spark):
    ledger = dedup.Ledger(spark, dedup.scratch_path(spark, "ledger"), n_buckets=2)
    ledger.update(spark.createDataFrame(rows_of((5, "k1"), (6, "k1"), (7, "k2")), KEYS))
    ledger.update(spark.createDataFrame(rows_of((2, "k1"), (9, "k3")), KEYS))
    assert ledger.update(spark.createDataFrame([], KEYS)) == []
    assert {(bytes(r.key), r.n, r.first_id) for r in ledger.rows().collect()} == {(b"k1", 3, 2), (b"k2", 1, 7), (b"k3", 1, 9)}
    assert ledger.n_rows() == 5


def test_opened_ledger_touches_only_the_buckets_of_a_batch(spark):
    base = dedup.scratch_path(spark, "ledger")
    made = dedup.Ledger.create(spark, base, rows_expected=64, rows_a_bucket=4)
    made.update(spark.createDataFrame(rows_of(*[(i, f"k{i % 40}") for i in range(80)]), KEYS))
    before = dict(made.at)
    again = dedup.Ledger.open(spark, base)
    assert again.at == before and again.n_buckets == made.n_buckets and len(before) > 3
    touched = again.update(spark.createDataFrame(rows_of((-1, "k7"), (500, "new")), KEYS))
    assert len(touched) <= 2
    assert {b: x for b, x in again.at.items() if b not in touched} == {b: x for b, x in before.items() if b not in touched}
    files = again.read(touched).inputFiles()
    assert files and all(f"bucket={b}/" in "".join(files) for b in touched) and not any(f"bucket={b}/" in f for f in files for b in before if b not in touched)
    got = {bytes(r.key).decode(): (r.n, r.first_id) for r in dedup.Ledger.open(spark, base).rows().collect()}
    assert got == {f"k{i}": (2, i) for i in range(40) if i != 7} | {"k7": (3, -1), "new": (1, 500)}


def test_every_batch_is_taken(spark):
    df = spark.createDataFrame([(i, "s", f"k{i % 3}".encode(), i) for i in range(6)], KEYS + ", batch int")
    assert sorted((bytes(r.key), r.n, r.first_id) for r in dedup.collapse(df).rows().collect()) == [(b"k0", 2, 0), (b"k1", 2, 1), (b"k2", 2, 2)]


# --- p3 -----------------------------------------------------------------------------------------

def test_typed_entries(spark):
    variables = spark.createDataFrame([("AEONSET", "Start of Event", "AE"), ("AESEVR", "Severity Level", "AE"), ("CMTRTX", "Treatment Given", "CM")], "var_name string, label string, domain_code string")
    terms = spark.createDataFrame([("LEFT CRAMP", "Cramp, left type", ["left muscle tightening"], "K1"), ("HOME", "Home (any)", None, "K1"), ("CLOT", None, [], "K2")], "submission_value string, preferred_term string, synonyms array<string>, codelist_code string")
    rows = [
        (1, "AE", "ae-onset:", "K1", "Cramp - Left"), (2, "AE", "AEONSTE", "K1", "lefft  muscle tightenign"), (3, "AE", "severity level", "K1", "clot"), (4, "AE", "SEVR", "K9", "clot"),
        (5, "AE", "TRTX", "K2", "c1ot"), (6, "AE", None, None, " "), (7, None, "??", "K2", "parking ticket"), (1, "AE", "ae-onset:", "K1", None), (8, "CM", "TREATMENT GIVEN", "k1 ", "h0me"),
    ]
    df = spark.createDataFrame(rows, "entry_id long, domain_code string, annotation string, codelist_code string, submission_value string")
    got = sorted(tuple(r) for r in entries.map_entries(df, variables, terms).collect())
    u = entries.UNMATCHED
    assert got == sorted([
        (1, "annotation", "AEONSET"), (1, "annotation", "AEONSET"), (1, "submission_value", "LEFT CRAMP"), (2, "annotation", "AEONSET"), (2, "submission_value", "LEFT CRAMP"),
        (3, "annotation", "AESEVR"), (3, "submission_value", u), (4, "annotation", "AESEVR"), (4, "submission_value", u), (5, "annotation", u), (5, "submission_value", "CLOT"),
        (7, "annotation", u), (7, "submission_value", u), (8, "annotation", "CMTRTX"), (8, "submission_value", "HOME"),
    ])
    assert entries.map_entries(df.limit(0), variables, terms).count() == 0
    assert {r.canonical for r in entries.map_entries(df, variables.limit(0), terms.limit(0)).collect()} == {u}


def test_candidates_against_all_pairs():
    """Of the values with a wording of three letters or more that passes the check, the cosine threshold
    keeps at least 99 in a hundred; one edit leaves next to nothing of two letters."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeghlmnoprstuv") for _ in range(rng.randint(2, 9)))
    listed = [[word() for _ in range(rng.randint(1, 4))] for _ in range(300)]
    rows = [(" ".join(w).upper(), "".join(w), " ".join(w), False) for w in listed]
    counts = entries.Counter(g for _, f, s, _ in rows for g in entries.grams(f, s.split(" ")))
    index = entries.ScopeIndex(rows, *entries._weights(counts, len(rows)))

    def typed(words):
        words = list(words)
        for _ in range(rng.choice([0, 1, 1, 2])):
            k = rng.randrange(len(words))
            w, at = words[k], rng.randrange(len(words[k]))
            words[k] = rng.choice([w[:at] + rng.choice("xyz") + w[at + 1 :], w[:at] + w[at + 1 :] or w, w[:at] + rng.choice("xyz") + w[at:], w[: max(2, at)] + "."])
        return words

    lost = total = 0
    for own in listed * 3:
        t = typed(own)
        form = "".join(t).replace(".", "")
        near = {c for c, *_ in index.best(form, t, 0.1, 9.0)}
        all_of = [(c, f) for c, f, s, strict in rows if len(f) > 2 and entries.check(form, t, f, s.split(" "), strict) is not None]
        if all_of:
            total += 1
            lost += not near & {c for c, _ in all_of}
    assert total > 600 and lost <= 0.01 * total, (lost, total)


def test_edits():
    def brute(a, b):
        d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j - 1] + (a[i - 1] != b[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    rng = random.Random(4)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(2))
        for most in (0, 1, 2, 3):
            assert entries.edits(a, b, most) == min(brute(a, b), most + 1)


def test_blocks_change_nothing(spark):
    values = spark.createDataFrame([("f", "s", v) for v in ("alpha", "alpah", "beta", "betta", "gamma ray", "nothing")], "field_name string, scope string, value string")
    ents = spark.createDataFrame([("f", "s", c, [c], []) for c in ("ALPHA", "BETA", "GAMMA RAY")], "field_name string, scope string, canonical string, texts array<string>, strict_texts array<string>")
    a = sorted(map(tuple, entries.map_values(values, ents).collect()))
    for chars in (1, 7, 12):
        assert sorted(map(tuple, entries.map_values(values, ents, block_chars=chars).collect())) == a
    assert [r[3] for r in a if r[2] == "alpah"] == ["ALPHA"]


def test_no_near_wording_is_left_out(spark):
    """Words cut to two letters, a wrong letter in a short word, and a rival whose siblings would fill eight places."""
    kinds = "marrow tendon kidney spleen thymus retina cornea larynx ureter biceps".split()
    cut = [(f"{a} {b} {c}").upper() for a, b, c in zip(kinds, kinds[3:] + kinds[:3], kinds[7:] + kinds[:7])]
    near = [f"LOWER {k.upper()} MUSCLE REGION" for k in kinds]
    ents = [("f", "s", c, [c, f"other wording {i} of it", f"code nr {i}{i} here"], []) for i, c in enumerate(cut)] + [("f", "t", c, [c], []) for c in near] + [("f", "u", "CLOT", ["CLOT"], []), ("f", "u", "AB", ["AB"], [])]
    ents += [("f", "u", f"WORD NUMBER {i} IN LINE", [f"WORD NUMBER {i} IN LINE"], []) for i in range(60)]
    ents += [("f", "v", f"AAA BBB CC{c} DDD", [f"AAA BBB CC{c} DDD"], []) for c in "EFGHIJKMNP"]
    typed = [("s", " ".join(w[:2] + "." for w in c.split()), c) for c in cut] + [("t", "lo. ki. mu. re.", "LOWER KIDNEY MUSCLE REGION"), ("u", "cxot", "CLOT"), ("u", "xy", entries.UNMATCHED), ("v", "aaa bbb ccp ddd", "AAA BBB CCP DDD"), ("v", "aa. bb. cc. dd.", entries.UNMATCHED)]
    made = spark.createDataFrame(ents, "field_name string, scope string, canonical string, texts array<string>, strict_texts array<string>")
    values = spark.createDataFrame([("f", s, v) for s, v, _ in typed], "field_name string, scope string, value string")
    for chars in (4_000_000, 200):
        got = {(r.scope, r.value): r.canonical for r in entries.map_values(values, made, block_chars=chars).collect()}
        assert got == {(s, v): c for s, v, c in typed}


# --- p9 -----------------------------------------------------------------------------------------

def test_quality_kinds(spark):
    prose = " ".join(f"The reviewer {v} the {n} of the page before the visit, and it is kept in the folder at the site until the audit." for v, n in [("reads", "title"), ("checks", "date"), ("signs", "margin"), ("keeps", "copy"), ("sends", "form")])
    german = "Die Schwester prüft das Datum der Visite und legt den Bogen zu den Akten, weil die Angabe nicht in der Liste auf der Seite ist. " * 3
    items = "\n".join(f"- {a} {b} {c}" for a, b, c in zip("removed uncoded partial signed late brief final open".split() * 3, "stent ulcer record query vein lab heart page".split() * 3, "length margin key reply segment kit rate header".split() * 3))
    rows = "\n".join(f"{i * 37}|weekly {i}|{i}.5|2024-01-{i:02d}" for i in range(1, 20))
    noise = "".join(random.Random(1).choice("hgfdslkjpqwrtz ;,öä") for _ in range(600))
    docs = [(i, prose) for i in range(60)] + [(100, german), (101, items), (102, rows), (103, noise), (104, "null " * 200), (105, prose.upper()), (106, None), (107, ""), (108, " \n "), (109, prose + "\n" + items[:200]), (110, items + "\n" + prose[:110])]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, language string")
    got = {r.doc_id: r.text_kind for r in quality.not_prose(df).collect()}
    assert got == {101: "list", 102: "table", 103: "junk", 104: "junk", 110: "list"}
    full = quality.quality(df)
    assert full.count() == len(docs)
    r = {x.doc_id: x for x in full.collect()}
    assert r[106].text_kind == r[107].text_kind == r[108].text_kind == "empty"
    assert abs(sum(r[101].contributions) - r[101].distance) < 1e-6 * max(1, r[101].distance)
    assert r[100].language == "de"
    assert quality.not_prose(df.limit(0)).count() == 0


def sentences(rng, n):
    words = [f"{a}{b}" for a in "mor ten kid sple thy ret cor lar".split() for b in "ing able ure ade one ist".split()]
    pick = lambda: rng.choice(words)
    return " ".join(f"The {pick()} of the {pick()} is in a {pick()} and the {pick()} was with the {pick()} before it." for _ in range(n))


def test_far_repeats_are_seen():
    rng = random.Random(5)
    for size in (5, 8, 15, 30):  # sentences of the fragment: 85 to 510 words
        fragment = sentences(rng, size)
        assert quality.repetition(" ".join([fragment] * 100)) < quality.REPEATED
        assert quality.repetition(fragment) > quality.REPEATED
    assert quality.repetition(sentences(rng, 3000)) > 0.9 * quality.repetition(sentences(rng, 17))  # not less for length
    assert quality.repetition(" ".join([sentences(rng, 30)] * 2)) > quality.REPEATED


def test_fragment_of_sentences_is_junk(spark):
    rng = random.Random(6)
    docs = [(i, sentences(rng, 12)) for i in range(60)] + [(100, "\n".join([sentences(rng, 30)] * 40)), (101, sentences(rng, 1200))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.text_kind for r in quality.not_prose(df).collect()} == {100: "junk"}


def test_few_rows_are_drawn_to_the_prior():
    p = len(quality.STATISTICS)
    x = np.random.default_rng(1).normal(size=(500_000, p))
    n = np.zeros(quality.OTHER + 1)
    s, ss = np.zeros((n.size, p)), np.zeros((n.size, p, p))
    n[0], s[0], ss[0] = len(x), x.sum(0), x.T @ x
    typical, least = np.full(p, 9.0), np.full(p, 0.1)
    m = quality.Model.of_moments(n, s, ss, typical, least, least)
    assert np.allclose(m.mean[0], x.mean(0), atol=0.01) and np.allclose(m.mean[1], m.mean[0], atol=0.01) and np.allclose(m.mean[quality.OTHER], typical)
    none = quality.Model.of_moments(n * 0, s * 0, ss * 0, typical, least, least)
    assert np.allclose(none.mean, typical) and np.allclose(none.inverse[0], np.eye(p) * 100)


FOREIGN = {
    "it": "La revisione del protocollo è stata completata dal comitato nel mese di marzo. I pazienti devono firmare il consenso prima di ogni visita. Il medico controlla la data e la pressione, poi compila il modulo e lo invia al centro di raccolta dei dati.",
    "pl": "Komisja zakończyła przegląd protokołu w marcu. Pacjenci muszą podpisać zgodę przed każdą wizytą. Lekarz sprawdza datę i ciśnienie pacjenta, a następnie wypełnia formularz i wysyła go do ośrodka. Jeżeli wartość nie jest podana, należy wykonać nowy pomiar.",
    "sv": "Kommittén avslutade granskningen av protokollet i mars. Patienterna måste skriva under samtycket före varje besök. Läkaren kontrollerar datumet och blodtrycket, fyller i formuläret och skickar det till centret. Om värdet saknas ska en ny mätning göras.",
    "ru": "Комиссия завершила проверку протокола в марте. Пациенты должны подписать согласие перед каждым визитом. Врач проверяет дату и давление пациента, затем заполняет форму и отправляет её в центр. Если значение не указано, нужно сделать новое измерение.",
    "zh": "委员会在三月份完成了方案的审查。患者在每次访视之前必须签署知情同意书。医生检查日期和血压，然后填写表格并将其发送到中心。如果没有数值，则需要重新测量，并将结果写在卡片上。",
    "ar": "أكملت اللجنة مراجعة البروتوكول في شهر مارس. يجب على المرضى توقيع الموافقة قبل كل زيارة. يتحقق الطبيب من التاريخ وضغط الدم ثم يملأ النموذج ويرسله إلى المركز. إذا لم تكن القيمة موجودة فيجب إجراء قياس جديد.",
    "fi": "Toimikunta sai tutkimussuunnitelman tarkastuksen valmiiksi maaliskuussa. Potilaiden on allekirjoitettava suostumus ennen jokaista käyntiä. Lääkäri tarkistaa päivämäärän ja verenpaineen, täyttää lomakkeen ja lähettää sen keskukseen. Jos arvo puuttuu, on tehtävä uusi mittaus.",
    "ja": "委員会は三月に計画書の審査を終えました。患者は毎回の来院の前に同意書に署名しなければなりません。医師は日付と血圧を確認し、用紙に記入してセンターに送ります。",
}


def test_prose_of_other_languages(spark):
    """Prose of languages without a model of their own, in one paragraph or broken into lines, beside their lists and tables."""
    rng = random.Random(8)
    docs = [(i, sentences(rng, 12)) for i in range(60)]
    fold = lambda t: "\n".join(t[k : k + 90] for k in range(0, len(t), 90))
    prose = {100 + i: t for i, t in enumerate(FOREIGN.values())} | {200 + i: fold(t) for i, t in enumerate(FOREIGN.values())}
    lists = {300: "\n".join(f"- {w}" for w in FOREIGN["it"].split() * 2), 301: "\n".join("modulo paziente visita centro".split() * 20), 302: "\n".join("Пациент|дата|форма|3" for _ in range(12))}
    df = spark.createDataFrame(docs + list(prose.items()) + list(lists.items()), "doc_id long, text string")
    got = {r.doc_id: r.text_kind for r in quality.not_prose(df).collect()}
    assert set(got) == set(lists) and got[300] == "list" and got[302] in ("table", "junk")


def test_document_statistics(spark):
    rng = random.Random(9)
    text = "The first line is a sentence.\nHere ( are 3 signs !\n\nno end"
    df = spark.createDataFrame([(i, sentences(rng, 12)) for i in range(60)] + [(100, text), (101, None), (102, "...")], "doc_id long, text string")
    r = {x.doc_id: x for x in quality.quality(df).collect()}
    x = r[100]
    assert (x.word_count, x.language) == (11, "en")
    assert abs(x.mean_word_length - 40 / 11) < 1e-9 and abs(x.line_ends - 2 / 3) < 1e-9 and abs(x.words_a_line - 11 / 3) < 1e-9
    assert abs(x.symbol_ratio - 3 / 57) < 1e-9 and abs(x.common_words - 4 / 11) < 1e-9 and abs(x.digit_ratio - 1 / 57) < 1e-9
    for row in r.values():
        assert abs(sum(row.contributions) - row.distance) < 1e-6 * max(1, row.distance)
    assert r[101].text_kind == "empty" and r[101].word_count == 0 and r[101].language is None
    assert r[100].distance > r[0].distance


def test_registered():
    assert {"p3_found", "p6_found", "p7_ids", "p8_found", "p9_found"} <= set(queries.QUERIES)
