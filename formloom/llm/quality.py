"""Text quality statistics of documents, and which documents are no natural prose.

A text is cut into segments of lines that look alike; each segment gets ten statistics and the
language whose function words it uses most, or 'other' where a text of whole sentences uses hardly
any of those known; short words stand for function words there. For each language the mean and
covariance of prose are fitted robustly: start from plain segments rich in function words, then
refit on the segments within a cutoff of the current centre (concentration steps). The squared
Mahalanobis distance of a segment splits into one contribution per statistic. A document is no
prose if segments beyond the cutoff hold most of its characters; what they look like names its kind.
The statistics of whole documents, their distance and its contributions are fitted and reported alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formloom.session import materialise

# Function words of four languages.
FUNCTION_WORDS = {
    "en": "the a an of in on at to and for from by with is are was were be been as if when while since until that this which it its under after before during than has have had but may must so only any all into",
    "de": "der die das und den dem des ein eine einer einen im in zu mit von auf für ist nicht am an als bei nach weil wird wenn vor jeder jedes jede ohne oder aus noch zur zum sich es",
    "fr": "le la les de du des et un une l d à au aux en sur pour dans que qui est pas ne par avec sans si ou ce se son sa avant après",
    "es": "el la los las de del y un una en con por para que se no es al su sin cuando si lo como antes después cada",
}
LANGUAGES = [*FUNCTION_WORDS, "other"]
OTHER = len(LANGUAGES) - 1
STATISTICS = ["common_words", "longest_gap", "letters", "digits", "symbols", "word_length", "odd_words", "distinct_words", "words_a_line", "sentence_ends"]
#: Smallest standard deviation a statistic is given, so that a statistic that hardly varies in prose cannot decide alone.
LEAST_SD = np.array([0.05, 0.07, 0.03, 0.03, 0.02, 0.12, 0.06, 0.20, 1.00, 0.50])
#: The same for languages that are not told apart, whose scripts and words differ among themselves.
LEAST_SD_OTHER = np.array([0.15, 0.40, 0.08, 0.05, 0.05, 0.60, 0.10, 0.30, 1.50, 0.60])
#: Statistics of whole documents; distances take the logarithm of those in LOGGED.
DOCUMENT = ["word_count", "mean_word_length", "letter_ratio", "digit_ratio", "symbol_ratio", "line_ends", "common_words", "odd_words", "distinct_words", "words_a_line"]
LOGGED = np.array([True, True, False, False, False, False, False, False, False, True])
LEAST_SD_DOCUMENT = np.array([1.00, 0.12, 0.03, 0.03, 0.02, 0.30, 0.05, 0.06, 0.20, 1.00])
LEAST_SD_DOCUMENT_OTHER = np.array([1.00, 0.60, 0.08, 0.05, 0.05, 0.60, 0.15, 0.10, 0.30, 1.50])
#: A text is of another language if fewer of its words are function words of any known one, and more stand in sentences.
FEW_KNOWN, MOSTLY_SENTENCES = 0.2, 0.7
#: A language counts as if so many more segments (or documents) of all languages had been seen in it.
PRIOR_WEIGHT = 50.0
#: Squared distance beyond which a segment is no prose, for plain lines and for lines that look like items or rows.
CUTOFF, CUTOFF_MARKED = 24.0, 14.0
_FIT_CUTOFF = 25.0
#: Share of distinct word runs below which a text is one fragment again and again.
REPEATED = 0.2
_LONG_RUN = 10
_RUN_BASE = np.uint64(0x9E3779B97F4A7C15)
KINDS = ["prose", "list", "table", "junk"]
_MASK: dict[str, int] = {}
for _i, _l in enumerate(LANGUAGES[:OTHER]):
    for _w in FUNCTION_WORDS[_l].split():
        _MASK[_w] = _MASK.get(_w, 0) | 1 << _i
_OF_LANG = [bytes(1 if b >> i & 1 else 0 for b in range(256)) for i in range(OTHER)]
_ANY = bytes(1 if b else 0 for b in range(256))
_LETTERS = bytes(b for b in range(128) if chr(b).isalpha())
_DIGITS = b"0123456789"
_BLANKS = bytes(b for b in range(128) if chr(b).isspace())
_WORD = re.compile(r"[^\W\d_]+")
_WORD_ASCII = re.compile(r"[a-z]+")
_LINES = re.compile(r"\r\n|\r|\n")
_MARK = re.compile(r"\s*(?:[-*•·–‣▪○●□☐☑■]\s|\[[ xX]?\]|\(?[A-Za-z0-9]{1,3}[.)]\s|<[A-Z]{1,8}>|>\s)")
_LABEL = re.compile(r"\s*[^:.]{3,60}:(?:\s|$)")
_PAIR = re.compile(r"\s*\S{2,20}(?: \S+){0,3} [-–] \S")
_TIGHT_COMMA = re.compile(r",(?! )")
_GAPS = re.compile(r"\S {2,}(?=\S)")
_END = re.compile(r"[.!?…。！？؟।][\"'”»)\]]*\s*$")
_SENTENCES = re.compile(r"(?<=[.!?…])[\"'”»)\]]*\s+|(?<=[。！？؟।])")
_HARD = re.compile(r"[bcdfghjklmnpqrstvwxzß]{5}")
_VOWEL = re.compile(r"[aeiouyàâäáéèêëíîïóôöúûüœæåøãõ]")
_SEGMENT, _LONGEST = 160, 400
PLAIN, CELLS, MARKED, LABELLED, PAIRED = range(5)


class _Odd(dict):
    """Whether a word is unlike words of any European language: 1 or 0, remembered."""

    def __missing__(self, w: str) -> int:
        if len(self) > 300_000:
            self.clear()
        odd = len(w) > 18 or (len(w) >= 3 and not _VOWEL.search(w)) or bool(_HARD.search(w))
        self[w] = int(odd and not (ord(max(w)) > 0x24F))  # other scripts are not judged by vowels
        return self[w]


_ODD = _Odd()


def signature(line: str) -> int:
    if "\t" in line.strip() or line.count("|") >= 2 or line.count(";") - line.count("; ") >= 2:
        return CELLS
    if "," in line and len(_TIGHT_COMMA.findall(line.strip())) >= 2:
        return CELLS
    if "  " in line and len(_GAPS.findall(line)) >= 2:
        return CELLS
    if _MARK.match(line):
        return MARKED
    n = len(line)
    if n < 120 and ":" in line and _LABEL.match(line):
        return LABELLED
    if n < 90 and _PAIR.match(line):
        return PAIRED
    return PLAIN


def segments(text: str) -> Iterator[tuple[int, list[str]]]:
    """(signature, lines): runs of non-blank lines of one signature, of about 160 characters; longer
    lines are cut at 400."""
    cur: list[str] = []
    kind, size = PLAIN, 0
    for line in _LINES.split(text):
        if not line.strip():
            continue
        s = signature(line)
        if cur and (s != kind or size >= _SEGMENT):
            yield kind, cur
            cur, size = [], 0
        kind = s
        if len(line) > _LONGEST:
            if cur:
                yield kind, cur
                cur, size = [], 0
            for i in range(0, len(line), _LONGEST):
                yield kind, [line[i : i + _LONGEST]]
            continue
        cur.append(line)
        size += len(line)
    if cur:
        yield kind, cur


def in_sentences(text: str) -> float:
    """Share of the words that stand in sentences: five words or more from a capital to a full stop, mostly in
    small letters and some of them short; of scripts without capitals, eight characters or more to a stop."""
    lines = [x for x in _LINES.split(text) if x.strip() and signature(x) == PLAIN]
    good = 0
    for part in _SENTENCES.split(" ".join(lines)):
        part = part.strip()
        if not _END.search(part):
            continue
        w = _WORD.findall(part)
        if not w:
            continue
        if 2 * sum(ord(max(x)) > 0x24F for x in w) > len(w):
            good += len(w) if len(part) >= 8 else 0
        elif len(w) >= 5 and w[0][0].isupper() and sum(map(len, w)) >= 3 * len(w) and sum(x.islower() or x.istitle() for x in w) > 0.8 * len(w) and sum(len(x) <= 3 for x in w) >= 0.1 * len(w):
            good += len(w)
    return good / max(1, len(_WORD.findall(text)))


class Counts:
    """What is counted in a run of lines: characters, letters, digits, blanks, words, words of no European
    look, lines, lines that end like sentences, function words by language, and the words."""

    def __init__(self, lines: list[str]):
        text = "\n".join(lines)
        self.chars = len(text)
        low = text.lower()
        if text.isascii():
            raw = low.encode()
            self.letters = self.chars - len(raw.translate(None, _LETTERS))
            self.digits = self.chars - len(raw.translate(None, _DIGITS))
            self.blanks = self.chars - len(raw.translate(None, _BLANKS))
            self.found = _WORD_ASCII.findall(low)
        else:
            self.found = _WORD.findall(low)
            self.letters = sum(map(len, self.found))
            self.digits = sum(map(str.isdigit, text))
            self.blanks = sum(map(str.isspace, text))
        get = _MASK.get
        self.masks = bytes([get(w, 0) for w in self.found])
        self.hits = [self.masks.translate(t).count(1) for t in _OF_LANG]
        self.odd = sum([_ODD[w] for w in self.found])
        self.lines = len(lines)
        self.ends = sum([_END.search(x) is not None for x in lines])

    def statistics(self, foreign: bool = False) -> tuple[int, list[float]]:
        """(language, statistics). With ``foreign``, a run with few function words is of another language."""
        k, n = len(self.found), self.chars
        m = max(1, k)
        lang = self.hits.index(max(self.hits))
        hits, common = self.hits[lang], self.masks.translate(_ANY)
        if foreign and hits < FEW_KNOWN * m:
            lang, common = OTHER, bytes([len(w) <= 3 for w in self.found])
            hits = common.count(1)
        return lang, [
            hits / m,
            min(max(map(len, common.split(b"\x01"))), 40) / max(8, k),
            self.letters / n,
            self.digits / n,
            (n - self.letters - self.digits - self.blanks) / n,
            float(np.log(self.letters / m + 0.5)),
            self.odd / m,
            len(set(self.found)) / m**0.9,
            float(np.log(k / self.lines + 1)),
            self.ends / self.lines,
        ]


def measure(text: str) -> tuple[int, list[float], list[tuple[int, int, int, int, list[float]]]]:
    """Language and statistics of a document (as DOCUMENT), and of each of its segments (characters,
    signature, lines, language, statistics)."""
    parts = [(sig, Counts(lines)) for sig, lines in segments(text)]
    total = lambda name: sum([getattr(c, name) for _, c in parts])
    words, n, lines, letters, digits = sum([len(c.found) for _, c in parts]), total("chars"), total("lines"), total("letters"), total("digits")
    m = max(1, words)
    hits = [sum(h) for h in zip(*[c.hits for _, c in parts])] or [0]
    lang, common = hits.index(max(hits)), max(hits)
    # Texts with hardly a stop have no sentences to look for.
    foreign = bool(parts) and common < FEW_KNOWN * m and 60 * sum(map(text.count, ".!?…。！？؟।")) >= words and in_sentences(text) >= MOSTLY_SENTENCES
    if foreign:
        lang, common = OTHER, sum([len(w) <= 3 for _, c in parts for w in c.found])
    distinct: set[str] = set()
    for _, c in parts:
        distinct.update(c.found)
    safe = max(1, n)
    own = [words, letters / m, letters / safe, digits / safe, (n - letters - digits - total("blanks")) / safe, total("ends") / max(1, lines), common / m, total("odd") / m, len(distinct) / m**0.9, words / max(1, lines)]
    return lang, own, [(c.chars, sig, c.lines, *c.statistics(foreign)) for sig, c in parts]


def repetition(text: str) -> float:
    """Share of word runs that are distinct, so taken that it does not fall with the length of a text: of
    three-word runs as the mean over stretches of 300 words, or of ten-word runs over the whole text,
    which hardly come again but in copies, whichever is less; 1 for texts under twelve words."""
    t = text.split()
    n = len(t)
    if n < 12:
        return 1.0
    shares = []
    for at in range(0, n - 2, 300):
        part = t[at : at + 302]
        if len(part) < 12:
            continue
        shares.append(len(set(zip(part, part[1:], part[2:]))) / (len(part) - 2))
    near = sum(shares) / len(shares)
    if n <= 302:
        return near  # one stretch sees all of it
    return min(near, _distinct_long_runs(t))


def _distinct_long_runs(t: list[str]) -> float:
    number: dict[str, int] = {}
    code = np.fromiter((number.setdefault(w, len(number)) for w in t), np.uint64, len(t))
    runs = np.zeros(len(t) - _LONG_RUN + 1, np.uint64)
    for i in range(_LONG_RUN):
        runs = (runs ^ code[i : i + runs.size]) * _RUN_BASE
        runs ^= runs >> np.uint64(29)
    return np.unique(runs).size / runs.size


def segment_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: distinct share of word runs, language, statistics of the whole (as DOCUMENT), and
    arrays over its segments (characters, signature, lines, language, statistics one after the
    other). Null, empty and blank texts have empty arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                offsets, chars, sigs, lines_of, langs, stats, reps, lang_of, own = [0], [], [], [], [], [], [], [], []
                for text in part.column(1).to_pylist():
                    text = text or ""
                    lang, whole, parts = measure(text)
                    for n, sig, lines, seg_lang, x in parts:
                        chars.append(n)
                        sigs.append(sig)
                        lines_of.append(lines)
                        langs.append(seg_lang)
                        stats += x
                    offsets.append(len(chars))
                    reps.append(repetition(text))
                    lang_of.append(lang)
                    own += whole
                off = pa.array(offsets, pa.int32())
                wide = pa.array(np.asarray(offsets, np.int32) * len(STATISTICS), pa.int32())
                each = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * len(DOCUMENT))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(reps, pa.float32()),
                        pa.array(lang_of, pa.int32()),
                        pa.ListArray.from_arrays(each, pa.array(own, pa.float64())),
                        pa.ListArray.from_arrays(off, pa.array(chars, pa.int32())),
                        pa.ListArray.from_arrays(off, pa.array(sigs, pa.int32())),
                        pa.ListArray.from_arrays(off, pa.array(lines_of, pa.int32())),
                        pa.ListArray.from_arrays(off, pa.array(langs, pa.int32())),
                        pa.ListArray.from_arrays(wide, pa.array(np.asarray(stats, np.float32))),
                    ],
                    names=[id_col, "distinct_runs", "lang", "own", "chars", "sigs", "lines", "langs", "stats"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, distinct_runs float, lang int, own array<double>, chars array<int>, sigs array<int>, lines array<int>, langs array<int>, stats array<float>")


def _flat(batch: pa.RecordBatch):
    arr = lambda name: batch.column(batch.schema.get_field_index(name))
    chars = arr("chars").flatten().to_numpy(zero_copy_only=False)
    sigs = arr("sigs").flatten().to_numpy(zero_copy_only=False)
    langs = arr("langs").flatten().to_numpy(zero_copy_only=False)
    x = arr("stats").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(STATISTICS))
    counts = np.asarray(arr("chars").value_lengths().fill_null(0))
    return chars, sigs, langs, x, counts


class Model:
    """Means and inverse covariances of prose by language."""

    def __init__(self, mean: np.ndarray, inverse: np.ndarray):
        self.mean, self.inverse = mean, inverse

    def parts(self, x: np.ndarray, langs: np.ndarray) -> np.ndarray:
        """Contribution of each statistic to the squared distance; a row sums to it."""
        z = x - self.mean[langs]
        return z * np.einsum("ij,ijk->ik", z, self.inverse[langs])

    @staticmethod
    def of_moments(n: np.ndarray, s: np.ndarray, ss: np.ndarray, typical: np.ndarray, least: np.ndarray, least_other: np.ndarray) -> Model:
        """From counts, sums and sums of products by language. Each language is drawn to all known ones
        with the weight PRIOR_WEIGHT, all of them to ``typical``, and 'other', which is no mixture of
        them, to ``typical`` at once."""
        p, w = typical.size, PRIOR_WEIGHT
        base = np.outer(typical, typical)
        all_n = n[:OTHER].sum() + w
        all_mean, all_second = (s[:OTHER].sum(0) + w * typical) / all_n, (ss[:OTHER].sum(0) + w * base) / all_n
        mean, inv = np.zeros((OTHER + 1, p)), np.zeros((OTHER + 1, p, p))
        for g in range(OTHER + 1):
            m0, s0, floor = (typical, base, least_other) if g == OTHER else (all_mean, all_second, least)
            mean[g] = (s[g] + w * m0) / (n[g] + w)
            inv[g] = np.linalg.inv((ss[g] + w * s0) / (n[g] + w) - np.outer(mean[g], mean[g]) + np.diag(floor**2))
        return Model(mean, inv)


# Statistics of common prose, of segments and of documents.
_TYPICAL = np.array([0.3, 0.2, 0.82, 0.01, 0.02, 1.75, 0.01, 1.2, 3.0, 0.6])
_TYPICAL_DOCUMENT = np.array([5.0, 1.65, 0.82, 0.01, 0.02, 0.6, 0.3, 0.01, 1.2, 3.0])


def _scaled(own: np.ndarray) -> np.ndarray:
    return np.where(LOGGED, np.log(own + 1), own)


def _moments(table: DataFrame, columns: list[str], chosen) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over all rows that ``chosen`` gives of a batch as (statistics, languages): partial sums per task,
    added up in Spark."""
    p, groups = len(STATISTICS), OTHER + 1
    width = 1 + p + p * p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros((groups, width))
        for batch in batches:
            x, langs = chosen(batch)
            for g in range(groups):
                y = x[langs == g]
                if len(y):
                    acc[g, 0] += len(y)
                    acc[g, 1 : 1 + p] += y.sum(0)
                    acc[g, 1 + p :] += (y.T @ y).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(groups), width), pa.int32()), pa.array(np.tile(np.arange(width), groups), pa.int32()), pa.array(acc.ravel())], names=["g", "i", "v"])

    rows = table.select(*columns).mapInArrow(run, "g int, i int, v double").groupBy("g", "i").agg(F.sum("v").alias("v")).collect()  # 5 x 111 rows
    acc = np.zeros((groups, width))
    for g, i, v in rows:
        acc[g, i] = v
    return acc[:, 0], acc[:, 1 : 1 + p], acc[:, 1 + p :].reshape(groups, p, p)


def fit(table: DataFrame, steps: int = 2, least_chars: int = 60) -> Model:
    """Robust prose model of the segments of a segment table; every step covers all of them."""

    def step(good):
        def chosen(batch):
            chars, sigs, langs, x, _ = _flat(batch)
            take = (chars >= least_chars) & good(sigs, langs, x)
            return x[take], langs[take]

        return Model.of_moments(*_moments(table, ["chars", "sigs", "langs", "stats"], chosen), _TYPICAL, LEAST_SD, LEAST_SD_OTHER)

    model = step(lambda sigs, langs, x: (sigs == PLAIN) & ((x[:, 0] >= 0.18) & (x[:, 1] <= 0.4) | (langs == OTHER)))
    for _ in range(steps):
        model = step(lambda sigs, langs, x, m=model: m.parts(x, langs).sum(1) <= _FIT_CUTOFF)
    return model


def _whole(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    at = batch.schema.get_field_index
    own = batch.column(at("own")).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(DOCUMENT))
    return own, batch.column(at("lang")).to_numpy(zero_copy_only=False)


def fit_documents(table: DataFrame, steps: int = 2) -> Model:
    """Robust prose model of whole documents; every step covers all of them. Texts without words are left out."""

    def step(good):
        def chosen(batch):
            own, langs = _whole(batch)
            x = _scaled(own)
            take = (own[:, 0] > 0) & good(own, x, langs)
            return x[take], langs[take]

        return Model.of_moments(*_moments(table, ["lang", "own"], chosen), _TYPICAL_DOCUMENT, LEAST_SD_DOCUMENT, LEAST_SD_DOCUMENT_OTHER)

    model = step(lambda own, x, langs: (own[:, 6] >= 0.18) & (own[:, 9] >= 5) | (langs == OTHER))
    for _ in range(steps):
        model = step(lambda own, x, langs, m=model: m.parts(x, langs).sum(1) <= _FIT_CUTOFF)
    return model


def judge(chars, sigs, lines, x, d2, counts, distinct):
    """Characters of each document by kind (columns as KINDS).

    A segment too short to tell (under 40 characters) goes with the segment after it, or before it
    at the end. Text whose word runs repeat almost throughout is junk whatever it says.
    """
    doc = np.repeat(np.arange(counts.size), counts)
    kind = np.where(d2 <= np.where(sigs == PLAIN, CUTOFF, CUTOFF_MARKED), 0, 1)
    out = kind == 1
    single = lines == 1
    common, letters, symbols, odd = x[:, 0], x[:, 2], x[:, 4], x[:, 6]
    cells = sigs == CELLS
    wild = (odd > 0.2) | (symbols > 0.45) | ((letters < 0.3) & ~cells) | ((sigs == PLAIN) & ((letters < 0.55) | (symbols > 0.16) & (common < 0.15)))
    # Rows of cells stand on lines of their own; a long single line of noise only looks like cells.
    wild |= cells & (chars >= 120) & single & ((symbols > 0.28) | (odd > 0.15))
    kind[out & cells] = 2
    kind[out & wild] = 3
    again = (distinct < REPEATED)[doc] if doc.size else np.zeros(0, bool)
    kind[again] = 3
    n = kind.size
    if n:
        # The nearest segment of the same document that is long enough, after it or else before it.
        told = chars >= 40
        at = np.arange(n)
        nxt = np.minimum.accumulate(np.where(told, at, n)[::-1])[::-1]
        prev = np.maximum.accumulate(np.where(told, at, -1))
        after = (nxt < n) & (doc[np.minimum(nxt, n - 1)] == doc)
        before = (prev >= 0) & (doc[np.maximum(prev, 0)] == doc)
        kind = kind[np.where(after, nxt, np.where(before, prev, at))]
    sums = np.zeros((counts.size, 4))
    np.add.at(sums, (doc, kind), chars)
    return sums


def _verdicts(batch: pa.RecordBatch, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(text_kind, share of characters that is no prose) of each document of a batch."""
    chars, sigs, langs, x, counts = _flat(batch)
    at = batch.schema.get_field_index
    distinct = batch.column(at("distinct_runs")).to_numpy(zero_copy_only=False)
    lines = batch.column(at("lines")).flatten().to_numpy(zero_copy_only=False)
    sums = judge(chars, sigs, lines, x, model.parts(x, langs).sum(1), counts, distinct)
    total = sums.sum(1)
    other = total - sums[:, 0]
    kind = np.where(total == 0, "empty", np.where(other > total / 2, np.array(KINDS)[sums[:, 1:].argmax(1) + 1], "prose"))
    return kind, other / np.maximum(total, 1)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: language ('other' beyond the known ones), the statistics DOCUMENT of the whole text,
    its squared distance from the prose of its language over all of them, the contribution of each
    (they sum to the distance), the statistic that contributes most, the share of characters that is no
    prose, and text_kind: 'prose', 'list', 'table', 'junk', or 'empty' for null, empty and blank
    texts, which have no language. Every row of ``docs`` gives one row; repeated rows are kept."""
    table = materialise(segment_table(docs, id_col, text_col), "segments")
    model, whole = fit(table), fit_documents(table)
    p = len(DOCUMENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, share = _verdicts(batch, model)
            own, langs = _whole(batch)
            empty = kind == "empty"
            parts = np.where(empty[:, None], 0.0, whole.parts(_scaled(own), langs))
            top = np.array(DOCUMENT)[parts.argmax(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.where(empty, None, np.array(LANGUAGES)[langs]), pa.string()),
                    pa.array(own[:, 0].astype(np.int64)),
                    *(pa.array(own[:, j]) for j in range(1, p)),
                    pa.array(parts.sum(1)),
                    pa.ListArray.from_arrays(pa.array(np.arange(kind.size + 1) * p, pa.int32()), pa.array(parts.ravel())),
                    pa.array(np.where(empty, None, top), pa.string()),
                    pa.array(share),
                    pa.array(kind, pa.string()),
                ],
                names=[id_col, "language", *DOCUMENT, "distance", "contributions", "top_statistic", "other_share", "text_kind"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, language string, word_count bigint, {', '.join(s + ' double' for s in DOCUMENT[1:])}, distance double, contributions array<double>, top_statistic string, other_share double, text_kind string"
    return table.mapInArrow(run, schema)


def not_prose(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_kind) of the documents that are no natural prose by most of their characters."""
    table = materialise(segment_table(docs, id_col, text_col), "segments")
    model = fit(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, _ = _verdicts(batch, model)
            take = pa.array(np.flatnonzero((kind != "prose") & (kind != "empty")))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(kind, pa.string()).take(take)], names=[id_col, "text_kind"])

    kind = docs.schema[id_col].dataType.simpleString()
    return table.select(id_col, "distinct_runs", "chars", "sigs", "lines", "langs", "stats").mapInArrow(run, f"`{id_col}` {kind}, text_kind string")
