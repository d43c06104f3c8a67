"""Passages of evaluation items inside corpus documents.

Texts are reduced to their letters and digits, so case, punctuation, spacing, quote marks and broken
words do not count. A passage that holds half of an item's words with at most one word in ten
changed must share a computable number of character q-grams with the item, all near one diagonal
(the q-gram lemma). Shared q-grams are counted in overlapping diagonal bands, as wide as words
missing or put in can move the passage, all documents of a batch at once; regions that reach the
item's bound are verified by banded alignments of words, one for each first word a passage may have.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_LARGEST_Q = 24
_BAND = 64  # least half width of a band, in characters
_PIECE = 400_000  # characters of a text that are searched at once
_CHUNK = 1_500_000
_WORD_ASCII = re.compile(r"[a-z0-9]+")
_WORD = re.compile(r"[^\W_]+")
_DROP = bytes(b for b in range(128) if not chr(b).isalnum())
_ERRORS = 0.1


def words(text: str) -> list[str]:
    low = text.lower()
    return (_WORD_ASCII if low.isascii() else _WORD).findall(low)


def stream(text: str) -> bytes:
    low = text.lower()
    if low.isascii():
        return low.encode().translate(None, _DROP)
    return "".join(_WORD.findall(low)).encode("utf-8", "replace")


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def gram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """Polynomial hashes of all windows of ``q`` bytes, by doubling."""
    if data.size < q:
        return np.zeros(0, np.uint64)
    part, size = data.astype(np.uint64) + np.uint64(1), 1
    out, have = None, 0
    left = q
    while left:
        if left & 1:
            if out is None:
                out, have = part, size
            else:
                n = data.size - (have + size) + 1
                out, have = out[:n] * _power(size) + part[have : have + n], have + size
        left >>= 1
        if left:
            n = data.size - 2 * size + 1
            part, size = part[:n] * _power(size) + part[size : size + n], 2 * size
    return out


def kept_letters(lengths: list[int]) -> list[tuple[int, int]]:
    """(errors, letters) for each number of changed words that a passage of half the words or more may
    have: the fewest letters left of such a passage without that many words. A longer passage
    with no more errors keeps more, so each number is taken at its least size. Windows are counted by
    word length, all at once."""
    n = len(lengths)
    kinds, code = np.unique(np.asarray(lengths, np.int64), return_inverse=True)
    seen = np.zeros((n + 1, kinds.size), np.int64)
    seen[np.arange(1, n + 1), code] = 1
    seen = seen.cumsum(0)
    out: dict[int, int] = {}
    for size in range(-(-n // 2), n + 1):
        errors = int(size * _ERRORS)
        if errors not in out:
            upto = np.minimum((seen[size:] - seen[:-size]).cumsum(1), size - errors)  # the shortest words stay
            out[errors] = int((np.diff(upto, axis=1, prepend=0) @ kinds).min())
    return sorted(out.items())


def lemma_bound(kept: list[tuple[int, int]], q: int) -> int:
    """Fewest q-grams that a passage of half the words or more shares with the item: those of the letters
    that are left, less those across the borders of the changed words."""
    return min(letters - (errors + 1) * (q - 1) for errors, letters in kept)


class ItemIndex:
    """q-gram index of a block of items; ``items`` are (id, text)."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.words = [words(t) for _, t in items]
        self.sizes = np.asarray([sum(len(w.encode()) for w in ws) for ws in self.words], np.int64)
        self.groups = []
        by_q: dict[int, list[int]] = {}
        self.bound = np.ones(len(items), np.int64)
        self.band = np.full(len(items), _BAND, np.int64)  # half widths
        for n, ws in enumerate(self.words):
            if not ws:
                continue
            lengths = [len(w.encode()) for w in ws]
            # Each word that is missing, or put in and no longer than the longest, moves the diagonal by its length.
            self.band[n] = max(_BAND, int(len(ws) * _ERRORS) * max(lengths))
            kept = kept_letters(lengths)
            q = _LARGEST_Q
            while q > 1 and lemma_bound(kept, q) < min(12, q):
                q -= 1
            self.bound[n] = max(1, lemma_bound(kept, q))
            by_q.setdefault(q, []).append(n)
        for q, members in sorted(by_q.items()):
            hashes, owner, offset = [], [], []
            for n in members:
                data = np.frombuffer("".join(self.words[n]).encode(), np.uint8)
                h = gram_hashes(data, q)
                hashes.append(h)
                owner.append(np.full(h.size, n, np.int32))
                offset.append(np.arange(h.size, dtype=np.int32))
            h, owner, offset = np.concatenate(hashes), np.concatenate(owner), np.concatenate(offset)
            o = np.argsort(h, kind="stable")
            h, owner, offset = h[o], owner[o], offset[o]
            keys, first = np.unique(h, return_index=True)
            bits = max(16, int(h.size * 64).bit_length())
            shift = np.uint64(64 - min(bits, 27))
            seen = np.zeros(1 << int(64 - int(shift)), bool)
            seen[(keys * _MIX) >> shift] = True
            self.groups.append((q, keys, np.append(first, h.size), owner, offset, seen, shift))
        self.most_words = max((len(w) for w in self.words), default=0)

    def candidates(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(unit, item, lowest diagonal) of each band that reaches its item's bound."""
        found = []
        n_items = len(self.ids)
        for q, keys, first, owner, offset, seen, shift in self.groups:
            h = gram_hashes(data, q)
            at = np.flatnonzero(seen[(h * _MIX) >> shift])
            slot = np.searchsorted(keys, h[at])
            slot[slot == keys.size] = 0
            same = keys[slot] == h[at]
            at, slot = at[same], slot[same]
            if not at.size:
                continue
            counts = first[slot + 1] - first[slot]
            total = int(counts.sum())
            rep = np.repeat(np.arange(at.size), counts)
            inner = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
            post = first[slot][rep] + inner
            pos = at[rep]
            unit = np.searchsorted(starts, pos, "right") - 1
            item = owner[post]
            diagonal = pos - starts[unit] - offset[post] + self.sizes[item]  # not negative
            half = self.band[item]
            span = int((diagonal // (2 * half)).max()) + 2
            pair = unit * n_items + item
            for moved in (0, 1):
                key = pair * span + (diagonal + moved * half) // (2 * half)
                k, c = np.unique(key, return_counts=True)
                p = k // span
                good = c >= self.bound[p % n_items]
                of = p[good] % n_items
                low = (k[good] % span * 2 - moved) * self.band[of] - self.sizes[of]
                found.append(np.stack([p[good] // n_items, p[good] % n_items, low], 1))
        return np.concatenate(found) if found else np.zeros((0, 3), np.int64)

    def verify(self, unit_words: list[str], unit_starts: np.ndarray, item: int, low: int) -> bool:
        """Whether the region of the diagonal band holds half of the item's words, one in ten changed.

        Words are aligned within the band only. Three steps, each sure: an item word without its like
        in its stretch of the band is an error in any alignment, so too many of them rule the region
        out; an alignment of the whole item that has a good window rules it in; else every first word
        of a window gets its own alignment."""
        own = self.words[item]
        reach = 2 * int(self.band[item])
        a = int(np.searchsorted(unit_starts, low - 40))
        b = int(np.searchsorted(unit_starts, low + reach + int(self.sizes[item]) + 40))
        region = _rejoin(unit_words[a:b], own)
        if not region:
            return False
        code = {w: i for i, w in enumerate(dict.fromkeys(own))}
        mine = np.asarray([code[w] for w in own])
        theirs = np.asarray([code.get(w, -1) for w in region])
        begin = int(unit_starts[a]) - low
        offset = np.cumsum([0] + [len(w.encode()) for w in own])[:-1]
        place = begin + np.cumsum([0] + [len(w.encode()) for w in region])[:-1]
        first = np.searchsorted(place, offset - 40)  # the band's first word for each word of the item
        last = np.maximum(np.searchsorted(place, offset + reach + 40, "right"), first)
        first, width = np.minimum(first, theirs.size), int((last - first).max())
        if not width:
            return False
        band = np.concatenate([theirs, np.full(width, -2)])[first[:, None] + np.arange(width)]
        band[np.arange(width) >= (last - first)[:, None]] = -2
        unlike = band != mine[:, None]
        half = -(-mine.size // 2)
        if not _window(unlike.all(1), half):
            return False
        return _window(_whole_alignment(unlike, first), half) or _any_window(unlike, first, half)


_FAR = 1 << 20


def _window(wrong: np.ndarray, half: int) -> bool:
    """Whether some ``half`` or more words in turn have at most one error in ten; ``wrong`` counts errors a word."""
    gain = np.concatenate([[0], np.cumsum(1 - 10 * wrong.astype(np.int64))])
    return bool((gain[half:] >= np.minimum.accumulate(gain[: gain.size - half])).any())


def _next_row(row: np.ndarray, unlike: np.ndarray, shift: int) -> np.ndarray:
    """Costs at the ends of the band's words after one more item word. ``row`` has the costs before the
    words of the last band, then after its last word; bands move right by ``shift``. The last axis is the band."""
    width = unlike.size
    moved = np.full(row.shape, _FAR, row.dtype)
    if shift <= width:
        moved[..., : width + 1 - shift] = row[..., shift:]
    out = moved + 1  # the item word is missing
    out[..., 1:] = np.minimum(out[..., 1:], moved[..., :-1] + unlike)
    steps = np.arange(width + 1)
    return np.minimum.accumulate(out - steps, -1) + steps  # words put in


def _whole_alignment(unlike: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Errors of each item word in a cheapest alignment of the whole item within the band, the ends of
    the region being free; words put in count for the item word before them."""
    n, width = unlike.shape
    rows = [np.zeros(width + 1, np.int32)]
    shifts = np.diff(first, prepend=first[0])
    for i in range(n):
        rows.append(_next_row(rows[-1], unlike[i], int(shifts[i])))
    wrong = np.zeros(n, np.int64)
    i, j = n, int(rows[n].argmin())
    while i:
        cost, back = rows[i][j], j + int(shifts[i - 1])
        above = rows[i - 1]
        if j and back - 1 <= width and cost == above[back - 1] + unlike[i - 1, j - 1]:
            wrong[i - 1] += int(unlike[i - 1, j - 1])
            i, j = i - 1, back - 1
        elif back <= width and cost == above[back] + 1:
            wrong[i - 1] += 1
            i, j = i - 1, back
        elif j:
            wrong[i - 1] += 1
            j -= 1
        else:  # pushed out of the band
            wrong[:i] += 1
            break
    return wrong


def _any_window(unlike: np.ndarray, first: np.ndarray, half: int, cells: int = 4_000_000) -> bool:
    """Whether any window of at least ``half`` item words aligns within the band at one error in ten. The
    first words of windows that words without their like do not rule out are aligned side by side,
    some at a time, each up to the last word that could end its window."""
    n, width = unlike.shape
    shifts = np.diff(first, prepend=first[0])
    gain = np.concatenate([[0], np.cumsum(1 - 10 * unlike.all(1).astype(np.int64))])
    best = np.maximum.accumulate(gain[::-1])[::-1]  # from each word on
    starts = np.flatnonzero(best[half:] >= gain[: n + 1 - half])
    block = max(1, cells // (width + 1))
    for at in range(0, starts.size, block):
        own = starts[at : at + block]
        stop = int(np.flatnonzero(gain >= gain[own].min())[-1])
        cost = np.full((own.size, width + 1), _FAR, np.int32)
        for i in range(int(own[0]), stop):
            cost = _next_row(cost, unlike[i], int(shifts[i]))
            new = own == i
            if new.any():  # a window may begin at any word of the band
                cost[new] = _next_row(np.zeros(width + 1, np.int32), unlike[i], 0)
            sizes = i + 1 - own
            if (10 * cost.min(1) <= sizes)[sizes >= half].any():
                return True
    return False


def _rejoin(region: list[str], own: list[str]) -> list[str]:
    """Words broken in two are put together where the item has the whole; words run together are cut
    where the item has the parts."""
    known = set(own)
    pairs = {a + b: (a, b) for a, b in zip(own, own[1:])}
    out: list[str] = []
    i = 0
    while i < len(region):
        w = region[i]
        if w not in known or (i + 1 < len(region) and region[i + 1] not in known):
            if i + 1 < len(region) and w + region[i + 1] in known:
                out.append(w + region[i + 1])
                i += 2
                continue
            if w not in known and w in pairs:
                out += pairs[w]
                i += 1
                continue
        out.append(w)
        i += 1
    return out


def _pieces(text: str, overlap: int) -> Iterator[str]:
    if len(text) <= _PIECE:
        yield text
        return
    at = 0
    while at < len(text):
        yield text[at : at + _PIECE + overlap]
        at += _PIECE


def search(index: ItemIndex, texts: list[str | None], overlap: int) -> Iterator[tuple[int, int]]:
    """(number of the text, item id) of every leak, each once."""
    units: list[tuple[int, str]] = []
    size = 0

    def run():
        streams = [stream(t) for _, t in units]
        starts = np.concatenate([[0], np.cumsum([len(s) + 1 for s in streams])[:-1]]).astype(np.int64)
        data = np.frombuffer(b"\0".join(streams), np.uint8)
        cand = index.candidates(data, starts)
        done = set()
        cand = cand[np.argsort(cand[:, 0], kind="stable")]
        last, ws, ends = -1, [], np.zeros(0)
        for u, item, low in cand.tolist():
            doc = units[u][0]
            if (doc, item) in done:
                continue
            if u != last:
                last, ws = u, words(units[u][1])
                ends = np.cumsum([0] + [len(w.encode()) for w in ws])[:-1]
            if index.verify(ws, ends, item, low):
                done.add((doc, item))
                yield doc, index.ids[item]

    seen: set[tuple[int, int]] = set()
    for n, text in enumerate(texts):
        if not text:
            continue
        for piece in _pieces(text, overlap):
            units.append((n, piece))
            size += len(piece)
            if size >= _CHUNK:
                for hit in run():
                    if hit not in seen:
                        seen.add(hit)
                        yield hit
                units, size = [], 0
    if units:
        for hit in run():
            if hit not in seen:
                yield hit


_INDEX: dict[str, tuple[ItemIndex, int]] = {}  # of a worker; by block


def _blocks(items: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    block: list[tuple[int, str]] = []
    size = 0
    for r in items.select(id_col, text_col).toLocalIterator():
        if r[0] is None or not r[1]:
            continue
        block.append((r[0], r[1]))
        size += len(r[1])
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = 8_000_000) -> DataFrame:
    """(doc_id, item_id) of every document that holds, in one stretch, at least half of an item's words
    in order, up to one word in ten being other, changed, missing or put in.

    Items are taken in blocks of at most ``block_chars`` characters, each searched against all
    documents, so what is broadcast is bounded. Null, empty and wordless texts match nothing; an
    item standing several times in a document, and repeated rows of one document in a partition,
    give one row each. Nothing is shuffled.
    """
    spark = docs.sparkSession
    types = (docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString())
    out_schema = f"doc_id {types[0]}, item_id {types[1]}"
    out = None
    for block in _blocks(items, item_id, item_text, block_chars):
        sent, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, name=name) -> Iterator[pa.RecordBatch]:
            made = _INDEX.get(name)
            if made is None:
                _INDEX.clear()
                longest = max(len(t) for _, t in sent.value)
                made = _INDEX[name] = (ItemIndex(sent.value), 3 * longest + 1000)
            index, overlap = made
            for batch in batches:
                for at in range(0, batch.num_rows, 4000):
                    part = batch.slice(at, 4000)
                    hits = list(search(index, part.column(1).to_pylist(), overlap))
                    if hits:
                        where = pa.array([h[0] for h in hits], pa.int64())
                        found = pa.array([h[1] for h in hits]).cast(out_types[1])
                        yield pa.RecordBatch.from_arrays([part.column(0).take(where), found], names=["doc_id", "item_id"])

        from pyspark.sql.pandas.types import to_arrow_type

        out_types = (None, to_arrow_type(items.schema[item_id].dataType))
        found = docs.select(doc_id, doc_text).mapInArrow(run, out_schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], out_schema)
