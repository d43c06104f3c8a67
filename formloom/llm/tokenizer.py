"""Byte-level BPE encoding of whole corpora with a public vocabulary.

Bytes are mapped to Latin-1 characters so that an Aho-Corasick automaton over the vocabulary finds
all tokens of a piece in one pass. A piece is then encoded left to right: take the longest token at
the position; if it may stand next to the token before it go on, else try the next shorter token,
and where none is left step back. Positions already found hopeless are marked, so each is left at
most once and the work is linear in the length. Two tokens may stand side by side if merging their
joined bytes would keep the border between them; answers are memoised. The result equals that of
applying the merges by rank.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: the public pattern that splits a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# White space as Unicode has it; runs of it border the chunks that are cached.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_MOST_CACHED = 400_000
_MOST_CACHED_CHARS = 64


def _byte_of_char() -> dict[str, int]:
    """The vocabulary file writes each byte as a printable character: visible Latin-1 as itself, all
    other bytes, in order, from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    def __init__(self, path: str = DEFAULT_VOCABULARY):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        to_byte = _byte_of_char()
        latin = lambda token: "".join(chr(to_byte[c]) for c in token)
        self.token_of: dict[int, str] = {}
        for token, i in model["vocab"].items():
            if all(c in to_byte for c in token):
                self.token_of[i] = latin(token)
        ids = {t: i for i, t in self.token_of.items()}
        self.rank: dict[tuple[int, int], int] = {}  # pair to the id that merging it gives; ids follow the merge order
        self.halves: dict[int, tuple[int, int]] = {}
        for merge in model["merges"]:
            a, b = (latin(x) for x in (merge if isinstance(merge, list) else merge.split(" ")))
            pair, got = (ids[a], ids[b]), ids[a + b]
            self.rank[pair] = got
            self.halves.setdefault(got, pair)
        made = set(self.halves)
        # A token that no merge makes can come out of single bytes only.
        usable = {t: i for t, i in ids.items() if i in made or len(t) == 1}
        self.length = {i: len(t) for t, i in usable.items()}
        automaton = ahocorasick.Automaton()
        for t, i in usable.items():
            automaton.add_word(t, (i, len(t)))
        automaton.make_automaton()
        self.automaton = automaton
        self.shorter: dict[int, int] = {}
        for t, i in usable.items():
            for k in range(len(t) - 1, 0, -1):
                j = usable.get(t[:k])
                if j is not None:
                    self.shorter[i] = j
                    break
        self.one = {t: i for t, i in usable.items()}
        self._beside: dict[tuple[int, int], bool] = {}
        self._pieces = regex.compile(PATTERN).findall
        self._chunks = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+").findall
        self._cache: dict[str, list[int]] = {}
        self._piece_cache: dict[str, list[int]] = {}

    def _may_stand_beside(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b by rank leaves the border between them.

        Undo the merges of both sides from the latest on. At any time the border's two neighbours
        are the tokens that had been made by then; they would have merged if their pair's rank came
        before the next merge of either side.
        """
        key = (a, b)
        known = self._beside.get(key)
        if known is not None:
            return known
        bound = 1 << 40
        x, y = a, b
        answer = True
        while True:
            merged = self.rank.get((x, y))
            if merged is not None and merged < bound:
                answer = False
                break
            # Of the two, the one made later comes apart first; on the left side the same token's merge
            # comes first, as merges go from left to right.
            hx, hy = self.halves.get(x), self.halves.get(y)
            if hx is None and hy is None:
                break
            if hy is None or (hx is not None and x > y):
                bound = x
                x = hx[1]
            else:
                bound = y + 1
                y = hy[0]
        if len(self._beside) > 2_000_000:
            self._beside.clear()
        self._beside[key] = answer
        return answer

    def _encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece, given as Latin-1 characters of its bytes."""
        whole = self.one.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest = [0] * n
        width = [0] * n
        for end, (i, size) in self.automaton.iter(piece):
            start = end - size + 1
            if size > width[start]:
                longest[start], width[start] = i, size
        hopeless = bytearray(n + 1)
        out: list[int] = []
        at = 0
        token: int | None = longest[0]
        while True:
            while token is not None:
                end = at + self.length[token]
                if not hopeless[end] and (not out or self._may_stand_beside(out[-1], token)):
                    break
                token = self.shorter.get(token)
            if token is None:
                hopeless[at] = 1
                last = out.pop()
                at -= self.length[last]
                token = self.shorter.get(last)
                continue
            out.append(token)
            at = end
            if at == n:
                return out
            token = longest[at]

    def _encode_chunk(self, chunk: str) -> list[int]:
        out: list[int] = []
        cache = self._piece_cache
        for piece in self._pieces(chunk):
            ids = cache.get(piece)
            if ids is None:
                ids = self._encode_piece(piece.encode("utf-8", "replace").decode("latin-1"))
                if len(piece) <= _MOST_CACHED_CHARS:
                    if len(cache) >= _MOST_CACHED:
                        cache.clear()
                    cache[piece] = ids
            out += ids
        return out

    def encode(self, text: str) -> list[int]:
        cache = self._cache
        out: list[int] = []
        for chunk in self._chunks(text):
            ids = cache.get(chunk)
            if ids is None:
                ids = self._encode_chunk(chunk)
                if len(chunk) <= _MOST_CACHED_CHARS:
                    if len(cache) >= _MOST_CACHED:
                        cache.clear()
                    cache[chunk] = ids
            out += ids
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(os.path.realpath(path))


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, ids): token ids of each whole text, special tokens' strings being ordinary text.

    Null and empty texts have an empty list; no row is dropped and repeated rows are kept. The
    vocabulary file must be at ``vocabulary`` on every executor. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            texts = batch.column(1)
            done = 0
            while done < batch.num_rows:
                flat: list[np.ndarray] = []
                sizes = [0]
                total = 0
                first = done
                while done < batch.num_rows and total < 2_000_000:
                    value = texts[done].as_py()
                    ids = np.asarray(enc.encode(value), np.int32) if value else np.zeros(0, np.int32)
                    flat.append(ids)
                    total += ids.size
                    sizes.append(total)
                    done += 1
                lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(flat), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, done - first), lists], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
