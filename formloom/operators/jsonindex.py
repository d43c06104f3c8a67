"""Structural index of JSON texts, built with whole-buffer NumPy passes.

Many texts are laid end to end in one byte buffer. Bitmaps of quotes (escapes resolved by the parity
of backslash runs), of brackets and of delimiters give the token positions; prefix sums give the
in-string state and the nesting depth; a forward fill per depth gives each token its enclosing
bracket. Validity is a table of allowed neighbours per kind of container, so no text is walked
character by character.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np

OBJ, ARR, STR, PRIM = 0, 1, 2, 3
_LBRACE, _RBRACE, _LBRACK, _RBRACK, _COLON, _COMMA, _QUOTE, _SCALAR = range(8)
_CODE = np.full(256, -1, np.int8)
for _ch, _c in zip(b"{}[]:,", range(6)):
    _CODE[_ch] = _c
_WS = np.zeros(256, bool)
_WS[list(b" \t\r\n")] = True
_PLAIN = re.compile(rb"(?:true|false|null|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)\Z")
_ESCAPES = np.zeros(256, bool)
_ESCAPES[list(b'"\\/bfnrtu')] = True


@dataclass
class Nodes:
    """Nodes of all valid texts. ``doc``: the text's number; ``parent``: node or -1; ``key``: start of
    the member's key string or -1; ``start``/``end``: the byte span (content span for strings, from
    bracket to bracket for objects and arrays)."""

    buf: np.ndarray
    doc: np.ndarray
    kind: np.ndarray
    parent: np.ndarray
    key_start: np.ndarray
    key_end: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def raw(self, start: int, end: int) -> str:
        """The string between two quotes; half of a surrogate pair, which is no character, becomes U+FFFD."""
        piece = self.buf[start:end].tobytes()
        if b"\\" in piece:
            text = json.loads(b'"' + piece + b'"')
            return text if text.isascii() else text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
        return piece.decode("utf-8", "replace")


def _bad_docs(flag: np.ndarray, doc_of: np.ndarray, n: int) -> np.ndarray:
    bad = np.zeros(n, bool)
    bad[doc_of[flag]] = True
    return bad


def build(texts: list[bytes]) -> tuple[Nodes, np.ndarray]:
    """The nodes of ``texts`` and which texts are valid JSON (RFC 8259; one value a text)."""
    n = len(texts)
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, n)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    doc_at = lambda pos: np.searchsorted(starts, pos, "right") - 1
    bad = np.zeros(n, bool)

    # A quote counts if an even run of backslashes stands before it. Runs end at text borders, which
    # hold a line feed.
    slash = np.flatnonzero(buf == 92)
    quotes = np.flatnonzero(buf == 34)
    if slash.size:
        first = np.concatenate([[True], np.diff(slash) != 1])
        run_start = slash[np.maximum.accumulate(np.where(first, np.arange(slash.size), 0))]
        escaping = (slash - run_start) % 2 == 0
        escaped_at = slash[escaping] + 1
        quotes = quotes[~np.isin(quotes, escaped_at, assume_unique=True)]
    else:
        escaped_at = slash
    q_doc = doc_at(quotes)
    first_q = np.searchsorted(quotes, starts)
    per_doc = np.diff(np.concatenate([first_q, [quotes.size]]))
    bad |= per_doc % 2 == 1
    # An odd count would turn the parity of all later texts; each text's last quote is dropped then.
    if bad.any():
        keep = np.ones(quotes.size, bool)
        keep[(first_q + per_doc - 1)[bad & (per_doc > 0)]] = False
        quotes, q_doc = quotes[keep], q_doc[keep]
    opens, closes = quotes[0::2], quotes[1::2]

    inside = np.zeros(buf.size + 1, np.int8)
    inside[opens] += 1
    inside[closes + 1] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)  # the quotes count as inside
    control = np.flatnonzero(inside & (buf < 32))
    bad |= _bad_docs(np.ones(control.size, bool), doc_at(control), n)
    if escaped_at.size:
        out = ~inside[np.minimum(escaped_at, buf.size - 1)] | ~_ESCAPES[buf[np.minimum(escaped_at, buf.size - 1)]]
        bad |= _bad_docs(out, doc_at(escaped_at - 1), n)
        u = escaped_at[buf[np.minimum(escaped_at, buf.size - 1)] == 117]
        if u.size:
            digits = buf[np.minimum(u[:, None] + np.arange(1, 5), buf.size - 1)]
            hexa = ((digits >= 48) & (digits <= 57)) | ((digits >= 65) & (digits <= 70)) | ((digits >= 97) & (digits <= 102))
            bad |= _bad_docs(~hexa.all(1), doc_at(u), n)

    code = _CODE[buf]
    marks = np.flatnonzero((code >= 0) & ~inside)
    scalar = ~inside & (code < 0) & ~_WS[buf]
    edges = np.diff(np.concatenate([[0], scalar.astype(np.int8), [0]]))
    s_start, s_end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    words = [buf[a:b].tobytes() for a, b in zip(s_start, s_end)]
    fine = {w: _PLAIN.match(w) is not None for w in set(words)}
    wrong = np.fromiter((not fine[w] for w in words), bool, len(words))
    bad |= _bad_docs(wrong, doc_at(s_start), n)

    pos = np.concatenate([marks, opens, s_start])
    typ = np.concatenate([code[marks], np.full(opens.size, _QUOTE, np.int8), np.full(s_start.size, _SCALAR, np.int8)])
    end = np.concatenate([marks + 1, closes, s_end])
    order = np.argsort(pos, kind="stable")
    pos, typ, end = pos[order], typ[order], end[order]
    doc = doc_at(pos)
    m = pos.size
    seen = np.bincount(doc, minlength=n)
    bad |= seen == 0

    opening = (typ == _LBRACE) | (typ == _LBRACK)
    closing = (typ == _RBRACE) | (typ == _RBRACK)
    step = opening.astype(np.int64) - closing
    depth = np.cumsum(step)
    first_tok = np.searchsorted(doc, np.arange(n))
    base = np.concatenate([[0], depth])[first_tok]
    after = depth - base[doc] if m else depth
    before = after - step
    last_tok = np.concatenate([first_tok[1:], [m]]) - 1
    has = seen > 0
    bad[has] |= after[last_tok[has]] != 0
    bad |= _bad_docs(after < 0, doc, n)

    live = ~bad[doc] if m else np.zeros(0, bool)
    if not live.all():
        pos, typ, end, doc, after, before, opening, closing = (x[live] for x in (pos, typ, end, doc, after, before, opening, closing))
        m = pos.size
    # Enclosing bracket: at each depth, the last bracket opened before the token. Opening brackets
    # are members of the depth outside and markers of the depth inside.
    level = before.copy()
    idx = np.arange(m)
    mark = np.flatnonzero(opening)
    all_doc = np.concatenate([doc, doc[mark]])
    all_level = np.concatenate([level, after[mark]])
    all_idx = np.concatenate([idx, idx[mark]])
    is_mark = np.concatenate([np.zeros(m, bool), np.ones(mark.size, bool)])
    o = np.lexsort((all_idx, all_level, all_doc))
    filled = np.maximum.accumulate(np.where(is_mark[o], np.arange(o.size), -1)) if o.size else o
    parent = np.full(m, -1, np.int64)
    members = ~is_mark[o]
    at = np.where(filled >= 0, all_idx[o][np.maximum(filled, 0)], -1)
    parent[all_idx[o][members]] = at[members]
    parent[level == 0] = -1
    shut = np.flatnonzero(closing & (parent >= 0))
    end[parent[shut]] = end[shut]

    # Neighbour rules.
    ctx = np.where(parent >= 0, typ[np.maximum(parent, 0)], -1)
    prev_same = np.concatenate([[False], doc[1:] == doc[:-1]]) if m else np.zeros(0, bool)
    prev = np.where(prev_same, np.concatenate([[-1], typ[:-1]]), -1) if m else typ
    prev_idx_open = np.where(prev_same, np.concatenate([[False], opening[:-1]]), False) if m else opening
    in_obj, in_arr, top = ctx == _LBRACE, ctx == _LBRACK, ctx == -1
    value_like = opening | (typ == _QUOTE) | (typ == _SCALAR)
    key = in_obj & (typ == _QUOTE) & ((prev == _LBRACE) | (prev == _COMMA))
    prev_key = np.concatenate([[False], key[:-1]]) if m else key
    prev_value = prev_same & ~prev_key & np.isin(prev, [_QUOTE, _SCALAR, _RBRACE, _RBRACK])
    okay = np.where(
        value_like,
        np.where(in_arr, (prev == _LBRACK) & prev_idx_open | (prev == _COMMA), np.where(in_obj, key | (prev == _COLON), ~prev_same)),
        np.where(
            typ == _COLON,
            in_obj & prev_key,
            np.where(
                typ == _COMMA,
                (in_obj | in_arr) & prev_value,
                ~top & (np.where(typ == _RBRACE, in_obj, in_arr)) & (prev_value | prev_idx_open),
            ),
        ),
    )
    bad |= _bad_docs(~okay.astype(bool), doc, n)

    node = value_like & ~key & ~bad[doc] if m else value_like
    number = np.cumsum(node) - 1
    node_at = np.flatnonzero(node)
    has_key = (prev == _COLON)[node_at] & (node_at >= 2)
    key_tok = np.where(has_key, node_at - 2, 0)
    kind = np.select([typ[node_at] == _LBRACE, typ[node_at] == _LBRACK, typ[node_at] == _QUOTE], [OBJ, ARR, STR], PRIM)
    par = parent[node_at]
    quote_shift = (kind == STR).astype(np.int64)
    nodes = Nodes(
        buf,
        doc[node_at],
        kind.astype(np.int8),
        np.where(par >= 0, number[np.maximum(par, 0)], -1),
        np.where(has_key, pos[key_tok] + 1, -1) if m else node_at,
        np.where(has_key, end[key_tok], -1) if m else node_at,
        pos[node_at] + quote_shift,
        end[node_at],
    )
    return nodes, ~bad


@dataclass
class Forest:
    """Nodes with decoded keys and texts; JSON texts in place of values are grafted in."""

    doc: np.ndarray
    kind: np.ndarray
    parent: np.ndarray
    key: np.ndarray
    text: np.ndarray


def forest(texts: list[bytes], opaque_keys: frozenset[str] = frozenset()) -> Forest:
    """All nodes of the valid texts, in document order within a text. A string value that itself is a
    JSON object or array takes that value's place, however deep; not so under ``opaque_keys``, where
    an object or array has its JSON as written for a text."""
    parts: list[tuple[np.ndarray, ...]] = []
    pending, owner, graft = texts, np.arange(len(texts)), None
    total = 0
    replaced: list[np.ndarray] = []
    while len(pending):
        nodes, _ = build(pending)
        k = nodes.doc.size
        key = np.empty(k, object)
        cache: dict[bytes, str] = {}
        ks, ke = nodes.key_start, nodes.key_end
        data = nodes.buf.tobytes()
        for i in np.flatnonzero(ks >= 0):
            piece = data[ks[i] : ke[i]]
            got = cache.get(piece)
            if got is None:
                got = cache[piece] = nodes.raw(ks[i], ke[i])
            key[i] = got
        text = np.empty(k, object)
        held = np.flatnonzero(nodes.kind >= STR)
        for i in np.flatnonzero((nodes.kind < STR) & (ks >= 0)):
            if key[i] in opaque_keys:
                text[i] = data[nodes.start[i] : nodes.end[i]].decode("utf-8", "replace")
        for i in held:
            piece = data[nodes.start[i] : nodes.end[i]]
            if nodes.kind[i] == STR:
                text[i] = nodes.raw(nodes.start[i], nodes.end[i]) if b"\\" in piece else piece.decode("utf-8", "replace")
            else:
                text[i] = None if piece == b"null" else piece.decode()
        parent = np.where(nodes.parent >= 0, nodes.parent + total, -1)
        if graft is not None:  # roots hang where their string stood
            root = nodes.parent < 0
            parent[root] = graft["parent"][nodes.doc[root]]
            key[root] = graft["key"][nodes.doc[root]]
            replaced.append(graft["node"][nodes.doc[root]])
        parts.append((owner[nodes.doc], nodes.kind, parent, key, text, np.arange(total, total + k)))
        inner = [i for i in held if nodes.kind[i] == STR and key[i] not in opaque_keys and text[i].lstrip()[:1] in ("{", "[")]
        graft = {
            "parent": parent[inner],
            "key": key[inner],
            "node": np.asarray(inner, np.int64) + total,
        }
        owner = owner[nodes.doc[inner]] if inner else np.zeros(0, np.int64)
        pending = [text[i].strip().encode("utf-8", "surrogatepass") for i in inner]
        total += k
    if not parts:
        empty = np.zeros(0, np.int64)
        return Forest(empty, empty, empty, np.empty(0, object), np.empty(0, object))
    doc, kind, parent, key, text, _ = (np.concatenate([p[j] for p in parts]) for j in range(6))
    gone = np.concatenate(replaced) if replaced else np.zeros(0, np.int64)
    doc = doc.copy()
    doc[gone] = -1  # the string gave way to its value
    return Forest(doc, kind, parent, key, text)
