"""Nested question records turned into flat linked rows.

The structural index (``jsonindex``) yields one node table for a batch of payloads; questions,
options and their nearest enclosing option are then found by following parent links for all nodes
at once. Payloads never leave their task, so the operator shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from formloom.operators import jsonindex as jx

_LISTS = ("option_annotations", "sub_options")
# Under these keys a text stays a text, whatever it looks like.
_OPAQUE = frozenset({"annotation", "question_annotation", "option", "text", "qid", "note", "file"})
_CHUNK_BYTES = 4 << 20


def _rows(payloads: list[bytes]):
    f = jx.forest(payloads, _OPAQUE)
    n = f.doc.size
    none = np.zeros(0, np.int64)
    if not n:
        return none, [], [], [], []
    alive = f.doc >= 0
    par = f.parent
    safe = np.maximum(par, 0)
    is_list = alive & ((f.key == _LISTS[0]) | (f.key == _LISTS[1])).astype(bool) & (par >= 0)
    is_list &= np.where(par >= 0, f.kind[safe] == jx.OBJ, False)

    child: dict[str, np.ndarray] = {}
    for name in ("qid", "question_annotation", "option", "annotation"):
        at = np.full(n, -1, np.int64)
        hit = np.flatnonzero(alive & (f.key == name) & (par >= 0))
        at[par[hit]] = hit
        child[name] = at

    has_list = np.zeros(n, bool)
    hit = np.flatnonzero(is_list & (f.key == "option_annotations"))
    has_list[par[hit]] = True
    question = alive & (f.kind == jx.OBJ) & (has_list | (child["question_annotation"] >= 0) | (child["qid"] >= 0))

    under_list = alive & (par >= 0) & is_list[safe]
    own_option = is_list & (f.kind == jx.OBJ) & (child["option"] >= 0)  # a single option in place of a list
    in_array = under_list & (f.kind[safe] == jx.ARR) & np.isin(f.kind, [jx.OBJ, jx.STR])
    in_object = under_list & (f.kind[safe] == jx.OBJ) & ~own_option[safe]
    lone_text = is_list & (f.kind == jx.STR)
    option = in_array | in_object | own_option | lone_text

    def nearest(mask: np.ndarray, of: np.ndarray) -> np.ndarray:
        found = np.full(of.size, -1, np.int64)
        cur = par[of]
        open_ = cur >= 0
        while open_.any():
            good = np.zeros(of.size, bool)
            good[open_] = mask[cur[open_]]
            found[good] = cur[good]
            open_ &= ~good
            cur[open_] = par[cur[open_]]
            open_ &= cur >= 0
        return found

    opts = np.flatnonzero(option)
    label = np.empty(n, object)
    note = np.empty(n, object)

    def text_of(i: int) -> str:
        return "" if i < 0 or f.text[i] is None else f.text[i]

    for i in opts:
        if in_object[i]:
            label[i] = f.key[i]
            note[i] = text_of(child["annotation"][i]) if f.kind[i] == jx.OBJ else text_of(i)
        elif f.kind[i] == jx.OBJ:
            label[i] = text_of(child["option"][i])
            note[i] = text_of(child["annotation"][i])
        else:
            a, _, b = text_of(i).partition(": ")
            label[i], note[i] = a, b
    blank = np.fromiter((lone_text[i] and not label[i].strip() and not note[i] for i in opts), bool, opts.size)
    opts = opts[~blank]
    of_q = nearest(question, opts)
    of_o = nearest(option, opts)
    keep = of_q >= 0
    opts, of_q, of_o = opts[keep], of_q[keep], of_o[keep]

    quests = np.flatnonzero(question & (child["question_annotation"] >= 0))
    quests = np.asarray([q for q in quests if text_of(child["question_annotation"][q]).strip()], np.int64)
    docs = np.concatenate([f.doc[opts], f.doc[quests]])
    qids = [text_of(child["qid"][q]) for q in of_q] + [text_of(child["qid"][q]) for q in quests]
    parents = ["" if o < 0 else label[o] for o in of_o] + [""] * quests.size
    labels = [label[i] for i in opts] + [""] * quests.size
    notes = [note[i] for i in opts] + [text_of(child["question_annotation"][q]) for q in quests]
    return docs, qids, parents, labels, notes


def flatten_options(df: DataFrame, id_col: str = "result_id", payload_col: str = "payload") -> DataFrame:
    """(id, qid, parent_option, option_label, annotation): one row per option of each question and
    per non-blank question_annotation, at whatever depth of the payload.

    Invalid, blank and null payloads give no rows; repeated payloads give rows for each id; missing
    or null texts are ''. Numbers and booleans in place of texts come as they are written, and so do
    objects and arrays in place of an annotation. Half of a surrogate pair becomes U+FFFD. Other
    columns of ``df`` are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            held: list[bytes] = []
            at: list[int] = []
            size = 0

            def flush():
                docs, qids, parents, labels, notes = _rows(held)
                where = pa.array(np.asarray(at, np.int64)[docs] if len(docs) else np.zeros(0, np.int64))
                return pa.RecordBatch.from_arrays(
                    [ids.take(where), *(pa.array(x, pa.string()) for x in (qids, parents, labels, notes))],
                    names=[id_col, "qid", "parent_option", "option_label", "annotation"],
                )

            for i in range(batch.num_rows):
                value = texts[i].as_py()
                if value is None or not value.strip():
                    continue
                raw = value.encode("utf-8", "replace")
                held.append(raw)
                at.append(i)
                size += len(raw)
                if size >= _CHUNK_BYTES:
                    yield flush()
                    held, at, size = [], [], 0
            if held:
                yield flush()

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, payload_col).mapInArrow(run, f"`{id_col}` {kind}, qid string, parent_option string, option_label string, annotation string")
