"""Hand-typed values mapped to the closest entry of a reference list.

Typed values are deduplicated and normalised. An inverted index of character n-grams over every
wording of every entry gives the candidates of a value's scope, scored by idf-weighted cosine; the best
one above a threshold whose wording typing errors can explain is accepted if it is clear of the next
entry by a margin. The index goes out in blocks of bounded size; values stay where they are.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom.operators.skew import split_join
from formloom.session import materialise

UNMATCHED = "[UNMATCHED]"


def compact(c: Column) -> Column:
    """Lower-case letters and digits only, accents kept, look-alike characters folded."""
    return _fold(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", ""))


def _fold(c: Column) -> Column:
    return F.translate(c, "01i5", "olls")  # fixed values: characters typed for one another


def _python_compact(text: str) -> str:
    """``compact`` of a Python string."""
    return re.sub(r"[\W_]", "", text.lower()).translate(str.maketrans("01i5", "olls"))


def _typed_words(c: Column) -> Column:
    """Words of a typed value; a full stop right after a word stays, as it may cut the word short."""
    return F.regexp_extract_all(_fold(F.lower(c)), F.lit(r"[\p{L}\p{N}]+[.]?"), F.lit(0))


def words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def wordings(entries: DataFrame) -> DataFrame:
    """(field_name, scope, canonical, form, strict) of each wording of each entry.

    ``entries`` has field_name, scope, canonical and texts (all wordings) and strict_texts
    (wordings that allow no typing error). Wordings of several words also stand with the first
    word last and the last word first.
    """
    base = entries.select("field_name", "scope", "canonical", F.explode(F.concat(
        F.transform("texts", lambda t: F.struct(words(t).alias("w"), F.lit(False).alias("strict"))),
        F.transform("strict_texts", lambda t: F.struct(words(t).alias("w"), F.lit(True).alias("strict"))),
    )).alias("_x")).select("field_name", "scope", "canonical", "_x.w", "_x.strict")
    n = F.size("w")
    turned = F.when(
        n > 1,
        F.array(
            F.col("w"),
            F.concat(F.slice("w", F.lit(2), n - 1), F.slice("w", 1, 1)),
            F.concat(F.slice("w", -1, 1), F.slice("w", F.lit(1), n - 1)),
        ),
    ).otherwise(F.array("w"))
    forms = base.filter(n > 0).select("field_name", "scope", "canonical", "strict", F.explode(turned).alias("w"))
    return (
        forms.select("field_name", "scope", "canonical", compact(F.array_join("w", "")).alias("form"), _fold(F.array_join("w", " ")).alias("spaced"), "strict")
        .groupBy("field_name", "scope", "canonical", "form").agg(F.min("strict").alias("strict"), F.min("spaced").alias("spaced"))
    )


def grams(form: str, starts: list[str]) -> set[str]:
    """Character 2- and 3-grams of a form with a border mark at either end, and the first one and two
    characters of each word, which are all that cut words leave."""
    padded = f"^{form}$"
    out = {padded[i : i + 2] for i in range(len(padded) - 1)}
    out.update([padded[i : i + 3] for i in range(len(padded) - 2)])
    for w in starts:
        out.add("_" + w[:1])
        out.add("_" + w[:2])
    return out


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with a swap of neighbours as one edit; ``most`` + 1 where it is beyond ``most``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most or not most:
        return most + 1
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return len(a) + len(b)
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            cost = min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            new.append(cost)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


def check(form: str, typed: list[str], wording: str, parts: list[str], strict: bool) -> int | None:
    """Edits between a typed value and a wording, or None where they are beyond what typing errors explain:
    one up to seven letters, two beyond, three from fifteen on where words run together; else, word by
    word, none up to two letters, one up to seven, two beyond, a word cut short by a full stop after
    two or more letters being free. Strict wordings allow none."""
    if form == wording:
        return 0
    if strict:
        return None
    longest = max(len(form), len(wording))
    budget = 1 if longest <= 7 else 3 if longest >= 15 and len(typed) != len(parts) else 2
    got = edits(form, wording, budget)
    found = got if got <= budget else None
    if len(typed) == len(parts) > 1:
        total = 0
        for t, w in zip(typed, parts):
            bare = t.rstrip(".")
            if t.endswith(".") and len(t) >= 3 and w.startswith(bare):
                continue
            n = max(len(bare), len(w))
            most = 0 if n <= 2 else 1 if n <= 7 else 2
            got = edits(bare, w, most)
            if got > most:
                return found
            total += got
        found = total if found is None else min(found, total)
    return found


class ScopeIndex:
    """Inverted index of the wordings of one scope (or of a part of it): ``rows`` are (canonical, form,
    spaced, strict); ``weights`` the squared idf of its grams, and ``rare`` that of any other."""

    def __init__(self, rows: list[tuple], weights: dict[str, float], rare: float):
        self.rows = [(c, f, s.split(" "), strict) for c, f, s, strict in rows]
        self.weights, self.rare = weights, rare
        self.exact: dict[str, list[int]] = {}
        post: dict[str, list[int]] = {}
        norm = np.zeros(len(rows))
        for i, (_, form, parts, _) in enumerate(self.rows):
            self.exact.setdefault(form, []).append(i)
            own = grams(form, parts)
            norm[i] = sum([weights[g] for g in own])
            for g in own:
                post.setdefault(g, []).append(i)
        self.norm = np.sqrt(norm)
        self.post = {g: np.asarray(ids, np.int32) for g, ids in post.items()}

    def best(self, form: str, typed: list[str], least_cosine: float, margin: float) -> list[tuple[str, int, float]]:
        """(canonical, edits, cosine) of the entry of the highest cosine whose wording passes the check, and,
        if one is within ``margin`` of it, of the next entry that passes."""
        score = np.zeros(len(self.rows))
        mine = 0.0
        for g in grams(form, [t.rstrip(".") for t in typed]):
            w = self.weights.get(g)
            mine += self.rare if w is None else w
            ids = self.post.get(g)
            if ids is not None:
                score[ids] += w
        score /= self.norm * (mine**0.5)
        near = np.flatnonzero(score >= least_cosine)
        near = near[np.argsort(-score[near], kind="stable")]
        found: list[tuple[str, int, float]] = []
        for i in near.tolist():
            cosine = float(score[i])
            if found and cosine < found[0][2] - margin:
                break
            canonical, wording, parts, strict = self.rows[i]
            if found and canonical == found[0][0]:
                continue
            got = check(form, typed, wording, parts, strict)
            if got is not None:
                found.append((canonical, got, cosine))
                if len(found) == 2:
                    break
        return found


def _weights(counts: dict[str, int], n: int) -> tuple[dict[str, float], float]:
    """Squared idf of grams by the number of wordings that hold them, and of a gram that none holds, which
    weighs as one that a single wording holds."""
    return {g: float(np.log(1 + n / c) ** 2) for g, c in counts.items()}, float(np.log(1 + n) ** 2)


def _blocks(forms: DataFrame, block_chars: int):
    """Parts of the dictionary of about ``block_chars`` characters: lists of (field_name, scope, rows, weights, rare).
    Scopes larger than a block are cut, and each part has the weights of the whole scope, whose number
    is that of its distinct 2- and 3-grams."""
    cols = ["field_name", "scope", "canonical", "form", "spaced", "strict"]
    held: list[tuple] = []
    block, size = [], 0

    def counted(rows):
        counts: Counter[str] = Counter()
        for r in rows:
            counts.update(grams(r["form"], r["spaced"].split(" ")))
        return counts

    key, part, chars, seen, n, cut = None, [], 0, Counter(), 0, None

    def close(last: bool):
        nonlocal block, size, part, chars
        if part:
            w, rare = _weights(counted(part), len(part)) if cut is None else cut
            block.append((*key, [tuple(r[c] for c in cols[2:]) for r in part], w, rare))
            size += chars
        part, chars = [], 0

    for r in forms.select(cols).orderBy(*cols).toLocalIterator(prefetchPartitions=True):
        if (r.field_name, r.scope) != key:
            close(True)
            key, cut = (r.field_name, r.scope), None
            if size >= block_chars:
                yield block
                block, size = [], 0
        part.append(r)
        chars += len(r.form)
        if chars >= block_chars:
            if cut is None:  # larger than a block: weights come from the whole scope
                whole = forms.filter(F.col("field_name").eqNullSafe(F.lit(key[0])) & F.col("scope").eqNullSafe(F.lit(key[1])))
                counts, n = Counter(), 0
                for x in whole.select("form", "spaced").toLocalIterator():
                    counts.update(grams(x.form, x.spaced.split(" ")))
                    n += 1
                cut = _weights(counts, n)
            close(False)
            yield block
            block, size = [], 0
    close(True)
    if block:
        yield block


_INDEX: dict[str, dict] = {}  # of a worker; by block


def _bare(form: str, prefix: str) -> str:
    return form[len(prefix) :] if form.startswith(prefix) and len(form) > len(prefix) + 2 else form


def map_values(values: DataFrame, entries: DataFrame, least_cosine: float = 0.1, margin: float = 0.02, block_chars: int = 4_000_000) -> DataFrame:
    """(field_name, scope, value, canonical, edits, cosine) for each distinct (field_name, scope, value).

    A value is compared with entries of its own field and scope only. Candidates come from the inverted
    index; those of a cosine of ``least_cosine`` or more are taken from the best on, and the first
    whose wording passes ``check`` is accepted, unless another entry that passes is within ``margin``.
    Else the value is '[UNMATCHED]'. A value that is exactly a wording known in other scopes of its
    field only, and no exact wording here, is unmatched, as something else is meant. Values without
    letters or digits, and values whose scope has no entries, are unmatched. Null values must be left
    out by the caller. An edit in a wording of two letters leaves too little of it for the threshold. The dictionary goes out in blocks of about ``block_chars`` characters, each held
    against all distinct values; the best of all blocks counts.
    """
    spark = values.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    distinct = values.select("field_name", "scope", "value").distinct().repartition(tasks)
    asked = distinct.select("field_name", "scope", "value", compact(F.col("value")).alias("form"), _typed_words(F.col("value")).alias("typed"), compact(F.col("scope")).alias("prefix"))
    forms = materialise(wordings(entries), "wordings")
    schema = "field_name string, scope string, value string, foreign boolean, found array<struct<canonical:string, edits:int, cosine:double>>"
    parts = []
    for block in _blocks(forms, block_chars):
        sent, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, name=name) -> Iterator[pa.RecordBatch]:
            if name not in _INDEX:
                _INDEX.clear()
                bare: dict[str, set[str]] = {}
                for field, scope, rows, _, _ in sent.value:
                    prefix = _python_compact(scope)
                    bare.setdefault(field, set()).update(_bare(r[1], prefix) for r in rows)
                _INDEX[name] = {"bare": bare, "scopes": {(f, s): ScopeIndex(rows, w, rare) for f, s, rows, w, rare in sent.value}}
            index = _INDEX[name]
            for batch in batches:
                foreign, found = [], []
                for field, scope, form, typed, prefix in zip(*[batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5)]):
                    own = index["scopes"].get((field, scope))
                    found.append([] if own is None or not form else [{"canonical": c, "edits": e, "cosine": x} for c, e, x in own.best(form, typed, least_cosine, margin)])
                    foreign.append(_bare(form, prefix) in index["bare"].get(field, ()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(foreign), pa.array(found, pa.list_(pa.struct([("canonical", pa.string()), ("edits", pa.int32()), ("cosine", pa.float64())])))], names=["field_name", "scope", "value", "foreign", "found"])

        parts.append(asked.mapInArrow(run, schema))
    if not parts:
        return distinct.select("field_name", "scope", "value", F.lit(UNMATCHED).alias("canonical"), F.lit(None).cast("int").alias("edits"), F.lit(None).cast("double").alias("cosine"))
    merged = parts[0]
    if len(parts) > 1:  # at most two candidates a block
        for p in parts[1:]:
            merged = merged.unionByName(p)
        merged = merged.groupBy("field_name", "scope", "value").agg(F.max("foreign").alias("foreign"), F.flatten(F.collect_list("found")).alias("found"))
    ranked = merged.withColumn("_r", F.array_sort(F.transform("found", lambda x: F.struct((-x["cosine"]).alias("neg"), x["canonical"].alias("canonical"), x["edits"].alias("edits")))))
    best = F.get("_r", F.lit(0))
    ranked = ranked.withColumn("_b", best)
    rival = F.exists("_r", lambda x: (x["canonical"] != F.col("_b.canonical")) & (x["neg"] - F.col("_b.neg") <= margin))
    good = F.col("_b").isNotNull() & ~rival & ((F.col("_b.edits") == 0) | ~F.col("foreign"))
    return ranked.select(
        "field_name", "scope", "value",
        F.when(good, F.col("_b.canonical")).otherwise(UNMATCHED).alias("canonical"),
        F.when(good, F.col("_b.edits")).alias("edits"),
        F.when(good, F.round(-F.col("_b.neg"), 6)).alias("cosine"),
    )


def entry_values(df: DataFrame) -> DataFrame:
    """One row per non-blank typed value: entry_id, field_name, scope, value."""
    both = F.explode(F.array(
        F.struct(F.lit("annotation").alias("f"), F.col("domain_code").alias("s"), F.col("annotation").alias("v")),
        F.struct(F.lit("submission_value").alias("f"), F.col("codelist_code").alias("s"), F.col("submission_value").alias("v")),
    ))
    rows = df.select("entry_id", both.alias("x")).select("entry_id", F.col("x.f").alias("field_name"), F.coalesce(F.upper(F.trim("x.s")), F.lit("")).alias("scope"), F.col("x.v").alias("value"))
    return rows.filter(F.regexp_replace("value", r"(?U)\s", "") != "")


def dictionary_entries(variables: DataFrame, terms: DataFrame) -> DataFrame:
    """The reference list: variables by domain, terms by codelist, with all their wordings."""
    code = F.upper(F.trim("domain_code"))
    rest = F.when(F.upper("var_name").startswith(code) & (F.length("var_name") >= F.length(code) + 3), F.substring(F.col("var_name"), F.length(code) + 1, F.length("var_name")))
    v = variables.filter(F.col("var_name").isNotNull()).select(
        F.lit("annotation").alias("field_name"), F.coalesce(code, F.lit("")).alias("scope"), F.col("var_name").alias("canonical"),
        F.array_compact(F.array("var_name", "label")).alias("texts"), F.array_compact(F.array(rest)).alias("strict_texts"),
    )
    t = terms.filter(F.col("submission_value").isNotNull()).select(
        F.lit("submission_value").alias("field_name"), F.coalesce(F.upper(F.trim("codelist_code")), F.lit("")).alias("scope"), F.col("submission_value").alias("canonical"),
        F.array_compact(F.concat(F.array("submission_value", "preferred_term"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("texts"),
        F.array().cast("array<string>").alias("strict_texts"),
    )
    return v.unionByName(t).distinct()


def map_entries(df: DataFrame, variables: DataFrame, terms: DataFrame) -> DataFrame:
    """(entry_id, field_name, canonical) of every non-blank typed value of ``df``."""
    rows = entry_values(df)
    mapped = materialise(map_values(rows, dictionary_entries(variables, terms)), "mapped-values")
    return split_join(rows, mapped.select("field_name", "scope", "value", "canonical"), ["field_name", "scope", "value"]).select("entry_id", "field_name", "canonical")
