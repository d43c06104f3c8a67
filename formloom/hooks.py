"""Places for encoders, rerankers and generators, with deterministic defaults.

A hook works on Arrow batches, so a model is loaded once per worker. The defaults need no model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom.functions import text as tx

Batches = Iterator[pd.DataFrame]


def hashed_vector(words: Column, size: int = 64) -> Column:
    """Default encoder: counts of hashed words."""
    slots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(size)))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("float"))


def shared_words(a: Column, b: Column) -> Column:
    """Default reranker: share of the query's words that the text has."""
    q = F.array_distinct(tx.tokens(a))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tx.tokens(b))) / F.size(q)).otherwise(0.0)


def rule_answer(text: Column) -> Column:
    """Default generator: the answer's pattern by simple cues of the question."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low.rlike("other,? *specify"), "supplemental").when(low.rlike(r"\b(result|score|rate)\b"), "findings").when(low.rlike(r"\bdate\b"), "plain").otherwise("direct")


def generate(df: DataFrame, prompt: str, name: str, load: Callable[[], Callable[[list[str]], list[str]]] | None = None, batch: int = 32) -> DataFrame:
    """Adds the answers to ``prompt``. ``load`` makes the model, once per worker; without it the default
    generator answers in the plan itself. Prompts that fail get null."""
    if load is None:
        return df.withColumn(name, rule_answer(F.col(prompt)))

    def run(frames: Batches) -> Batches:
        model = load()
        for pdf in frames:
            out: list[str | None] = []
            texts = pdf[prompt].tolist()
            for i in range(0, len(texts), batch):
                part = texts[i : i + batch]
                try:
                    out += model(part)
                except Exception:
                    out += [None] * len(part)
            yield pdf.assign(**{name: out})

    return df.mapInPandas(run, _with(df, name))


def _with(df: DataFrame, name: str):
    from pyspark.sql import types as T

    return T.StructType([*df.schema.fields, T.StructField(name, T.StringType())])
