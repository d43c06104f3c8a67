"""Sequence-matcher ratio as an Arrow function; there is no built-in expression for it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 M / T over the matching blocks of two texts; null where either is null. The order of the
    arguments matters, as it does for the public library function."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def ratio_bound(a: Column, b: Column) -> Column:
    """At least the sequence-matcher ratio of two texts, from built-in expressions: no more characters can match
    than both have, in whatever order; 1 for two empty texts."""
    count = lambda text, ch: F.length(text) - F.length(F.replace(text, ch, F.lit("")))
    common = F.aggregate(F.array_distinct(F.filter(F.split(a, ""), lambda ch: ch != "")), F.lit(0), lambda n, ch: n + F.least(count(a, ch), count(b, ch)))
    both = F.length(a) + F.length(b)
    by_length = 2 * F.least(F.length(a), F.length(b)) / both
    return F.when(both == 0, 1.0).otherwise(F.least(by_length, 2 * common / both))
