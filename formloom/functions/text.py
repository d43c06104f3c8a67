"""Column functions on text: tokens, normal forms, codes, ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normal_space(c: Column) -> Column:
    """Lower case, runs of white space to one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def bare_option(c: Column) -> Column:
    """An answer option without the boxes and brackets before it."""
    return strip(F.regexp_replace(c, r"^[\s\[\]()○●□■☐☑]+", ""))


def tokens(c: Column, least: int = 1) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text, of at least ``least`` characters."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: F.length(t) >= least)


def phrases(words: Column, longest: int = 3) -> Column:
    """All runs of one to ``longest`` words, joined by a blank."""
    def runs(w: Column, n: int) -> Column:
        last = F.size(w) - (n - 1)
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))

    # Bound to a lambda's argument, the words are made once and not again for each run.
    return F.element_at(F.transform(F.array(words), lambda w: F.concat(*[runs(w, n) for n in range(1, longest + 1)])), 1)


def trailing_code(label: Column) -> Column:
    """The code in brackets at the end of a label, else null."""
    return F.nullif(F.regexp_extract(label, r"\(([A-Z0-9_]+)\)\z", 1), F.lit(""))


def slug(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9_-]", "_")


def initials(words: Column, most: int = 8) -> Column:
    """Upper-case first letters of the words."""
    return F.substring(F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")), 1, most)


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def contains_any(c: Column, needles: list[str]) -> Column:
    """Whether the text holds any of the literal ``needles``."""
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(c, F.lit(n))
    return out


def first_match(c: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The value of the first rule whose literal the text holds."""
    out = None
    for needle, value in rules:
        hit = F.contains(c, F.lit(needle))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(default) if out is not None else F.lit(default)
