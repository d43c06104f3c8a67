"""Annotation texts: shapes, patterns, codes, grammar and confidence, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom.functions import text as tx

# Words left out of generated codes.
STOP = ["the", "a", "an", "of", "in", "on", "for", "to", "and", "or", "was", "is", "any", "if", "please", "specify", "other"]

NAME = "[A-Z][A-Z0-9]{1,7}"
GRAMMAR = {
    "not_submitted": r"^\[NOT SUBMITTED\]$",
    "supplemental": rf"^{NAME} in SUPP[A-Z]{{2}}$",
    "conditional": rf"^{NAME} when {NAME} = [A-Z0-9]+$",
    "with_term": rf"^{NAME} = .+$",
    "plain": rf"^{NAME}$",
}


def pattern_of(annotation: Column) -> Column:
    """The first grammar rule a value keeps, else 'none'; null and blank values have none."""
    v = tx.strip(annotation)
    out = None
    for name, rule in GRAMMAR.items():
        hit = v.rlike(rule)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.when(v != "", out.otherwise("none"))


def value_shape(text: Column, options: Column) -> Column:
    """What kind of value a question asks for, by its wording and options; first rule wins."""
    t, o = F.lower(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(options, F.lit("")))
    return (
        F.when(t.rlike(r"\b(mmhg|cm|kg|mg|bpm|units?)\b"), "NUM_UNIT")
        .when(t.rlike(r"\b(date|time)\b"), "DATE")
        .when(o.rlike("yes") & o.rlike(r"\bno\b"), "YN")
        .when(o.rlike("mild") & o.rlike("severe"), "ORDINAL")
        .when(t.rlike(r"\b(number|rate|score|how many)\b"), "NUMERIC")
        .otherwise("TEXT")
    )


def short_code(label: Column) -> Column:
    """Code of at most eight letters: the first four letters of the first two words that say something."""
    w = F.filter(tx.tokens(label), lambda x: ~x.isin(STOP))
    two = F.transform(F.slice(w, 1, 2), lambda x: F.substring(x, 1, 4))
    return F.when(F.size(w) == 0, "MISCOTH").otherwise(F.upper(F.array_join(two, "")))


def initials_code(label: Column) -> Column:
    """Initials of up to four words that say something, with OTH added below three letters."""
    w = F.slice(F.filter(tx.tokens(label), lambda x: ~x.isin(STOP)), 1, 4)
    s = tx.initials(w)
    return F.when(F.length(s) == 0, "MISCOTH").when(F.length(s) < 3, F.concat(s, F.lit("OTH"))).otherwise(s)


def render(pattern: Column, variable: Column, condition: Column, value: Column, domain: Column) -> Column:
    """The annotation text of a mapping by its pattern."""
    return (
        F.when(pattern == "conditional", F.concat(variable, F.lit(" when "), condition, F.lit(" = "), value))
        .when(pattern == "supplemental", F.concat(variable, F.lit(" in SUPP"), domain))
        .when(pattern == "with_term", F.concat(variable, F.lit(" = "), value))
        .when(pattern == "not_submitted", F.lit("[NOT SUBMITTED]"))
        .otherwise(variable)
    )


def grammar_errors(values: DataFrame, value: str, domain: str) -> Column:
    """Errors of an annotation value, in a fixed order, joined by ';'; empty if it is well formed."""
    v = tx.strip(F.col(value))
    p = pattern_of(F.col(value))
    supp = F.regexp_extract(v, r" in SUPP([A-Z]{2})$", 1)
    qnam = F.regexp_extract(v, r"^(\S+) in SUPP", 1)
    return F.array_join(
        F.array_compact(
            F.array(
                F.when(p == "none", "no pattern"),
                F.when((p == "supplemental") & ~F.upper(F.coalesce(F.col(domain), F.lit(""))).contains(supp), "domain of supplement differs"),
                F.when((qnam != "") & (F.length(qnam) > 8), "name longer than eight"),
                F.when((p == "conditional") & (F.substring(F.regexp_extract(v, "when (\\S+)", 1), 1, 2) != F.substring(v, 1, 2)), "condition of another domain"),
            )
        ),
        ";",
    )


def settle(parts: list[Column], least_each: float, least_first: float) -> tuple[Column, Column]:
    """(confidence, reason to abstain): the smallest part; the last rule that applies names the reason."""
    low = F.least(*parts)
    reason = F.when(low < least_each, "low confidence").when(parts[0] < least_first, "pattern unsure")
    return F.round(low, 6), reason
