"""Several values packed in one text field: split into one value per row, position kept.

Quoted spans are swapped for indexed placeholders, the remaining delimiters split the text, and
an array lookup puts the spans back. The placeholder characters are private-use code points;
where the text itself holds one, that character is treated as a span of its own and comes back by
the same lookup, so no text can collide with a placeholder. All steps are built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPEN, _CLOSE = "", ""
# An apostrophe opens or closes a quoted span only where no letter or digit stands on its outer side.
_SPANS = (
    r'"[^"]*+(?:""[^"]*+)*+"'
    r"|“[^”]*+”"
    r"|(?<![\p{L}\p{N}])'[^']*+(?:(?:''|(?<=[\p{L}\p{N}])'(?=[\p{L}\p{N}]))[^']*+)*+'(?![\p{L}\p{N}'])"
    f"|{_OPEN}|{_CLOSE}"
)
_DELIMITERS = r"[,;|\t\r\n\x0B\f\u0085  ]|(?<!\S)/(?!\S)"
_OUTER = r"(?U)^\s+|\s+$"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, _OUTER, "")


def split_packed(text: Column) -> Column:
    """The values of ``text`` in order, as an array of strings.

    Null, empty and blank texts, and texts of delimiters only, give an empty array.
    """
    text = F.coalesce(text, F.lit(""))
    spans = F.regexp_extract_all(text, F.lit(_SPANS), F.lit(0))
    held = F.array_join(
        F.transform(
            F.split(text, _SPANS, -1),
            lambda piece, i: F.when(i == 0, piece).otherwise(F.concat(F.lit(_OPEN), (i - 1).cast("string"), F.lit(_CLOSE), piece)),
        ),
        "",
    )

    def restore(part: Column, own: Column) -> Column:
        pieces = F.split(part, f"[{_OPEN}{_CLOSE}]", -1)
        whole = F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, F.get(own, p.cast("int"))).otherwise(p)), "")
        return F.struct(part.rlike(f"^{_OPEN}[0-9]+{_CLOSE}$").alias("alone"), whole.alias("whole"))

    def unquote(value: Column) -> Column:
        whole = value["whole"]
        inner = F.substring(whole, F.lit(2), F.length(whole) - 2)
        first = F.substring(whole, 1, 1)
        opened = (
            F.when(first == '"', F.replace(inner, F.lit('""'), F.lit('"')))
            .when(first == "'", F.replace(inner, F.lit("''"), F.lit("'")))
            .when(first == "“", inner)
            .otherwise(whole)
        )
        return _strip(F.when(value["alone"], opened).otherwise(whole))

    # A lambda's argument is computed once, so the spans are bound to one instead of being found again for each value.
    bound = F.array(F.struct(spans.alias("spans"), held.alias("held")))
    parts = F.transform(
        bound,
        lambda b: F.filter(
            F.transform(F.transform(F.split(b["held"], _DELIMITERS, -1), lambda p: restore(_strip(p), b["spans"])), unquote),
            lambda v: v != "",
        ),
    )
    return F.element_at(parts, 1)


def explode_packed(df: DataFrame, id_col: str, fields: list[str], least: int = 2) -> DataFrame:
    """(id, field_name, pos, part_value): one row for each value of each field of ``fields`` that
    holds ``least`` or more values. No shuffle. Null ids are kept; repeated rows give repeated
    results; other columns of ``df`` are not read.
    """
    packed = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), split_packed(F.col(f"`{f}`")).alias("parts")) for f in fields]))
    rows = df.select(F.col(f"`{id_col}`").alias("_id"), packed.alias("_f"))
    return (
        rows.filter(F.size("_f.parts") >= least)
        .select("_id", F.col("_f.field_name").alias("field_name"), F.posexplode("_f.parts").alias("_p", "part_value"))
        .select(F.col("_id").alias(id_col), "field_name", (F.col("_p") + 1).cast("int").alias("pos"), "part_value")
    )
