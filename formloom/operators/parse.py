"""Tagged page text to rows: lines, tags, inputs, sections, ids, fields and supplements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formloom.functions.text import contains_any, strip

TAGS = ["<FORM>", "<SH>", "<Q>", "<INPUT>"]
# Answers that are options, and marks of a blank to write in.
CHOICES = ["yes", "no", "n/a", "unknown", "not done"]
BLANKS = ["___", "dd-mmm-yyyy", "hh:mm", "/___/", "|__|"]
OPTION_MARKS = ["□", "○"]
ABORT = {"<SH>": "SH_NOT_FOUND", "<FORM>": "FORM_NOT_FOUND"}


def lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, line): trimmed non-blank lines with their position from 1. Null texts give none."""
    return (
        df.select(F.col(id_col), F.posexplode(F.split(F.col(text_col), r"\r\n|\r|\n", -1)).alias("_p", "_l"))
        .select(id_col, (F.col("_p") + 1).cast("long").alias("pos"), strip(F.col("_l")).alias("line"))
        .filter(F.col("line") != "")
    )


def input_kind(text: Column) -> Column:
    """option, text or free: known answers, blanks, long texts, boxes; else text."""
    low = F.lower(text)
    return (
        F.when(low.isin(CHOICES), "option")
        .when(contains_any(low, BLANKS), "text")
        .when(F.length(text) > 50, "free")
        .when(F.substring(text, 1, 1).isin(OPTION_MARKS), "option")
        .otherwise("text")
    )


def tagged(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, tag, text, below, input_type) of the tagged lines. A section header's text is split
    at its first bar: what follows is the question below it, 'none' if absent. Pages in which a
    whole line says that a pass found nothing lose the tag of that pass."""
    rows = lines(df, id_col, text_col)
    tag = F.regexp_extract("line", "^(<FORM>|<SH>|<Q>|<INPUT>)", 1)
    hit = rows.withColumn("tag", tag)
    aborted = hit
    for t, word in ABORT.items():
        flag = F.max((F.col("line") == word).cast("int")).over(Window.partitionBy(id_col))
        aborted = aborted.withColumn("_a" + t.strip("<>"), flag)
    body = strip(F.expr("substring(line, length(tag) + 1)"))
    parts = F.split(F.col("_b"), r"\|", 2)
    return (
        aborted.filter(F.col("tag") != "")
        .filter(~((F.col("tag") == "<SH>") & (F.col("_aSH") == 1)) & ~((F.col("tag") == "<FORM>") & (F.col("_aFORM") == 1)))
        .withColumn("_b", body)
        .select(
            id_col,
            "pos",
            "tag",
            F.when(F.col("tag") == "<SH>", strip(parts[0])).otherwise(F.col("_b")).alias("text"),
            F.when(F.col("tag") == "<SH>", F.coalesce(F.nullif(strip(F.get(parts, F.lit(1))), F.lit("")), F.lit("none"))).alias("below"),
            F.when(F.col("tag") == "<INPUT>", input_kind(F.col("_b"))).alias("input_type"),
        )
    )


def running(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the last non-null ``value`` up to each row, by ``order`` within ``keys``."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def question_ids(items: DataFrame, doc: str, order: list[str]) -> DataFrame:
    """qid of each question and parent_qid of each input: a running number per document; inputs before
    any question have the parent 'orphan'."""
    w = Window.partitionBy(doc).orderBy(*order)
    asked = F.sum((F.col("tag") == "<Q>").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    number = F.format_string("q-%03d", F.col("_n") - 1)
    return (
        items.withColumn("_n", asked)
        .withColumn("qid", F.when(F.col("tag") == "<Q>", number))
        .withColumn("parent_qid", F.when(F.col("tag") == "<INPUT>", F.when(F.col("_n") > 0, number).otherwise("orphan")))
        .drop("_n")
    )


def fields(items: DataFrame, doc: str) -> DataFrame:
    """One row per question with its inputs: kind of field, options in order and units. Two inputs or
    fewer with an option make a radio, more a checkbox; without options, a hint of a date makes a
    date. Inputs without a question are left out."""
    q = items.filter(F.col("tag") == "<Q>").select(doc, "qid", F.col("text").alias("label"))
    i = (
        items.filter((F.col("tag") == "<INPUT>") & (F.col("parent_qid") != "orphan"))
        .groupBy(doc, F.col("parent_qid").alias("qid"))
        .agg(
            F.count(F.lit(1)).alias("n_inputs"),
            F.count_if(F.col("input_type") == "option").alias("n_options"),
            F.max(F.lower("text").rlike("yyyy|date").cast("int")).alias("_date"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("input_type") == "option", F.struct("pos", "text")))), lambda s: s["text"]), "|").alias("options"),
        )
    )
    unit = F.regexp_extract("label", r"\(([^)]+)\)\z", 1)
    j = q.join(i, [doc, "qid"], "left")
    return j.select(
        doc,
        "qid",
        "label",
        F.when(F.col("n_options") > 0, F.when(F.col("n_inputs") > 2, "checkbox").otherwise("radio")).when(F.col("_date") == 1, "date").otherwise("text").alias("input_type"),
        F.coalesce("options", F.lit("")).alias("options"),
        F.coalesce("n_inputs", F.lit(0)).cast("long").alias("n_inputs"),
        F.nullif(unit, F.lit("")).alias("units"),
    )


def fallback_questions(all_lines: DataFrame, doc: str, cues: list[str]) -> DataFrame:
    """Questions of untagged text: lines that end in '?', lines of more than five characters that end
    in ':' before a line with a box, and lines that hold a cue word."""
    w = Window.partitionBy(doc).orderBy("pos")
    nxt = F.lead("line").over(w)
    low = F.lower("line")
    why = (
        F.when(F.col("line").endswith("?"), "mark")
        .when(F.col("line").endswith(":") & (F.length("line") > 5) & nxt.rlike("[□○☐]"), "box")
        .when(contains_any(low, cues), "cue")
    )
    return all_lines.withColumn("reason", why).filter(F.col("reason").isNotNull())


def supplements(all_lines: DataFrame, items: DataFrame, doc: str) -> DataFrame:
    """Lines of a page that neither hold nor stand in any item text of the page. A page without
    items keeps all its lines; an item with an empty text covers every line of its page."""
    texts = items.select(F.col(doc).alias("_d"), F.col("text").alias("_t"))
    return all_lines.join(texts, (F.col(doc) == F.col("_d")) & (F.contains("line", "_t") | F.contains("_t", "line")), "left_anti")


def salvage_json(c: Column, schema: str) -> Column:
    """The struct of the outermost braces inside a text, null where none parses."""
    return F.from_json(F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit("")), schema)


def prefixed(c: Column, prefix: str) -> Column:
    """The rest of the line that begins with ``prefix`` and a colon, trimmed; null if there is none."""
    return F.nullif(strip(F.regexp_extract(c, f"(?m)^{prefix}:[ \\t]*([^\\r\\n]*)", 1)), F.lit(""))
