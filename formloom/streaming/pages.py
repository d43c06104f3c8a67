"""Structured Streaming: page state, memo, windows, and page files as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ITEM_SCHEMA = "doc_id long, pos long, tag string, text string"
_OUT = "doc_id long, pos long, tag string, text string, form string, section string, qid string"
_STATE = "form string, section string, asked long"


def carry_context(items: DataFrame) -> DataFrame:
    """Form, section and question number carried from page to page of each document.

    Items of a document must arrive in order over the batches; within a batch they are ordered by
    position here. The state of a document is three values, whatever its length.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        form, section, asked = state.get if state.exists else (None, None, 0)
        rows = pd.concat(list(frames)).sort_values("pos")
        out = []
        for pos, tag, text in zip(rows["pos"], rows["tag"], rows["text"]):
            if tag == "<FORM>":
                form = text
            elif tag == "<SH>":
                section = text
            elif tag == "<Q>":
                asked += 1
            out.append((key[0], pos, tag, text, form, section, f"q-{asked - 1:03d}" if asked else None))
        state.update((form, section, asked))
        yield pd.DataFrame(out, columns=["doc_id", "pos", "tag", "text", "form", "section", "qid"])

    return items.groupBy("doc_id").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def carry_context_batch(items: DataFrame) -> DataFrame:
    """The same on a finished table, as windows."""
    from formloom.operators.parse import running

    rows = running(items, ["doc_id"], ["pos"], F.when(F.col("tag") == "<FORM>", F.col("text")), "form")
    rows = running(rows, ["doc_id"], ["pos"], F.when(F.col("tag") == "<SH>", F.col("text")), "section")
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    asked = F.sum((F.col("tag") == "<Q>").cast("long")).over(w)
    return rows.withColumn("qid", F.when(asked > 0, F.format_string("q-%03d", asked - 1)))


def memo(stream: DataFrame, key: str, time: str, delay: str = "7 days") -> DataFrame:
    """First row of each key within the watermark; later rows of the key are left out until it expires."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def tumbling(stream: DataFrame, time: str, width: str, delay: str, keys: list[str]) -> DataFrame:
    """Extension: counts per window, late rows accepted up to ``delay``."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("started"), *keys, "n")


def sessions(stream: DataFrame, time: str, gap: str, delay: str, keys: list[str]) -> DataFrame:
    """Extension: counts per session of a key."""
    return stream.withWatermark(time, delay).groupBy(F.session_window(time, gap), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), *keys, "n")


def page_files(spark: SparkSession, folder: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """New page files of a folder as a stream, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("multiLine", True).option("pathGlobFilter", "page_*.json").json(folder)


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there into a folder and returns what it wrote."""
    q = stream.writeStream.format("parquet").option("path", path).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
