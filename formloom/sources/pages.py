"""Readers of page files, gold annotations, dictionaries and terminology, and a cached REST source (SRC01 to SRC16)."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "seq bigint, tag string, text string, page bigint, qid string, parent_qid string, input_type string, question_below_text string, form string, section string, bbox_xyxy array<double>, bbox_ref string"
PAGE_SCHEMA = f"page_id int, items array<struct<{ITEM.replace(' ', ':').replace(',:', ', ')}>>, broken string"
GOLD = "qid:string, seq:int, text:string, annotation:string, domain:string, pattern:string, confidence:double, valid:boolean, requires_separate_annotations:boolean, question_annotation:string, option_annotations:variant, form:string, section:string"
GOLD_SCHEMA = f"file string, page_id int, annotations array<struct<{GOLD}>>, broken string"


def read_pages(spark: SparkSession, folder: str, glob: str = "page_*.json") -> DataFrame:
    """SRC04 to SRC06. Items of all page files of a folder in file order; a file that does not parse gives one row with
    its text in ``broken`` and no item."""
    raw = spark.read.schema(PAGE_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").option("pathGlobFilter", glob).json(folder)
    return raw.select(F.col("_metadata.file_name").alias("file_name"), "page_id", "broken", F.explode_outer("items").alias("item")).select("file_name", "page_id", "broken", "item.*")


def read_gold(spark: SparkSession, folder: str) -> DataFrame:
    """SRC12. Annotations of gold pages with option annotations as a variant, as they come in several shapes;
    rows with a blank text or annotation are kept, see ``usable_gold``."""
    raw = spark.read.schema(GOLD_SCHEMA).option("multiLine", True).option("columnNameOfCorruptRecord", "broken").option("pathGlobFilter", "page_*_result.json").json(folder)
    page = F.regexp_extract(F.col("_metadata.file_name"), r"page_(\d+)", 1).cast("int")
    return raw.select(page.alias("page"), F.explode("annotations").alias("a")).select("page", "a.*")


def usable_gold(gold: DataFrame) -> DataFrame:
    return gold.filter((F.trim("text") != "") & (F.trim("annotation") != ""))


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """SRC08. Terms of a terminology package, two nested levels flattened."""
    schema = "codelists array<struct<codelist:struct<ncitCode:string, shortName:string, definition:string, extensible:string>, terms:array<struct<submissionValue:string, preferredTerm:string, definition:string, synonyms:array<string>, ncitCode:string>>>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("codelists").alias("c"))
    return raw.select(F.col("c.codelist.ncitCode").alias("codelist_code"), F.col("c.codelist.shortName").alias("codelist_name"), F.explode("c.terms").alias("t")).select("codelist_code", "codelist_name", "t.*")


def read_variables(spark: SparkSession, path: str) -> DataFrame:
    """SRC09, MSC10. Variables from either shape of the file: a list of rows, or an object of rows by domain."""
    text = spark.read.text(path, wholetext=True)
    row = "struct<domain:string, name:string, label:string, type:string, role:string, core:string, codelist:string>"
    as_list = text.select(F.explode_outer(F.from_json("value", f"array<{row}>")).alias("v")).filter("v.name IS NOT NULL")
    as_map = text.select(F.explode_outer(F.from_json("value", f"map<string, array<{row}>>")).alias("d", "l")).select("d", F.explode("l").alias("v"))
    return as_list.select("v.*").unionByName(as_map.select(F.coalesce("v.domain", "d").alias("domain"), "v.name", "v.label", "v.type", "v.role", "v.core", "v.codelist"))


def is_pointer(text: str) -> bool:
    """Whether a file holds a large-file pointer in place of its content."""
    return text.startswith("version https://git-lfs")


def first_readable(paths: list[str], spark: SparkSession | None = None) -> str | None:
    """SRC07, MSC06. The first path that exists and holds content; None leads to the seed tables. With a session
    the paths are those of its file systems, such as a cluster's shared folder; without, of this machine."""
    for p in paths:
        if spark is not None:
            at = spark._jvm.org.apache.hadoop.fs.Path(p)
            if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
                first = spark.read.text(p).head(1)
                if first and not is_pointer(first[0].value):
                    return p
        elif os.path.exists(p):
            with open(p, encoding="utf-8", errors="replace") as f:
                if not is_pointer(f.read(64)):
                    return p
    return None


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


class CachedSource:
    """SRC13, DTE01. JSON answers of an endpoint kept as files. A fresh answer is used as it is; else ``fetch`` is
    asked, at most once each ``pause`` seconds; if it fails, an expired answer serves."""

    def __init__(self, folder: str, fetch: Callable[[str], dict] | None, max_age: float = 7 * 86400, pause: float = 0.5):
        self.folder, self.fetch, self.max_age, self.pause, self._last = folder, fetch, max_age, pause, 0.0
        os.makedirs(folder, exist_ok=True)

    def get(self, endpoint: str) -> dict | None:
        path = os.path.join(self.folder, endpoint.strip("/").replace("/", "_") + ".json")
        old = os.path.exists(path)
        if old and time.time() - os.path.getmtime(path) < self.max_age:
            with open(path, encoding="utf-8") as f:
                return json.load(f)
        if self.fetch is not None:
            time.sleep(max(0.0, self._last + self.pause - time.time()))
            self._last = time.time()
            try:
                got = self.fetch(endpoint)
            except Exception:
                got = None
            if got is not None:
                with open(path, "w", encoding="utf-8") as f:
                    json.dump(got, f)
                return got
        if old:
            with open(path, encoding="utf-8") as f:
                return json.load(f)
        return None

    def frame(self, spark: SparkSession, endpoint: str, links: str) -> DataFrame:
        """SRC14. The (href, title, type) links under ``links`` of an answer; none if there is no answer."""
        got = self.get(endpoint) or {}
        rows = [(x.get("href"), x.get("title"), x.get("type")) for x in (got.get("_links") or {}).get(links, [])]
        return spark.createDataFrame(rows, "href string, title string, type string")


def normalise_box(df: DataFrame, width: str, height: str) -> DataFrame:
    """SRC01 to SRC03, where lines were extracted before. x1, y1, x2, y2 as shares of the page; null where the page has no size."""
    w, h = F.nullif(F.col(width), F.lit(0)), F.nullif(F.col(height), F.lit(0))
    return df.withColumns({"x1": F.col("x1") / w, "x2": F.col("x2") / w, "y1": F.col("y1") / h, "y2": F.col("y2") / h})
