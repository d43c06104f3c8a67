"""Writers: pages, line files, corpora in three layouts, queues, audits and cached vectors."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_pages(items: DataFrame, path: str, doc: str = "doc_id") -> None:
    """SNK01, SNK03. Items as JSON, a folder for each document."""
    items.write.mode("overwrite").partitionBy(doc).json(path)


def write_lines(rows: DataFrame, path: str) -> None:
    """One JSON object a line."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_corpus(examples: DataFrame, path: str) -> None:
    """SNK06. Instruction examples as JSON lines, as instruction-input-output lines, and their counts."""
    write_lines(examples, f"{path}/examples")
    write_lines(examples.select("instruction", F.lit("").alias("input"), "output"), f"{path}/alpaca")
    examples.groupBy("step").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(f"{path}/metadata")


def write_split(rows: DataFrame, path: str) -> None:
    """SNK07. Rows by their split, in one pass."""
    rows.write.mode("overwrite").partitionBy("split").json(path)


def write_queue(rows: DataFrame, path: str, condition: str) -> bool:
    """SNK02. Rows that need a second look; nothing is written if there are none."""
    queue = rows.filter(condition)
    if queue.isEmpty():
        return False
    queue.write.mode("overwrite").json(path)
    return True


def append_audit(rows: DataFrame, path: str) -> None:
    """SNK08, MSC08. Audit rows with the time they were written."""
    rows.withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(path)


def vector_cache_key(model: str, counts: list[int]) -> str:
    """SNK09, HSH01. Name of a table of cached vectors."""
    import hashlib

    return hashlib.sha1(":".join([model, *map(str, counts)]).encode()).hexdigest()[:12]


def write_vectors(vectors: DataFrame, folder: str, model: str, counts: list[int]) -> str:
    path = f"{folder}/{vector_cache_key(model, counts)}"
    vectors.write.mode("overwrite").parquet(path)
    return path


def write_document(items: DataFrame, path: str, doc: str = "doc_id") -> None:
    """SNK01. The pages of documents, all their items as lines, and a summary of each document."""
    write_pages(items, f"{path}/pages", doc)
    write_lines(items, f"{path}/all_items")
    items.groupBy(doc).agg(F.count(F.lit(1)).alias("n_items"), F.countDistinct("tag").alias("n_tags")).write.mode("overwrite").json(f"{path}/summary")


def write_dictionary(tables: dict[str, DataFrame], path: str) -> None:
    """SNK04, SNK05. Dictionary tables as JSON lines, a folder for each, and a file that names them with their columns."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
    named = [(name, df.schema.json()) for name, df in sorted(tables.items())]
    spark.createDataFrame(named, "name string, columns string").coalesce(1).write.mode("overwrite").json(f"{path}/tables")


def read_dictionary(spark, path: str) -> dict[str, DataFrame]:
    """SRC11. The tables ``write_dictionary`` wrote, with their own columns."""
    from pyspark.sql.types import StructType

    named = spark.read.schema("name string, columns string").json(f"{path}/tables").collect()  # a row a table
    return {r.name: spark.read.schema(StructType.fromJson(json.loads(r.columns))).json(f"{path}/{r.name}") for r in named}


def write_mapping(pairs: DataFrame, key: str, value: str, path: str) -> None:
    """SRC15. A mapping from keys to sets of values, each set as a sorted list."""
    pairs.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("members")).write.mode("overwrite").json(path)


def read_mapping(spark, path: str, key: str, value: str) -> DataFrame:
    """The pairs of a mapping that ``write_mapping`` wrote."""
    return spark.read.schema(f"{key} string, members array<string>").json(path).select(key, F.explode("members").alias(value))


def write_package(examples: DataFrame, tables: dict[str, DataFrame], settings: dict[str, str], path: str) -> None:
    """SNK10. A training package: the corpus, the dictionary it was made with, and its settings."""
    write_corpus(examples, f"{path}/corpus")
    write_dictionary(tables, f"{path}/dictionary")
    examples.sparkSession.createDataFrame(sorted(settings.items()), "setting string, given string").coalesce(1).write.mode("overwrite").json(f"{path}/settings")
