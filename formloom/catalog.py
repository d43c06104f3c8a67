"""Access to the tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where the input has fewer splits than the session has cores, as with
    one small file; larger inputs, which have splits enough, stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if 0 < splits < cores // 2 else df
