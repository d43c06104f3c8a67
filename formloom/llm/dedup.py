"""Records that differ in formatting only, collapsed with an incremental ledger.

Each record gets a canonical key: the letters and digits of its text and of its annotation values,
the values in sorted order, with its group. A ledger in a folder keeps, by bucket of the key, how many
copies each key has and its earliest representative. A new batch is aggregated by key first, then
full-outer-joined with the buckets it touches; counts add up and the earliest representative stays.
A manifest names the folder of each bucket, so a ledger can be opened again later and by others.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom.operators.packed import split_packed
from formloom.session import materialise, scratch_path

_SEP = "\u001f"


def letters(c: Column) -> Column:
    """Lower-case letters and digits of a text in order; marks on letters count as letters."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\p{N}]", "")


def canonical_key(group: Column, text: Column, packed: Column) -> Column:
    """128-bit digest of the group, the text's letters and the sorted packed values' letters."""
    values = F.array_sort(F.filter(F.transform(split_packed(packed), letters), lambda v: v != ""))
    grp = F.coalesce(F.concat(F.lit("="), group), F.lit(""))
    return F.unhex(F.md5(F.concat_ws(_SEP, grp, letters(text), F.lit(""), values)))


def keyed_records(df: DataFrame, id_col: str, group_col: str, text_col: str, packed_col: str, batch: Column) -> DataFrame:
    """(id, grp, key, batch) of every record with a text that is not null or blank."""
    return df.filter(F.regexp_replace(F.col(text_col), r"(?U)\s", "") != "").select(
        F.col(id_col).alias("id"), F.col(group_col).alias("grp"), canonical_key(F.col(group_col), F.col(text_col), F.col(packed_col)).alias("key"), batch.alias("batch")
    )


class Ledger:
    """Bucketed key counts: (grp, key, n, first_id, bucket), one row per key.

    Each update writes new versions of the buckets it touches, then a new manifest; a failed update
    leaves the old manifest and so the old buckets in force. Buckets follow the hash Spark shuffles
    by, so the tasks of a join write whole buckets without another shuffle. Their number is set when
    a ledger is made, from the number of rows expected.
    """

    SCHEMA = "grp string, key binary, n long, first_id long, bucket int"
    MANIFEST = "version int, n_buckets int, bucket int, folder string, n_keys long, n_rows long"

    def __init__(self, spark, base: str, n_buckets: int):
        self.spark, self.base, self.n_buckets = spark, base, n_buckets
        self.version = 0
        self.at: dict[int, tuple[str, int, int]] = {}  # bucket to the folder of its newest version, its keys and rows

    @classmethod
    def create(cls, spark, base: str | None = None, rows_expected: int = 0, rows_a_bucket: int = 200_000) -> Ledger:
        """A new ledger in ``base``, else in a new part of the shared folder."""
        wanted = max(4, -(-rows_expected // rows_a_bucket))
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        # Buckets and tasks divide each other, so a task holds few buckets.
        n = -(-wanted // tasks) * tasks if wanted > tasks else min(d for d in range(wanted, tasks + 1) if tasks % d == 0)
        return cls(spark, base or scratch_path(spark, "ledger"), n)

    @classmethod
    def open(cls, spark, base: str) -> Ledger:
        """The ledger of ``base`` as its newest manifest has it."""
        rows = spark.read.schema(cls.MANIFEST).json(f"{base}/manifest/*")
        newest = rows.filter(F.col("version") == rows.agg(F.max("version")).first()[0]).collect()  # a row a bucket
        ledger = cls(spark, base, newest[0].n_buckets)
        ledger.version = newest[0].version
        ledger.at = {r.bucket: (r.folder, r.n_keys, r.n_rows) for r in newest}
        return ledger

    def _bucket(self) -> Column:
        return F.pmod(F.hash("key"), F.lit(self.n_buckets)).cast("int")

    def read(self, buckets: list[int]) -> DataFrame:
        """The rows of some buckets; no file of another is touched."""
        by_folder: dict[str, list[int]] = {}
        for b in buckets:
            if b in self.at:
                by_folder.setdefault(self.at[b][0], []).append(b)
        if not by_folder:
            return self.spark.createDataFrame([], self.SCHEMA)
        parts = []
        for folder, own in sorted(by_folder.items()):
            path = f"{self.base}/{folder}"
            parts.append(self.spark.read.schema(self.SCHEMA).option("basePath", path).parquet(*[f"{path}/bucket={b}" for b in sorted(own)]))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def rows(self) -> DataFrame:
        return self.read(list(self.at))

    def n_rows(self) -> int:
        return sum(n for _, _, n in self.at.values())

    def update(self, batch: DataFrame) -> list[int]:
        """Add a batch of (id, grp, key); returns the buckets touched. An empty batch changes nothing."""
        touched = sorted(r[0] for r in batch.select(self._bucket().alias("b")).distinct().collect())  # at most n_buckets rows
        if not touched:
            return touched
        fresh = batch.groupBy("key").agg(F.min("grp").alias("grp"), F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
        merged = fresh
        if any(b in self.at for b in touched):
            old = self.read(touched).drop("bucket").alias("o")
            merged = old.join(fresh.alias("f"), F.col("o.key") == F.col("f.key"), "full").select(
                F.coalesce("o.grp", "f.grp").alias("grp"),
                F.coalesce("o.key", "f.key").alias("key"),
                (F.coalesce("o.n", F.lit(0)) + F.coalesce("f.n", F.lit(0))).alias("n"),
                F.least("o.first_id", "f.first_id").alias("first_id"),
            )
        folder = f"v{self.version + 1}-{uuid.uuid4().hex[:8]}"
        merged.withColumn("bucket", self._bucket()).write.partitionBy("bucket").parquet(f"{self.base}/{folder}")
        at = dict(self.at)
        made = self.spark.read.schema(self.SCHEMA).parquet(f"{self.base}/{folder}").groupBy("bucket").agg(F.count(F.lit(1)), F.sum("n"))
        at |= {b: (folder, keys, n) for b, keys, n in made.collect()}  # at most n_buckets rows
        manifest = [(self.version + 1, self.n_buckets, b, *x) for b, x in sorted(at.items())]
        self.spark.createDataFrame(manifest, self.MANIFEST).coalesce(1).write.json(f"{self.base}/manifest/v{self.version + 1}")
        self.version, self.at = self.version + 1, at
        return touched


def collapse(keyed: DataFrame, base: str | None = None) -> Ledger:
    """The ledger of all batches of ``keyed`` (id, grp, key, batch), taken in batch order, each on its own."""
    counts = keyed.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).orderBy(F.asc_nulls_first("batch")).collect()  # a row a batch
    ledger = Ledger.create(keyed.sparkSession, base, sum(r.n for r in counts))
    for r in counts:
        ledger.update(keyed.filter(F.col("batch").eqNullSafe(F.lit(r.batch))))
    return ledger


def latest_delivery(df: DataFrame, time: str) -> Column:
    """Two batches of a table that has grown: the newest month of ``time``, and all that was there before."""
    newest = df.agg(F.date_format(F.max(time), "yyyy-MM")).first()[0]
    return F.when(F.date_format(F.col(time), "yyyy-MM") == F.lit(newest), F.lit("latest")).otherwise(F.lit("backlog"))


def _keyed_by_batch(df: DataFrame, id_col: str, group_col: str, text_col: str, packed_col: str, batch: Column | None) -> DataFrame:
    """Keyed records in the shared folder, in a folder for each batch, so a batch reads its own rows only.
    Batches are named by text."""
    name = F.lit("all") if batch is None else batch.cast("string")
    return materialise(keyed_records(df, id_col, group_col, text_col, packed_col, name), "keyed-records", ["batch"])


def duplicate_members(df: DataFrame, id_col: str = "row_id", group_col: str = "study_id", text_col: str = "text", packed_col: str = "annotation", batch: Column | None = None, heavy_share: float = 0.001) -> DataFrame:
    """(first_id, copy_id): for each set of like records of one group, the smallest id and one row
    for every other member.

    Null and blank texts are left out; texts of signs only are alike; a null annotation is empty.
    Null groups form one group. Repeated rows with the same id are one member. ``batch`` orders the
    arrival of the records; other columns of ``df`` are not read. Keys with more than ``heavy_share``
    of all records, at most ``1 / heavy_share`` of them by the ledger's counts, are broadcast.
    """
    keyed = _keyed_by_batch(df, id_col, group_col, text_col, packed_col, batch)
    ledger = collapse(keyed)
    heads = materialise(ledger.rows().filter(F.col("n") > 1).select("key", "first_id", "n"), "duplicate-heads")
    least = max(1, int(ledger.n_rows() * heavy_share))
    heavy = heads.filter(F.col("n") > least).select("key", F.col("first_id").alias("_h"))
    members = keyed.select("id", "key").join(F.broadcast(heavy), "key", "left")
    of_heavy = members.filter(F.col("_h").isNotNull()).select(F.col("_h").alias("first_id"), "id")
    of_light = members.filter(F.col("_h").isNull()).join(heads.filter(F.col("n") <= least), "key").select("first_id", "id")
    found = of_heavy.unionByName(of_light).filter(F.col("id") != F.col("first_id"))
    return found.select("first_id", F.col("id").alias("copy_id")).distinct()


def duplicate_counts(df: DataFrame, id_col: str = "row_id", group_col: str = "study_id", text_col: str = "text", packed_col: str = "annotation", batch: Column | None = None) -> DataFrame:
    """(study_id, first_id, n_copies) of every distinct record, from the ledger. Records are left out and
    grouped as in ``duplicate_members``; n_copies counts rows, so a row that comes again under the
    same id counts each time."""
    keyed = _keyed_by_batch(df, id_col, group_col, text_col, packed_col, batch)
    return collapse(keyed).rows().select(F.col("grp").alias(group_col), "first_id", F.col("n").alias("n_copies"))
