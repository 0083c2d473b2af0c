"""Exact duplicates against a persistent digest index, in DataFrame operations only.

The index is a Parquet table bucketed and sorted by SHA-256 digest. A batch of
new rows is reduced to one row per digest (with partial aggregation, so a group
that holds a third of the rows is one row per task before the shuffle), and a
sort-merge anti-join against the index finds the digests that are new; both
sides share the bucketing, so the index itself is never shuffled. The new
digests are appended. Finally each row of the batch looks up its group by a
join whose two sides are plain exchanges, which AQE can split at a hot digest.

A batch has a name, and the index keeps it with every digest. A job that dies after
the append, or in the middle of it, is repeated under the same name: what it had
appended counts as new once more, so the answer is the same and nothing is
appended twice. One batch writes at a time: its name lies in a claim file beside the
index until its groups are written, and another batch is refused meanwhile.

The number of buckets is set when an index is made, ``buckets_for`` the digests
expected, and kept by the table; ``rebucket`` copies an index that has outgrown it.

Defined results: a null text counts as empty. Of equal texts of one batch the
row with the largest ``doc_id`` stays; a null id is smaller than any other.
Where a row is repeated with its id, one of them stays. A text that an earlier
batch brought is dropped, and ``keep_id`` is the id kept then. Other columns are
ignored, whatever their names. An empty batch appends nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from waymark.scratch import Scratch, delete_path

#: Digests in a bucket for which ``buckets_for`` plans: some 100 MB, which a task sorts in memory.
BUCKET_DIGESTS = 1_000_000
LEAST_BUCKETS, MOST_BUCKETS = 16, 1 << 16


def buckets_for(digests: int) -> int:
    """The power of two that gives each bucket BUCKET_DIGESTS at most; beyond MOST_BUCKETS buckets grow."""
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << max(0, (digests - 1) // BUCKET_DIGESTS).bit_length()))


class Claimed(RuntimeError):
    """Another batch is being added."""


class DigestIndex:
    """The table of all digests seen, at ``location`` in a folder shared by the cluster."""

    COLUMNS = "digest string, keep_id long, batch string"

    def __init__(self, spark: SparkSession, location: str, buckets: int = LEAST_BUCKETS, table: str | None = None) -> None:
        self.spark, self.location = spark, location.rstrip("/")
        self.table = table or f"digest_index_{uuid.uuid4().hex}"
        if not spark.catalog.tableExists(self.table):
            spark.sql(
                f"CREATE TABLE {self.table} ({self.COLUMNS}) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.location}'"
            )
        described = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {self.table}").collect()}
        self.buckets = int(described["Num Buckets"])

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    # -- one writer at a time ------------------------------------------------

    def _claim_file(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.location}.claim")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _claim(self, batch: str) -> None:
        fs, path = self._claim_file()
        try:
            out = fs.create(path, False)
        except Exception as error:
            # The file system makes the file for one writer only; the same batch may carry on.
            holder = "".join(r.value for r in self.spark.read.text(str(path)).collect())
            if holder != batch:
                raise Claimed(f"batch {holder} is being added") from error
            return
        out.write(bytearray(batch.encode()))
        out.close()

    def _release(self) -> None:
        fs, path = self._claim_file()
        fs.delete(path, False)

    # -- batches ---------------------------------------------------------------

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """Append the batch's new digests; a row per row of ``docs``:
        ``doc_id, keep_id, group_size, kept, text_sha256``."""
        batch = batch or uuid.uuid4().hex
        scratch = Scratch(self.spark, "exact-dedup")
        # Ranked here, on both columns: a window above the final join would hold a digest's rows together.
        nth = F.row_number().over(Window.partitionBy("digest", "doc_id").orderBy(F.lit(0)))
        digests = scratch.keep(
            docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("digest")).withColumn("nth", nth),
            "digests",
        )
        arrived = scratch.keep(digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "arrived")
        self._claim(batch)
        fresh = arrived.join(self.rows().hint("merge"), "digest", "left_anti").select("digest", "keep_id", F.lit(batch).alias("batch"))
        fresh.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)
        known = self.rows().select("digest", F.col("keep_id").alias("index_id"), (F.col("batch") == batch).alias("is_new")).hint("merge")
        groups = scratch.keep(arrived.join(known, "digest").select("digest", F.col("index_id").alias("keep_id"), "group_size", "is_new"), "groups")
        self._release()
        return (
            digests.join(groups, "digest")
            .select(
                "doc_id",
                "keep_id",
                "group_size",
                (F.col("is_new") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
                F.col("digest").alias("text_sha256"),
            )
        )

    def rebucket(self, location: str, buckets: int) -> DigestIndex:
        """A copy of the index at ``location`` with another number of buckets."""
        copy = DigestIndex(self.spark, location, buckets)
        self.rows().write.mode("append").format("parquet").bucketBy(buckets, "digest").sortBy("digest").saveAsTable(copy.table)
        return copy

    def drop(self) -> None:
        """Take the table out of the catalog and delete its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        delete_path(self.spark, self.location)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``DigestIndex.add`` against a new, empty index, which is dropped again."""
    spark = docs.sparkSession
    index = DigestIndex(spark, f"{Scratch(spark, 'digest-index').path}/index", buckets_for(docs.select(F.lit(1)).count()))
    found = index.add(docs, id_col, text_col)
    index.drop()
    return found


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
