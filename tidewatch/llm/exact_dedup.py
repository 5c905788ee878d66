"""Exact duplicates by a persistent digest index.

The index is a Parquet table, bucketed and sorted by digest, with a row for each distinct text seen so far. A new batch
is cut down to one row per digest first (combined before the shuffle, so a text that makes up a third of the batch costs
one row per task), dealt to the index's own buckets, and anti-joined by sort-merge: the index is not shuffled, but Spark sorts each
bucket it reads, as appends give a bucket several sorted files. What the anti-join leaves is appended. Rows of digests that are
common in the batch, of which there can be a few for each task only, meet their group by a broadcast; all others by a sort-merge join.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SPACE_CLASS, drop_settled, remove, scratch, settle, shuffle_width, table

#: A digest is common if its rows would fill so many average tasks; there are fewer such digests than tasks.
COMMON_TASKS = 2


def normalised(text):
    """White space runs become one space; null is the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS, " ")


class DigestIndex:
    """Digests of all texts taken in, with the id of the row that stays.

    ``path`` is a folder all executors share; an index that is already there is opened again (its bucket count must be
    given alike). Null texts equal empty ones. Of equal texts the smallest id stays, null ids last; of repeated rows
    with that id one stays. A text already in the index keeps its first id, also a null one. Extra columns of a batch are ignored,
    whatever their names, as only the two named columns are read. Very long texts cost in proportion; only digests are moved.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, id_type: str = "bigint"):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = f"digest_index_{uuid.uuid4().hex[:12]}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id {id_type}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {int(buckets)} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, batch: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Appends what is new and returns (id, digest, keep_id, group_size, kept) for every row of the batch.

        ``group_size`` counts the batch's rows with that text. Running the same batch again changes nothing and returns
        the same rows, so a failed run can be repeated.
        """
        hashed = settle(
            batch.select(
                F.col(id_col).alias("id"),
                F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"),
                F.monotonically_increasing_id().alias("row"),
            ),
            "digests",
        )
        order = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("row").alias("row"))
        groups = hashed.groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size"))
        groups = settle(groups.repartition(self.buckets, "digest"), "digest-groups")
        new = groups.join(self.rows().hint("merge"), "digest", "left_anti").repartition(self.buckets, "digest")
        new.select("digest", F.col("first.id").alias("keep_id")).sortWithinPartitions("digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        known = groups.join(self.rows().hint("merge"), "digest").select(
            F.col("digest").alias("own"), "keep_id", "group_size", F.col("first.row").alias("first_row")
        )
        known = settle(known, "digest-known")
        tasks = shuffle_width(self.spark)
        common = F.broadcast(known.where(F.col("group_size") * tasks > COMMON_TASKS * hashed.count()))
        rare = hashed.join(common.select(F.col("own").alias("common")), F.col("digest") == F.col("common"), "left_anti")
        met = hashed.join(common, F.col("digest") == F.col("own")).unionByName(rare.join(known.hint("merge"), F.col("digest") == F.col("own")))
        out = met.select(
            "id",
            "digest",
            "keep_id",
            "group_size",
            (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("row") == F.col("first_row"))).alias("kept"),
        )
        out = settle(out, "dedup")
        for used in (hashed, groups, known):
            drop_settled(used)
        return out

    def close(self, forget: bool = False) -> None:
        """Drops the table's name from the session; its files stay unless they are to be forgotten."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        if forget:
            remove(self.spark, self.path)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the id that stays of its equals."""
    index = DigestIndex(spark, scratch(spark, "digest-index"), buckets=shuffle_width(spark))
    found = index.add(table(spark, sf_dir, "documents"))
    index.close(forget=True)
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


OP9_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
