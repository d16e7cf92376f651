"""Exact dedup against a persistent digest index.

The index is a Parquet table (digest, keep_id, batch_id), bucketed and sorted by digest. A batch is reduced to
one row per digest, reduced further by a sort-merge anti-join with the index, and what is new is appended. A corpus goes
through in batches of ids, largest first, so a later batch loses the texts that the index holds by then.

Defined results: a null text counts as empty. Ids are compared with null lowest; a group whose ids are all null
keeps one row and has a null keep_id. Rows repeated with one id and one text are counted in group_size and at
most one of them is kept. An empty table gives an empty result and appends nothing. Columns other than the id
and the text are neither read nor can their names clash. A batch that is run again under its batch_id finds its own
digests and gives the same result as at first.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, fresh_path, lower_ascii, materialize, table, with_join_key


def digest_column(text: str = "text"):
    """SHA-256, as binary, of the whole text after lower-casing A-Z only."""
    return F.unhex(F.sha2(lower_ascii(text), 256))


#: Digests of a bucket, about, and rows of a batch, about, if the caller names no number.
BUCKET_ROWS, BATCH_ROWS = 2_000_000, 4_000_000_000


class DigestIndex:
    """A persistent index at path, a folder that all executors share. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, int(buckets)
        self.table = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
        self._create()

    @classmethod
    def for_rows(cls, spark: SparkSession, path: str, rows: int) -> DigestIndex:
        """An index whose buckets hold about BUCKET_ROWS digests when it holds so many rows."""
        return cls(spark, path, max(16, -(-rows // BUCKET_ROWS)))

    def _create(self) -> None:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT, batch_id STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION {json.dumps(self.path)}"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, groups: DataFrame, batch_id: str) -> None:
        """Append the digests of groups (digest, keep_id) that the index doesn't hold, by sort-merge anti-join. Run again
        under its batch_id, a batch finds its own digests and appends nothing."""
        held = self.rows().select("digest")
        fresh = groups.join(held.hint("merge"), "digest", "left_anti")
        rows = fresh.select("digest", "keep_id", F.lit(batch_id).alias("batch_id"))
        rows.repartition(self.buckets, "digest").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)

    def compacted(self, path: str) -> DigestIndex:
        """A copy at path with one sorted file a bucket again, which each batch adds a file to; the old index stays."""
        new = DigestIndex(self.spark, path, self.buckets)
        self.rows().repartition(self.buckets, "digest").write.insertInto(new.table)
        self.spark.catalog.refreshTable(new.table)
        return new

    def forget(self) -> None:
        """Drop the table's name; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """digest, doc_id, copies (rows with both)."""
    lines = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), digest_column(text_col).alias("digest"))
    return materialize(lines.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("copies")), "digests")


def _against_index(counted: DataFrame, index: DigestIndex, batch_id: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest of each row of the batch, after its new digests went into the index."""
    groups = materialize(counted.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")), "groups")
    index.add(groups, batch_id)
    held = index.rows().select("digest", F.col("keep_id").alias("held_id"), (F.col("batch_id") == batch_id).alias("own"))
    sizes = with_join_key(groups.select("digest", "group_size"), "j", "digest").join(with_join_key(held, "j", "digest"), ["digest", "j"]).drop("j")
    sizes = materialize(sizes, "kept")
    found = with_join_key(counted, "j", "digest").join(with_join_key(sizes, "j", "digest"), ["digest", "j"])
    each = found.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("nth"))
    kept = F.col("own") & F.col("doc_id").eqNullSafe(F.col("held_id")) & (F.col("nth") == 1)
    return each.select("doc_id", F.col("held_id").alias("keep_id"), "group_size", kept.alias("kept"), "digest")


def dedup_and_append(docs: DataFrame, index: DigestIndex, batch_id: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size (rows of this batch), kept, digest.

    Of texts that are new to the index, the row with the largest id stays; texts that an earlier batch holds are
    dropped, and keep_id is that batch's. Only digests and ids are shuffled."""
    return _against_index(_digests(docs, id_col, text_col), index, batch_id)


def dedup_in_batches(docs: DataFrame, index: DigestIndex, batch_id: str, batches: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same, of batches that go through the index one after the other, largest ids first, so that of all rows the one
    with the largest id stays. group_size counts the rows of all batches. Texts are read and hashed once. The batches are
    ranges of the ids (null ids are in the last), by approximate quantiles: their sizes differ, their result doesn't."""
    counted = _digests(docs, id_col, text_col)
    if batches is None:
        batches = max(2, -(-counted.count() // BATCH_ROWS))
    cuts = sorted(set(counted.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01)), reverse=True)
    out = None
    for k, low in enumerate([*cuts, None]):
        part = counted
        if k:
            part = part.where(F.col("doc_id").isNull() | (F.col("doc_id") < int(cuts[k - 1]))) if low is None else part.where(F.col("doc_id") < int(cuts[k - 1]))
        if low is not None:
            part = part.where(F.col("doc_id") >= int(low))
        rows = _against_index(part, index, f"{batch_id}-{k}")
        out = rows if out is None else out.unionAll(rows)
    sizes = materialize(counted.groupBy("digest").agg(F.sum("copies").alias("all_rows")), "sizes")
    whole = with_join_key(out, "j", "digest").join(with_join_key(sizes, "j", "digest"), ["digest", "j"])
    return whole.select("doc_id", "keep_id", F.col("all_rows").alias("group_size"), "kept", "digest")


def keep_first(docs: DataFrame, index: DigestIndex, batch_id: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that dedup_in_batches keeps, with all their columns. Whole rows are shuffled once."""
    digest, key, nth = (free_name(docs, x) for x in ("digest_own", "id_key", "nth_copy"))
    text = lambda c: F.coalesce(F.col(c).cast("bigint").cast("string"), F.lit(""))
    kept = dedup_in_batches(docs, index, batch_id, None, id_col, text_col).where("kept").select(F.col("digest").alias(digest), text("doc_id").alias(key))
    out = docs.withColumn(digest, digest_column(text_col)).withColumn(key, text(id_col)).join(kept, [digest, key], "left_semi")
    first = F.row_number().over(Window.partitionBy(digest, key).orderBy(F.lit(0)))  # by the join's keys: no shuffle more
    return out.withColumn(nth, first).where(F.col(nth) == 1).select(*docs.columns)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = DigestIndex.for_rows(spark, fresh_path(spark, "digest-index"), docs.count())
    rows = dedup_in_batches(docs, index, "documents")
    index.forget()
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
      FROM documents)
"""
