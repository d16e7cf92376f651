"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop lines over the threshold,
reassemble by position.

A line's key is the line with \\x20 and \\x09-\\x0D stripped at both ends and A-Z lower-cased. Keys of at least
min_chars code points that at least min_docs documents hold lose all their lines, except in the largest id.

Defined results: a null or empty text is one empty line. Rows with a null id hold no document: they don't count
towards min_docs, and lose the lines that others hold often enough. Rows repeated under one id are one document.
An empty table gives an empty result. Only the id and the text are read, so no other column can clash.
A key is 128 bits of two seeds of XXH64.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, lower_ascii, materialize, table, with_join_key

#: Common keys (about 40 bytes each in memory) up to which the drop list is sent to all tasks; beyond, it is shuffled.
BROADCAST_KEYS = 20_000


def _hashes(col: Column) -> list[Column]:
    return [F.xxhash64(col).alias("h1"), F.xxhash64(F.lit(7), col).alias("h2")]


def _row_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("r1"), F.xxhash64(F.lit(7), text).alias("r2"))


def _lines(rows: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, r1, r2, pos, h1, h2 of each line whose key is long enough."""
    exploded = rows.select("doc_id", "r1", "r2", F.posexplode(F.split(lower_ascii("text"), "\n", -1)).alias("pos", "line"))
    key = F.trim(F.col("line"), F.lit(BLANKS))
    long = exploded.where(F.length("line") >= min_chars).select("doc_id", "r1", "r2", "pos", key.alias("key")).where(F.length("key") >= min_chars)
    return long.select("doc_id", "r1", "r2", "pos", *_hashes(F.col("key")))


def drop_common_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (what is left), n_lines, n_dropped, one row per row of docs."""
    rows = _row_key(docs, id_col, text_col)
    lines = _lines(rows, min_chars)
    counts = lines.where(F.col("doc_id").isNotNull()).groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keep_doc"))
    common = materialize(counts.where(F.col("n") >= min_docs).select("h1", "h2", "keep_doc"), "common-lines")
    if common.count() <= BROADCAST_KEYS:
        found = lines.join(F.broadcast(common), ["h1", "h2"])
    else:
        found = with_join_key(lines, "j", "h1", "h2").join(with_join_key(common, "j", "h1", "h2"), ["j", "h1", "h2"])
    dropped = found.where(~F.col("doc_id").eqNullSafe(F.col("keep_doc"))).groupBy("doc_id", "r1", "r2").agg(F.collect_set("pos").alias("gone"))
    same = F.col("d.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("d.r1") == F.col("x.r1")) & (F.col("d.r2") == F.col("x.r2"))
    both = rows.alias("d").join(dropped.alias("x"), same, "left").select("d.doc_id", "d.text", "x.gone")
    # one lambda holds the split lines, so that they are split once a row and not once a kept line
    split = F.array(F.split("text", "\n", -1))

    def left(lines: Column) -> Column:
        at = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
        return F.struct(F.array_join(F.transform(at, lambda p: F.get(lines, p)), "\n").alias("text"), F.size(lines).cast("bigint").alias("n_lines"))

    plain = F.struct(F.col("text").alias("text"), (F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).cast("bigint").alias("n_lines"))
    cut = F.when(F.col("gone").isNull(), plain).otherwise(F.get(F.transform(split, left), F.lit(0)))
    return both.select("doc_id", cut.alias("c"), F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped")).select("doc_id", "c.text", "c.n_lines", "n_dropped")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = drop_common_lines(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT doc_id, pos, line,
             translate(regexp_replace(regexp_replace(line, '^[ \x09-\x0D]+', ''), '[ \x09-\x0D]+$', ''),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keep_doc FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.keep_doc AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
