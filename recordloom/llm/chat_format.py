"""Chat formatting: cumulative-snapshot collapse, then rendering.

Loggers often store a conversation again after each turn. A prefix hash for every turn (a running sum over
position-keyed turn hashes, 2 x 64 bits) tells which whole conversations are a proper prefix of a longer one; an
anti-join drops those, and of equal conversations the smallest conv_id stays. What is left is rendered.

A conversation is worked on in blocks of 1,024 turn numbers: windows run within a block, and what earlier blocks
add (turns, hash sums) comes from a table of one row a block. So a conversation that holds a third of all turns is
many tasks, and its rendering is one string a block. A block of over HOT_BLOCK turns, as where turns have no number or
one and the same, is cut further, by the number and the first byte of the turn's hash.

Defined results: turns are ordered by (turn, hash of role and text), nulls first; a null role or text is unlike an empty
one for the hash and is rendered as empty. Turns without a number are one block, first of all. Rows with a null conv_id
belong to no conversation and are left out. Only a turn that is repeated in full without end stays in one block. Rows repeated in full are turns of their own. An empty table gives an empty result.
Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, table, with_join_key

#: Turn numbers that agree but for these low bits share a block.
BLOCK_BITS = 10
HOT_BLOCK = 8192
KEY = ["conv_id", "block", "sub"]
NO_TURN = -(1 << 62)


def _turns(turns: DataFrame) -> DataFrame:
    """conv_id, block, sub, turn, role, text, h (a hash of role and text). sub is 0 but in hot blocks."""
    coded = F.concat(*[F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c))) for c in ("role", "text")])
    block = F.coalesce(F.shiftright(F.col("turn").cast("bigint"), BLOCK_BITS), F.lit(NO_TURN))
    known = turns.where(F.col("conv_id").isNotNull()).withColumn("block", block)
    hot = materialize(known.groupBy("conv_id", "block").count().where(F.col("count") > HOT_BLOCK).select("conv_id", "block", F.lit(True).alias("hot")), "hot-blocks")
    rows = known.select("conv_id", "block", "turn", "role", "text", F.sha2(coded, 256).alias("h"))
    if hot.isEmpty():
        return rows.withColumn("sub", F.lit(0).cast("bigint"))
    at = F.coalesce(F.col("turn").cast("bigint").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)), F.lit(0)) * 256 + F.conv(F.substring("h", 1, 2), 16, 10).cast("bigint")
    both = with_join_key(rows, "j", "conv_id", "block").join(with_join_key(hot, "j", "conv_id", "block"), ["j", "conv_id", "block"], "left")
    return both.withColumn("sub", F.when(F.col("hot"), at).otherwise(F.lit(0).cast("bigint"))).drop("j", "hot")


def _earlier(column: str) -> Column:
    """The sum over the conversation's earlier blocks."""
    return F.coalesce(F.sum(column).over(W.partitionBy("conv_id").orderBy("block", "sub").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, block, sub, pos (from 1), n, a, b: (pos, a, b) is the hash of the conversation's first pos turns."""
    return _prefixes(_turns(turns))


def _prefixes(rows: DataFrame) -> DataFrame:
    at = rows.select(*KEY, "h", F.row_number().over(W.partitionBy(*KEY).orderBy("turn", "h")).alias("at"))
    sizes = at.groupBy(*KEY).agg(F.count(F.lit(1)).alias("size"))
    starts = sizes.select(*KEY, _earlier("size").alias("start"), F.sum("size").over(W.partitionBy("conv_id")).alias("n"))
    pos = at.join(starts, KEY).select(*KEY, "h", (F.col("start") + F.col("at")).alias("pos"), "n")
    keyed = lambda seed: F.xxhash64(F.lit(seed), "pos", "h").cast("decimal(20,0)")
    placed = materialize(pos.select(*KEY, "pos", "n", keyed(1).alias("x"), keyed(2).alias("y")), "turns")
    sums = placed.groupBy(*KEY).agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    before = sums.select(*KEY, _earlier("x").alias("x0"), _earlier("y").alias("y0"))
    run = W.partitionBy(*KEY).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    total = lambda x, x0: (F.sum(x).over(run) + F.col(x0)).cast("decimal(38,0)")
    return placed.join(before, KEY).select(*KEY, "pos", "n", total("x", "x0").alias("a"), total("y", "y0").alias("b"))


def _maximal(hashes: DataFrame) -> DataFrame:
    key = ["pos", "a", "b"]
    whole = hashes.where("pos = n").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    inner = hashes.where("pos < n").select(*key).distinct()
    return whole.join(inner, key, "left_anti").select("conv_id", F.col("pos").cast("bigint").alias("n_turns"), "n_copies")


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of the conversations that are no proper prefix of another, one of equal ones."""
    return _maximal(materialize(prefix_hashes(turns), "prefixes"))


def collapse_and_render(turns: DataFrame, open_mark: str = "<|", close_mark: str = "|>") -> DataFrame:
    """conv_id, part, n_turns, n_copies, rendered: each kept conversation, a string for each of its blocks (part, from 0),
    a line with its role before each turn. The parts joined in order are the whole conversation."""
    told = _turns(turns)
    hashes = materialize(_prefixes(told), "prefixes")
    blocks = hashes.select(*KEY).distinct().withColumn("part", F.row_number().over(W.partitionBy("conv_id").orderBy("block", "sub")).cast("bigint") - 1)
    kept = materialize(blocks.join(_maximal(hashes), "conv_id"), "conversations")
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    line = F.concat(F.lit(open_mark), empty("role"), F.lit(close_mark + "\n"), empty("text"), F.lit("\n"))
    rows = told.select(*KEY, F.struct("turn", "h", line.alias("line")).alias("t"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["line"]), "")
    each = rows.join(kept, KEY).groupBy(*KEY, "part", "n_turns", "n_copies")
    return each.agg(text.alias("rendered")).select("conv_id", "part", "n_turns", "n_copies", "rendered")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_and_render(table(spark, sf_dir, "conversations"))


OP5_SQL = """
WITH t AS (SELECT conv_id, turn, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) AS line,
  sha256(CASE WHEN role IS NULL THEN '-' ELSE length(role) || ':' || role END || CASE WHEN text IS NULL THEN '-' ELSE length(text) || ':' || text END) AS h
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n_turns, list(h ORDER BY turn NULLS FIRST, h) AS parts FROM t GROUP BY conv_id),
u AS (SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_copies, parts FROM c GROUP BY n_turns, parts),
p AS (SELECT DISTINCT list_slice(parts, 1, k) AS parts FROM (SELECT parts, unnest(range(1, len(parts))) AS k FROM u)),
m AS (SELECT conv_id, n_turns, n_copies FROM u WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.parts = u.parts)),
b AS (SELECT conv_id, floor(turn / 1024) AS block, string_agg(line, '' ORDER BY turn NULLS FIRST, h) AS rendered FROM t GROUP BY 1, 2)
SELECT m.conv_id, row_number() OVER (PARTITION BY b.conv_id ORDER BY block NULLS FIRST) - 1 AS part, n_turns, n_copies, rendered
FROM m JOIN b ON m.conv_id = b.conv_id
"""
