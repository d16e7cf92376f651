"""SimHash near-dedup with BK-trees.

A fingerprint has bit b set if more than half of a text's shingle hashes have it. Two fingerprints within radius
bits agree exactly in all but radius of any m blocks; so each fingerprint goes to a shard for every choice of
m - radius blocks, keyed by their bits, and two that link share a shard. A shard's fingerprints make a BK-tree, whose children
are keyed by their Hamming distance to the parent, and a search follows only the edges within the radius. Shards
over shard_size are cut into trees of that size, and each tree is sent to the shard's other parts: no task holds
more than two parts. A search gives one link for each fingerprint and group it meets, never all pairs; the links
join components by repeated least labels, cut off by written tables.

Defined results: a null text counts as empty; texts without words have fingerprint zero and link like any other.
Rows repeated under one id are separate rows with the same id. Null ids take no part in the choice of the
smallest id; a component of null ids only has a null component_id. An empty table gives an empty result. Only the
id and the text are read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, materialize, table, with_join_key
from .substring_dedup import split_words, word_seeds

BITS = 64
SHARD_SIZE = 1500
#: Shingles that are counted at a time, so that a long text needs no more memory.
AT_ONCE = 1 << 16


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """bytes.lower() changes A-Z only, and bytes.split() splits at \\x20 and \\x09-\\x0D only."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    line, digest = b" ".join(parts), xxhash.xxh64_intdigest
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(parts) - words + 1)
    first, last = starts[:n].tolist(), ends[min(words, len(parts)) - 1 :].tolist()
    counts = np.zeros(BITS, dtype=np.int64)
    for k in range(0, n, AT_ONCE):
        hashes = np.array([digest(line[a:b], seed) for a, b in zip(first[k : k + AT_ONCE], last[k : k + AT_ONCE], strict=True)], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long), one row per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(x.as_py(), words, seed) for x in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, fp bigint")


class BKTree:
    """Arrays of nodes; children of a node are keyed by their distance to it."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """The value's node; a value that is there already isn't added."""
        if not self.values:
            self.values.append(value)
            self.children.append({})
            return 0
        at = 0
        while d := (self.values[at] ^ value).bit_count():
            below = self.children[at].get(d)
            if below is None:
                self.children[at][d] = len(self.values)
                self.values.append(value)
                self.children.append({})
                return len(self.values) - 1
            at = below
        return at

    def near(self, value: int, radius: int) -> Iterator[int]:
        """The nodes within the radius."""
        todo = [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                yield at
            todo += [c for edge, c in self.children[at].items() if d - radius <= edge <= d + radius]


def _find(parent: list[int], k: int) -> int:
    while parent[k] != k:
        parent[k] = parent[parent[k]]
        k = parent[k]
    return k


def shard_links(own: list[int], other: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that join what is within the radius among own, or between own and other if there is any: a forest, not all pairs."""
    tree, out = BKTree(), []
    values = own + other
    parent = list(range(len(values)))
    queries = range(len(own), len(values)) if other else range(len(own))
    if other:
        for v in own:
            tree.add(v)
    for k in queries:
        for node in tree.near(values[k], radius):
            a, b = _find(parent, k), _find(parent, node)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((values[k], values[node]))
        if not other:
            tree.add(values[k])
    return out


def blocks_for(n: int, radius: int, shard: int = 8) -> int:
    """The least number of blocks, over the radius by 2 at least, at which n even fingerprints leave shards of some shard members."""
    m = radius + 2
    while m < radius + 4 and n / 2 ** ((m - radius) * BITS / m) > shard:
        m += 1
    return m


def links(distinct: DataFrame, n: int, radius: int = 4, shard_size: int = SHARD_SIZE) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp), a forest for each shard."""
    m = blocks_for(n, radius)
    edges = [round(k * BITS / m) for k in range(m + 1)]
    masks = [sum(((1 << edges[b + 1]) - (1 << edges[b])) for b in kept) for kept in itertools.combinations(range(m), m - radius)]
    signed = [x - (1 << 64) if x >> 63 else x for x in masks]
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(x)) for x in signed])).alias("choice", "bits"))
    sizes = materialize(keyed.groupBy("choice", "bits").count().where("count > 1"), "shards")
    few = sizes.where(F.col("count") <= shard_size).select("choice", "bits", F.lit(1).cast("bigint").alias("parts"))
    many = sizes.where(F.col("count") > shard_size).select("choice", "bits", F.ceil(F.col("count") / shard_size).cast("bigint").alias("parts"))
    shards = with_join_key(few.unionAll(many), "j", "choice", "bits")
    at = with_join_key(keyed, "j", "choice", "bits").join(shards, ["j", "choice", "bits"])
    part = F.pmod(F.xxhash64(F.lit(11), "fp"), F.col("parts"))
    pairs = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1), lambda q: F.struct(F.least(q, F.col("part")).alias("lo"), F.greatest(q, F.col("part")).alias("hi")))
    rows = at.withColumn("part", part).select("choice", "bits", "fp", "part", F.explode(pairs).alias("p")).select("choice", "bits", "p.lo", "p.hi", (F.col("part") != F.col("p.lo")).alias("query"), "fp")
    key = ["choice", "bits", "lo", "hi"]
    tasks = rows.repartition(*key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, other, found = None, [], [], []

        def flush():
            both = now is not None and now[2] != now[3]
            if own and (other or not both):
                found.extend(shard_links(own, other, radius))

        for batch in batches:
            for c, b, lo, hi, query, fp in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if (c, b, lo, hi) != now:
                    flush()
                    now, own, other = (c, b, lo, hi), [], []
                (other if query else own).append(fp & 0xFFFFFFFFFFFFFFFF)
            if found:
                yield _links_batch(found)
                found = []
        flush()
        if found:
            yield _links_batch(found)

    return tasks.mapInArrow(run, "a bigint, b bigint").distinct()


def _links_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(found, dtype=np.uint64).view(np.int64)
    lo, hi = pairs.min(axis=1), pairs.max(axis=1)
    return pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi)], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """v, label for each end of edges (a, b): the component's least end. Each round takes the least label around, then that label's own label."""
    both = materialize(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "v"), "labels")
    total = None
    while True:
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return labels
        total = now
        around = both.join(labels, both.b == labels.v).select(F.col("a").alias("v"), "label")
        least = materialize(labels.unionAll(around).groupBy("v").agg(F.min("label").alias("label")), "labels")
        ahead = least.select(F.col("v").alias("at"), F.col("label").alias("further"))
        labels = materialize(least.join(ahead, least.label == ahead.at).select("v", F.col("further").alias("label")), "labels")


def near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", shard_size: int = SHARD_SIZE) -> DataFrame:
    """doc_id, fp, component_id (the smallest id reachable), one row per row of docs."""
    prints = materialize(fingerprints(docs, words, seed, id_col, text_col), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    labels = components(materialize(links(distinct.select("fp"), distinct.count(), radius, shard_size), "links"))
    rooted = distinct.join(labels, distinct.fp == labels.v, "left").select("fp", "least", F.coalesce("label", "fp").alias("root"))
    rooted = materialize(rooted, "roots")
    smallest = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    named = materialize(with_join_key(rooted, "j", "root").join(with_join_key(smallest, "j", "root"), ["j", "root"]).select("fp", "component_id"), "named")
    return with_join_key(prints, "j", "fp").join(with_join_key(named, "j", "fp"), ["j", "fp"]).select("doc_id", "fp", "component_id")


#: For similarities that no radius of 64 bits finds: least hashes of a text's shingles, and those that a key takes.
HASHES, KEY_HASHES, SIMILARITY, SHINGLE_WORDS = 120, 5, 0.8, 5
_rng = np.random.default_rng(1)
_FACTORS, _OFFSETS = (_rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64))


def sketch(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """HASHES least hashes (high 32 bits) of the text's shingles; none for a text without words."""
    parts = split_words(text)
    if not parts:
        return np.zeros(0, dtype=np.uint32)
    shingles = np.unique(word_seeds(parts, min(words, len(parts))))
    out = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(shingles), 4096):
        mixed = shingles[k : k + 4096, None] * _FACTORS + _OFFSETS
        mixed ^= mixed >> np.uint64(32)
        np.minimum(out, (mixed * np.uint64(0xD6E8FEB86659FD93)).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def similar_links(docs: DataFrame, similarity: float = SIMILARITY, words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a, b: ids of texts whose sets of shingles have that Jaccard similarity or more, by their sketches (a standard error
    of 0.037 at 0.8). A key of KEY_HASHES hashes links each id that has it to the least one and to the one before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                made = [sketch(x.as_py(), words) for x in part.column(1)]
                keys = [[int.from_bytes(xxhash.xxh64_digest(s[j : j + KEY_HASHES].tobytes(), j), "little", signed=True) for j in range(0, HASHES, KEY_HASHES)] if len(s) else [] for s in made]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in made], pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["id", "sketch", "keys"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    sketches = materialize(rows.mapInArrow(run, "id bigint, sketch binary, keys array<bigint>"), "sketches")
    keyed = sketches.select("id", F.explode("keys").alias("key"))
    many = keyed.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("least < last")
    held = materialize(with_join_key(keyed, "j", "key").join(with_join_key(many.select("key", "least", F.ceil(F.col("n") / SHARD_SIZE).alias("parts")), "j", "key"), ["j", "key"]).select("key", "id", "least", "parts"), "keys")
    # the id before, in a hot key among those of one part of it: no task sees a hot key whole
    before = F.lag("id").over(Window.partitionBy("key", F.pmod(F.xxhash64(F.lit(5), "id"), F.col("parts"))).orderBy("id"))
    pairs = held.withColumn("before", before).select("id", F.explode(F.array("least", "before")).alias("other")).where("other < id").distinct()
    one = with_join_key(pairs, "j", "id").join(with_join_key(sketches.select("id", "sketch"), "j", "id"), ["j", "id"]).select("id", "other", F.col("sketch").alias("mine"))
    there = sketches.select(F.col("id").alias("other"), F.col("sketch").alias("theirs"))
    both = with_join_key(one, "j", "other").join(with_join_key(there, "j", "other"), ["j", "other"]).select("id", "other", "mine", "theirs")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint32).reshape(-1, HASHES) for c in (2, 3))
            good = (a == b).mean(axis=1) >= similarity
            yield pa.RecordBatch.from_arrays([batch.column(1).filter(pa.array(good)), batch.column(0).filter(pa.array(good))], ["a", "b"])

    return both.mapInArrow(check, "a bigint, b bigint")


def similar_documents(docs: DataFrame, similarity: float = SIMILARITY, words: int = SHINGLE_WORDS, **options) -> DataFrame:
    """doc_id, component_id: the components that fingerprints (near_duplicates) and similar_links() join together, for the
    ids of docs. Four or so bits of a fingerprint hold copies of a few changed words only: at a similarity of 0.8 some ten
    of 64 bits differ, and no tree or block of bits finds that exactly in less than all pairs."""
    near = materialize(near_duplicates(docs, **options).select("doc_id", "component_id").where("doc_id IS NOT NULL").distinct(), "near")
    # an id of several rows joins their components
    by_print = near.where("doc_id <> component_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b"))
    labels = components(materialize(by_print.unionAll(similar_links(docs, similarity, words)), "links"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    return rows.join(labels, rows.doc_id == labels.v, "left").select("doc_id", F.coalesce("label", "doc_id").alias("component_id"))


def keep_dissimilar(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs with the smallest id of their component in similar_documents(), with all their columns."""
    return keep_ids(docs, similar_documents(docs, **options))


def keep_representatives(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs with the smallest id of their component, with all their columns. A component of null ids keeps them."""
    return keep_ids(docs, near_duplicates(docs, **options))


def keep_ids(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id is the least of its component in found (doc_id, component_id)."""
    name = free_name(docs, "id_kept")
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col(name)), "left_semi")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
