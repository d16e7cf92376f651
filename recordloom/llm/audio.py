"""Media columns: chroma audio fingerprints.

Audio is cut into frames; a frame's spectrum is folded onto 12 pitch classes. Sixteen filters (differences of
rectangle sums over frames and pitch classes, taken from an integral image) are quantised to two bits each and
packed into one 32-bit integer a frame. Search: recordings with equal integers are one class, searched once. Query
classes and recording classes are dealt to a grid of query blocks and recording parts of bounded size. A block indexes
its runs of RUN integers, sorted; a recording's runs found there give, for every query, the histogram of their
offsets, whose top is the alignment, and the share of differing bits there is the error.

A match is an alignment that chance doesn't give: it overlaps half of the shorter recording and LEAST frames at least,
and its error is at most most_error(overlap). Unrelated recordings differ in CHANCE_ERROR of their bits, give or take
CHANCE_SPREAD / sqrt(frames); the bound lies SIGMAS spreads below and never over MAX_ERROR, so a short overlap must agree
better than a long one, and the expected false matches of a query stay near nothing as the recordings grow.

Defined results: null, empty, corrupt or too short media have no integers and match nothing. A recording doesn't match
its own id. Null ids are left out. Rows repeated under one id with one recording are one; an id with several different
recordings counts the links of each. An empty table gives an empty result. Only the id and the media column are read.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, with_join_key
from .simhash import components

RATE, FRAME, HOP, SPAN = 8000, 1024, 512, 16
#: Integers (about) of a block of queries and of a part of the recordings; hits that are counted at a time.
BLOCK_INTS, PART_INTS, AT_ONCE = 1 << 20, 1 << 20, 1 << 22
#: Equal integers in a row that make a hit (2: a seventh of the hits, but fewer of the copies that differ most are found); the least overlap of a match; see the module's text for the others.
RUN, LEAST, MAX_ERROR, CHANCE_ERROR, CHANCE_SPREAD, SIGMAS = 1, 32, 0.2, 0.346, 0.244, 6.35
#: (kind, lowest pitch class, height, width): kind 0 splits by pitch, 1 by time, 2 by quadrant, 3 in thirds by pitch, 4 in thirds by time.
FILTERS = [(k % 5, (5 * k) % (13 - h), h, w) for k, (h, w) in enumerate((h, w) for w in (4, 8, 12, 16) for h in (3, 6, 9, 12))]
STEP = 0.25


def decode_wav(data: bytes) -> tuple[np.ndarray, int]:
    """Samples (the mean of the channels) and rate of 8-, 16-, 24- or 32-bit PCM; no samples if data isn't such a file."""
    try:
        with wave.open(io.BytesIO(data)) as w:
            width, raw = w.getsampwidth(), np.frombuffer(w.readframes(w.getnframes()), dtype=np.uint8)
            raw = raw[: len(raw) - len(raw) % (width * w.getnchannels())].reshape(-1, width)
            if width == 1:  # unsigned, unlike the wider ones
                x = raw[:, 0].astype(np.float64) - 128
            else:
                filled = np.zeros((len(raw), 4), dtype=np.uint8)
                filled[:, 4 - width :] = raw
                x = filled.view("<i4")[:, 0] / float(1 << (32 - 8 * width))
            return x.reshape(-1, w.getnchannels()).mean(axis=1) / float(1 << (8 * width - 1)), w.getframerate()
    except (EOFError, wave.Error, ValueError):
        return np.zeros(0), RATE


def encode_wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    with wave.open(out := io.BytesIO(), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.clip(np.round(samples * 32767), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def vector_audio(vector: list[float] | None) -> tuple[np.ndarray, int]:
    """A recording that plays a vector: each value is a note of 2 * HOP samples, its pitch class by the value."""
    if not vector:
        return np.zeros(0), RATE
    v = np.nan_to_num(np.array([0.0 if x is None else x for x in vector], dtype=float))
    spread = float(np.sqrt(np.mean(v * v))) or 1.0
    note = np.clip(np.floor((v / (2.5 * spread) + 1) * 6), 0, 11)
    t = np.arange(2 * HOP) / RATE
    return (0.5 * np.sin(2 * np.pi * (523.25 * 2 ** (note / 12))[:, None] * t)).ravel(), RATE


def _fold(rate: int) -> np.ndarray:
    f = np.fft.rfftfreq(FRAME, 1 / rate)
    out = np.zeros((len(f), 12))
    for k, x in enumerate(f):
        if 200 <= x <= 2100:
            out[k, int(round(12 * np.log2(x / 440))) % 12] = 1
    return out


_WINDOW, _FOLDS = np.hanning(FRAME), {RATE: _fold(RATE)}


def chroma(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Frames by 12 pitch classes, each frame of length one."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    power = np.abs(np.fft.rfft(frames * _WINDOW, axis=1)) ** 2
    out = power @ (_FOLDS[rate] if rate in _FOLDS else _FOLDS.setdefault(rate, _fold(rate)))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def pack_frames(frames: np.ndarray) -> np.ndarray:
    """A 32-bit integer for each frame that has SPAN frames from there on."""
    n = len(frames) - SPAN + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint32)
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def area(x: int, y: int, w: int, h: int) -> np.ndarray:
        return image[at + x + w, y + h] - image[at + x, y + h] - image[at + x + w, y] + image[at + x, y]

    out = np.zeros(n, dtype=np.uint32)
    for kind, y, h, w in FILTERS:
        whole = area(0, y, w, h)
        if kind == 0:
            a = area(0, y, w, h // 2)
        elif kind == 1:
            a = area(0, y, w // 2, h)
        elif kind == 2:
            a = area(0, y, w // 2, h // 2) + area(w // 2, y + h // 2, w - w // 2, h - h // 2)
        elif kind == 3:
            a = area(0, y + h // 3, w, h - 2 * (h // 3))
        else:
            a = area(w // 3, y, w - 2 * (w // 3), h)
        value = np.log((1 + a) / (1 + whole - a))
        level = (value >= -STEP).astype(np.uint32) + (value >= 0) + (value >= STEP)
        out = out << np.uint32(2) | (level ^ (level >> np.uint32(1))).astype(np.uint32)
    return out


def fingerprint_audio(media: DataFrame, id_col: str, media_col: str, decode: Callable = decode_wav) -> DataFrame:
    """id, prints (packed integers), one row per row of media with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = []
            for x in batch.column("media"):
                value = x.as_py()
                prints.append(pack_frames(chroma(*decode(value))) if value is not None else np.zeros(0, dtype=np.uint32))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([p.view(np.int32) for p in prints], pa.list_(pa.int32()))], ["id", "prints"])

    rows = media.select(F.col(id_col).cast("bigint").alias("id"), F.col(media_col).alias("media")).where("id IS NOT NULL")
    return rows.mapInArrow(run, "id bigint, prints array<int>")


def most_error(overlap: np.ndarray) -> np.ndarray:
    """The largest bit error that counts as a match over so many frames."""
    return np.minimum(MAX_ERROR, CHANCE_ERROR - SIGMAS * CHANCE_SPREAD / np.sqrt(np.maximum(overlap, 1)))


def run_keys(prints: np.ndarray, run: int = RUN) -> np.ndarray:
    """A hash of the run of integers that starts at each frame."""
    n = max(0, len(prints) - run + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(run):
        out = (out + prints[k : k + n].view(np.uint32)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def align(a: np.ndarray, b: np.ndarray, run: int = RUN, least: int = LEAST) -> tuple[int, int, int, float] | None:
    """(offset of b in a, overlap, hits, bit error) at the offset that most equal runs have; of equals, the least."""
    found = QueryBlock([a], run).align(b, least)
    return (int(found[1][0]), int(found[2][0]), int(found[3][0]), float(found[4][0])) if len(found[0]) else None


class QueryBlock:
    """Queries' integers, flat, and their runs, sorted, so that a recording is aligned with all of them at once."""

    def __init__(self, prints: list[np.ndarray], run: int = RUN):
        self.run = run
        self.sizes = np.array([len(p) for p in prints], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.concatenate([*prints, np.zeros(0, dtype=np.int32)])
        keys = [run_keys(p, run) for p in prints]
        counts = np.array([len(k) for k in keys], dtype=np.int64)
        query = np.repeat(np.arange(len(prints), dtype=np.int32), counts)
        place = (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
        flat = np.concatenate([*keys, np.zeros(0, dtype=np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.values, self.query, self.place = flat[order], query[order], place[order]

    def _histogram(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slots (a query's offsets one after the other) that have hits, and how many. At most AT_ONCE hits, or
        one frame's, are held at a time."""
        keys = run_keys(b, self.run)
        lo, hi = np.searchsorted(self.values, keys, "left"), np.searchsorted(self.values, keys, "right")
        ends = np.cumsum(hi - lo)
        slots, counts, k = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 0
        while k < len(keys):
            done = ends[k - 1] if k else 0
            stop = max(k + 1, int(np.searchsorted(ends, done + AT_ONCE, "right")))
            n = (hi - lo)[k:stop]
            at = np.repeat(lo[k:stop], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            query = self.query[at]
            more = self.starts[query] + query * np.int64(len(b)) + self.place[at] - np.repeat(np.arange(k, stop), n) + len(b)
            found, times = np.unique(more, return_counts=True)
            if len(slots):
                found, where = np.unique(np.concatenate([slots, found]), return_inverse=True)
                times = np.bincount(where, weights=np.concatenate([counts, times])).astype(np.int64)
            slots, counts, k = found, times, stop
        return slots, counts

    def align(self, b: np.ndarray, least: int = LEAST) -> list[np.ndarray]:
        """Columns query, offset, overlap, hits, bit error: the top of each query's histogram, where it overlaps enough."""
        slots, counts = self._histogram(b)
        query = np.searchsorted(self.starts + np.arange(len(self.starts)) * len(b), slots, "right") - 1
        order = np.lexsort((slots, -counts, query))
        order = order[np.unique(query[order], return_index=True)[1]]
        query, hits = query[order], counts[order]
        offset = slots[order] - self.starts[query] - query * len(b) - len(b)
        start, end = np.maximum(0, offset), np.minimum(self.sizes[query], len(b) + offset)
        kept = (end - start >= least) & (2 * (end - start) >= np.minimum(self.sizes[query], len(b)))
        query, hits, offset, start, overlap = query[kept], hits[kept], offset[kept], start[kept], (end - start)[kept]
        if not len(query):
            return [query, offset, overlap, hits, np.zeros(0)]
        first = np.cumsum(overlap) - overlap
        frame = np.repeat(start - first, overlap) + np.arange(overlap.sum())
        wrong = np.bitwise_count((self.flat[np.repeat(self.starts[query], overlap) + frame] ^ b[frame - np.repeat(offset, overlap)]).view(np.uint32))
        return [query, offset, overlap, hits, np.add.reduceat(wrong.astype(np.int64), first) / (32 * overlap)]

    def matches(self, b: np.ndarray) -> list[np.ndarray]:
        """What align() gives, where it is a match."""
        found = self.align(b)
        good = found[4] <= most_error(found[2])
        return [c[good] for c in found]


def _grid(rows: DataFrame, asked: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """rows with part and asked with block, each repeated for every cell of the grid. asked gets columns of its own, as a
    cogroup of two frames that share columns confuses them."""
    asked = asked.select(*[F.when(F.lit(True), F.col(c)).alias(c) for c in asked.columns])
    parts, blocks = (max(1, -(-(x.agg(F.sum(F.size("prints"))).first()[0] or 0) // most)) for x, most in ((rows, PART_INTS), (asked, BLOCK_INTS)))
    cell = lambda n: F.pmod(F.xxhash64(key, "prints"), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    return rows.withColumn("part", cell(parts)).select("*", each(blocks).alias("block")), asked.withColumn("block", cell(blocks)).select("*", each(parts).alias("part"))


def _prints(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [p.values.to_numpy(zero_copy_only=False) for p in column]


def _table(found: list[list], kinds: list[tuple[str, pa.DataType]]) -> pa.Table:
    none = [np.zeros(0, dtype=t.to_pandas_dtype()) for _, t in kinds]
    return pa.table([pa.array(np.concatenate(c), t) for c, (_, t) in zip(zip(none, *found, strict=True), kinds, strict=True)], names=[n for n, _ in kinds]) if found else pa.table([pa.array(c, t) for c, (_, t) in zip(none, kinds, strict=True)], names=[n for n, _ in kinds])


def match_recordings(prints: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, id, offset, overlap, hits, bit_error of each pair of a query and another recording that match: every pair,
    so the rows grow as the square of a group of copies; link_recordings() gives one row a recording."""
    rows, asked = _grid(*(x.where("size(prints) > 0").select("id", "prints").distinct() for x in (prints, queries)))
    kinds = [*[("query_id id offset overlap hits".split()[k], pa.int64()) for k in range(5)], ("bit_error", pa.float64())]

    def run(some: pa.Table, block: pa.Table) -> pa.Table:
        found: list[list] = []
        names = block.column("id").to_numpy()
        if len(names):
            index = QueryBlock(_prints(block.column("prints")))
            for i, p in zip(some.column("id").to_pylist(), _prints(some.column("prints")), strict=True):
                query, *columns = index.matches(p)
                other = names[query] != i
                found.append([names[query[other]], np.full(other.sum(), i), *(c[other] for c in columns)])
        return _table(found, kinds)

    key = ["block", "part"]
    out = rows.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(run, "query_id bigint, id bigint, offset bigint, overlap bigint, hits bigint, bit_error double")
    return out.distinct()


def _class_links(classes: DataFrame) -> DataFrame:
    """key, links, best (bit_error, query_id, offset, overlap, hits), joined: for each class that matches query classes other
    than itself, in one cell of the grid: how many queries, the best of them, and links that join what the cell connects,
    a forest and not all pairs. classes: key (a hash of the integers, its name), prints, asked (queries in it), first (the
    least query)."""
    rows, asked = _grid(classes.select("key", "prints"), classes.where("asked > 0").select("key", "prints", "asked", "first"), "key")
    best = pa.struct([("bit_error", pa.float64()), ("query_id", pa.int64()), ("offset", pa.int64()), ("overlap", pa.int64()), ("hits", pa.int64())])
    schema = pa.schema([("key", pa.int64()), ("links", pa.int64()), ("best", best), ("joined", pa.list_(pa.int64()))])

    def run(some: pa.Table, block: pa.Table) -> pa.Table:
        out: list[dict] = []
        names, counts, first = (block.column(c).to_numpy() for c in ("key", "asked", "first"))
        if len(names):
            index, root = QueryBlock(_prints(block.column("prints"))), list(range(len(names)))

            def find(k: int) -> int:
                while root[k] != k:
                    root[k] = root[root[k]]
                    k = root[k]
                return k

            for name, p in zip(some.column("key").to_pylist(), _prints(some.column("prints")), strict=True):
                query, offset, overlap, hits, error = index.matches(p)
                other = names[query] != name
                query, offset, overlap, hits, error = (c[other] for c in (query, offset, overlap, hits, error))
                if not len(query):
                    continue
                top = int(np.lexsort((first[query], error))[0])
                joined = {find(k): k for k in reversed(query.tolist())}
                low = min(joined)
                for k in joined:
                    root[k] = low
                best = {"bit_error": error[top], "query_id": first[query[top]], "offset": offset[top], "overlap": overlap[top], "hits": hits[top]}
                out.append({"key": name, "links": int(counts[query].sum()), "best": best, "joined": [names[k] for k in joined.values()]})
        return pa.Table.from_pylist(out, schema)

    cell = ["block", "part"]
    return rows.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInArrow(run, "key bigint, links bigint, best struct<bit_error:double,query_id:bigint,offset:bigint,overlap:bigint,hits:bigint>, joined array<bigint>")


def link_recordings(prints: DataFrame, is_query: str) -> DataFrame:
    """One row an id of prints: id, class_id, links, query_id, offset, overlap, hits, bit_error. links: how many queries
    (rows where the SQL condition is_query holds) other than itself the recording matches; query_id and the rest: the one
    of the least error, then of the least id; class_id: the least id that matches and equal integers connect it with."""
    rows = prints.groupBy("id", "prints").agg(F.expr(f"first({is_query})").alias("is_query"))
    rows = materialize(rows.withColumn("key", F.xxhash64("prints")), "recordings")
    heard = rows.where("size(prints) > 0")
    asked = F.when(F.col("is_query"), F.col("id"))
    classes = heard.groupBy("key", "prints").agg(F.min("id").alias("rep"), F.count(asked).alias("asked"), F.min(asked).alias("first"), F.max(asked).alias("last"))
    classes = materialize(classes, "classes")
    cells = materialize(_class_links(classes), "class-links")
    labels = components(cells.select(F.col("key").alias("a"), F.explode("joined").alias("b")).distinct()).withColumnRenamed("v", "key")
    found = cells.groupBy("key").agg(F.sum("links").alias("links"), F.min("best").alias("best"))
    linked = classes.join(labels, "key")
    least = linked.groupBy("label").agg(F.min("rep").alias("least"))
    named = with_join_key(linked.select("key", "label"), "j", "label").join(with_join_key(least, "j", "label"), ["j", "label"]).select("key", "least")
    known = classes.join(found, "key", "left").join(named, "key", "left")
    known = materialize(known.select("key", "prints", "rep", "asked", "first", "last", "links", "best", "least"), "named-classes")
    each = with_join_key(heard, "j", "key").join(with_join_key(known, "j", "key"), ["j", "key", "prints"])
    # equal recordings: the query is the least of the class, or for that one the greatest, if it is another
    twin = F.when(F.col("first") != F.col("id"), F.col("first")).when(F.col("last") != F.col("id"), F.col("last"))
    n = F.size("prints").cast("bigint")
    equal = F.struct(F.lit(0.0).alias("bit_error"), twin.alias("query_id"), F.lit(0).cast("bigint").alias("offset"), n.alias("overlap"), n.alias("hits"))
    links = F.coalesce("links", F.lit(0)) + F.col("asked") - F.when(F.col("is_query"), 1).otherwise(0)
    told = each.select("id", F.coalesce("least", "rep").alias("class_id"), links.alias("links"), F.when(twin.isNotNull(), equal).otherwise(F.col("best")).alias("best"))
    silent = rows.where("size(prints) = 0").select("id", F.col("id").alias("class_id"), F.lit(0).cast("bigint").alias("links"), F.lit(None).cast(told.schema["best"].dataType).alias("best"))
    merged = told.unionAll(silent).groupBy("id").agg(F.min("class_id").alias("class_id"), F.sum("links").alias("links"), F.min("best").alias("best"))
    return merged.select("id", "class_id", "links", "best.query_id", "best.offset", "best.overlap", "best.hits", "best.bit_error")


def op2_audio_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a recording: its class and its number of links to the queries, the ids divisible by 100, searched in all rows."""
    media = table(spark, sf_dir, "embeddings").repartition(max(32, 4 * spark.sparkContext.defaultParallelism))
    prints = materialize(fingerprint_audio(media, "vec_id", "embedding", vector_audio), "audio")
    return link_recordings(prints, "id % 100 = 0").withColumnRenamed("id", "vec_id")
