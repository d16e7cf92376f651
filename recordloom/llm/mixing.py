"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic). Raking scales the cells until their source, language and
topic shares are the targets'. A cell's probability is its calibrated weight over its tokens, times the rate at which the
expected sample is the wanted part of all tokens. Where that passes 1, the sample is raked again with no cell over its
tokens; a value that has fewer tokens than its share asks for gives all it has, and the others keep their proportions
in what is missing. A document stays if a hash of its id and text, as a number in [0, 1), is below its cell's probability.

Topics come from a small model: words are hashed to DIMS numbers, weighted by how few documents have them, and spherical
k-means finds TOPICS centres over all documents, in a pass a round; every document gets the topic of its nearest centre from its
whole text. Tokens are counted by the tokenizer. Both take one pass over the texts, which writes each document's counts; the
model's passes read these.

The targets name the values of each dimension; all other values, null among them, are one value "*" that keeps its own
share unless it is named. So there are at most (named + 1) values a dimension, and the table of cells, which goes to the
driver and back, is bounded by the targets and not by the data. Where no targets are given, they are the shares of the NAMED
values with the most tokens, to the power EVEN and scaled: large values give way to small ones.

Defined results: a null or empty text, or one without words, has topic "none" and one token at least. Target values
without tokens are left out and the others scaled up. Rows repeated in full stay or go together. An empty table gives an
empty result. Other columns of docs are kept as they are; the new ones get a "_" more where docs has their name.
"""

from __future__ import annotations

import struct
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, materialize, table
from .packing import encode, tokenizer_files

DIMENSIONS = ("source", "lang", "topic")
DIMS, TOPICS, NAMED, EVEN = 1024, 8, {"source": 64, "lang": 16, "topic": 64}, 0.5


#: A document's counts: its slots that have any.
COUNTS = np.dtype([("slot", "<u2"), ("n", "<u4")])
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return x << np.uint64(n) | x >> np.uint64(64 - n)


def hashed_words(data: bytes, starts: np.ndarray, ends: np.ndarray, seed: int = 7) -> np.ndarray:
    """XXH64 of the bytes from each start to its end, all at once; those of 32 bytes or more one by one."""
    n, at = ends - starts, starts.astype(np.int64)
    ahead = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data + bytes(8), dtype=np.uint8), 8)
    h = n.astype(np.uint64) + np.uint64(seed) + _P5
    some = np.flatnonzero((n >= 8) & (n < 32))
    rest = np.where(n < 32, n, 0)
    while len(some):
        lane = ahead[at[some]].view("<u8")[:, 0]
        h[some] = _rotated(h[some] ^ _rotated(lane * _P2, 31) * _P1, 27) * _P1 + _P4
        at[some] += 8
        rest[some] -= 8
        some = some[rest[some] >= 8]
    some = np.flatnonzero(rest >= 4)
    lane = ahead[at[some]].view("<u4")[:, 0].astype(np.uint64)
    h[some] = _rotated(h[some] ^ lane * _P1, 23) * _P2 + _P3
    at[some] += 4
    rest[some] -= 4
    some = np.flatnonzero(rest)
    while len(some):
        h[some] = _rotated(h[some] ^ ahead[at[some], 0] * _P5, 11) * _P1
        at[some] += 1
        rest[some] -= 1
        some = some[rest[some] > 0]
    h = (h ^ h >> np.uint64(33)) * _P2
    h = (h ^ h >> np.uint64(29)) * _P3
    h ^= h >> np.uint64(32)
    for k in np.flatnonzero(n >= 32).tolist():
        h[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]], seed)
    return h


def all_counts(texts: list[str | None], dims: int = DIMS) -> list[bytes]:
    """COUNTS of each text: how often its words, as of split_words(), fall in each slot."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = b" " + b" ".join(parts).lower() + b" "
    blank = _BLANK[np.frombuffer(data, dtype=np.uint8)]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    slots = (hashed_words(data, starts, ends) % np.uint64(dims)).astype(np.int64)
    text = np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), starts - 1, "right")
    n = np.bincount(text * dims + slots, minlength=len(texts) * dims)
    key = np.flatnonzero(n)
    held = np.empty(len(key), dtype=COUNTS)
    held["slot"], held["n"] = key % dims, n[key]
    cuts = np.searchsorted(key, np.arange(len(texts) + 1) * dims).tolist()
    return [held[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _pieces(texts: list[str], size: int = 1 << 20) -> Iterator[list[str]]:
    """The texts in turn, as many as have that many characters together, one at least."""
    held, n = [], 0
    for t in texts:
        if held and n + len(t) > size:
            yield held
            held, n = [], 0
        held.append(t)
        n += len(t)
    if held:
        yield held


def word_counts(text: str | None, dims: int = DIMS) -> np.ndarray:
    """How often the text's words fall in each slot."""
    counts, out = np.frombuffer(all_counts([text], dims)[0], dtype=COUNTS), np.zeros(dims, dtype=np.float32)
    out[counts["slot"]] = counts["n"]
    return out


def sparse(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The counts of all rows one after the other, and where each row's begin. The rows' bytes aren't copied."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, dtype=np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    counts = np.frombuffer(data or b"", dtype=np.uint8)[ends[0] : ends[-1]].view(COUNTS)
    return counts, (ends - ends[0]) // COUNTS.itemsize


@dataclass
class Model:
    """weight of each slot; a row a topic; tokens a byte of all rows."""

    weight: np.ndarray
    centres: np.ndarray
    ratio: float = 0.25

    def values(self, counts: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """The entries of each row's unit vector; no row is empty."""
        v = np.log1p(counts["n"].astype(np.float32)) * self.weight[counts["slot"]]
        norm = np.sqrt(np.add.reduceat(v * v, cuts[:-1])) if len(v) else v
        return v / np.repeat(np.maximum(norm, 1e-9), np.diff(cuts))

    def vectors(self, counts: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """A unit row a document that has words."""
        dims = len(self.weight)
        out = np.zeros((len(cuts) - 1, dims), dtype=np.float32)
        out.reshape(-1)[np.repeat(np.arange(len(out)) * dims, np.diff(cuts)) + counts["slot"]] = self.values(counts, cuts)
        return out

    def likeness(self, counts: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """A row a document that has words, a column a centre."""
        return self.vectors(counts, cuts) @ self.centres.T

    def topics(self, column: pa.Array) -> list[str]:
        counts, cuts = sparse(column)
        some = np.flatnonzero(np.diff(cuts))
        out = ["none"] * len(column)
        if len(some) and len(self.centres):
            cuts = np.append(cuts[some], len(counts))
            for a in range(0, len(some), 1024):
                b = cuts[a : a + 1025]
                for k, c in zip(some[a : a + 1024].tolist(), self.likeness(counts[b[0] : b[-1]], b - b[0]).argmax(axis=1).tolist(), strict=True):
                    out[k] = f"topic{c}"
        return out


def cluster(x: np.ndarray, k: int, rounds: int = 30) -> np.ndarray:
    """Spherical k-means of unit rows: each centre after the first is the row least like those before; largest cluster first."""
    centres = x[:1]
    while len(centres) < min(k, len(x)):
        like = (x @ centres.T).max(axis=1)
        if like.min() > 1 - 1e-6:
            break
        centres = np.concatenate([centres, x[like.argmin()][None]])
    sizes = np.zeros(len(centres))
    for _ in range(rounds):
        at = (x @ centres.T).argmax(axis=1)
        sizes = np.bincount(at, minlength=len(centres))
        sums = np.stack([x[at == c].sum(axis=0) if sizes[c] else centres[c] for c in range(len(centres))])
        new = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        if np.allclose(new, centres, atol=1e-6):
            break
        centres = new
    return centres[np.argsort(-sizes, kind="stable")]


def counted(docs: DataFrame, row: Column, seed: int, dims: int = DIMS) -> DataFrame:
    """row, source, lang, u (a number in [0, 1) by id and text), counts, bytes, tokens of each row of docs, as a table."""
    u = F.pmod(F.xxhash64(F.lit(seed), "doc_id", F.coalesce("text", F.lit(""))), F.lit(1 << 53)) / F.lit(float(1 << 53))
    kind = docs.select(row.alias("row")).schema["row"].dataType.simpleString()
    vocabulary, ranks = tokenizer_files()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [x or "" for x in part.column("text").to_pylist()]
                held = [c for piece in _pieces(texts) for c in all_counts(piece, dims)]
                tokens = [max(1, len(e)) for e in encode(texts, vocabulary, ranks)]
                own = [part.column(c) for c in ("row", "source", "lang", "u")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(held, pa.binary()), part.column("bytes"), pa.array(tokens, pa.int64())], ["row", "source", "lang", "u", "counts", "bytes", "tokens"])

    text = [F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")]
    rows = docs.select(row.alias("row"), *text, F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("bigint").alias("bytes"), u.alias("u"))
    return materialize(rows.mapInArrow(run, f"row {kind}, source string, lang string, u double, counts binary, bytes bigint, tokens bigint"), "counted")


def fit(docs: DataFrame, sample: int | None = None, topics: int = TOPICS, dims: int = DIMS) -> Model:
    """The model of all rows; sample: of so many documents, those of the least hash of their id."""
    if sample is not None:
        chosen = docs.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64(F.lit(13), "doc_id"), "doc_id").limit(sample)
        docs = docs.join(F.broadcast(chosen), "doc_id", "left_semi")
    return fit_counted(counted(docs, F.col("doc_id"), 0, dims), topics, dims)


def fit_counted(rows: DataFrame, topics: int = TOPICS, dims: int = DIMS, rounds: int = 30) -> Model:
    """The model of all rows of counted(): cluster() with each pass over the rows as a job. The driver gets sums, a row a task."""
    filled = rows.select("counts").where(F.octet_length("counts") > 0)

    def passed(work: Callable, schema: str) -> list:
        """What work makes of a task's rows: of what it made so far, some rows' counts and where each row's begin."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for k in range(0, batch.num_rows, 1024):
                    total = work(total, *sparse(batch.column(0).slice(k, 1024)))
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in total], ["a", "b"])

        return filled.mapInArrow(run, schema).collect()

    pair = "a binary, b binary"

    def having(total, counts, cuts):
        n = np.bincount(counts["slot"], minlength=dims)
        return [(n + (0 if total is None else np.frombuffer(total[0], dtype=np.int64))).astype(np.int64).tobytes(), b""]

    size = rows.agg(F.count(F.lit(1)), F.sum("bytes"), F.sum(F.when(F.col("bytes") > 0, F.col("tokens")))).first()
    have = sum((np.frombuffer(r.a, dtype=np.int64) for r in passed(having, pair)), np.zeros(dims, dtype=np.int64))
    model = Model(np.log((1 + size[0]) / (1 + have)).astype(np.float32), np.zeros((0, dims), dtype=np.float32))
    if size[1]:
        model.ratio = size[2] / size[1]

    def vector(data: bytes) -> np.ndarray:
        counts = np.frombuffer(data, dtype=COUNTS)
        return model.vectors(counts, np.array([0, len(counts)]))[0]

    def least(total, counts, cuts):
        like = model.likeness(counts, cuts).max(axis=1)
        at = int(like.argmin())
        mine = [struct.pack("<d", float(like[at])), counts[cuts[at] : cuts[at + 1]].tobytes()]
        return mine if total is None else min(total, mine, key=lambda t: (struct.unpack("<d", t[0])[0], t[1]))

    def sums(total, counts, cuts):
        x = model.vectors(counts, cuts)
        mine_at = (x @ model.centres.T).argmax(axis=1)[:, None] == np.arange(len(model.centres))
        mine = [(mine_at.T.astype(np.float32) @ x).astype(np.float64).ravel(), mine_at.sum(axis=0).astype(np.float64)]
        return [(m + (0 if total is None else np.frombuffer(total[k], dtype=np.float64))).tobytes() for k, m in enumerate(mine)]

    first = filled.orderBy(F.xxhash64(F.lit(13), "counts"), "counts").limit(1).collect()
    if not first:
        return model
    model.centres = vector(bytes(first[0][0]))[None]
    while len(model.centres) < topics:
        like, data = min((struct.unpack("<d", r.a)[0], bytes(r.b)) for r in passed(least, pair))
        if like > 1 - 1e-6:
            break
        model.centres = np.concatenate([model.centres, vector(data)[None]])
    for _ in range(rounds):
        got = passed(sums, pair)
        total = sum(np.frombuffer(r.a, dtype=np.float64) for r in got).reshape(len(model.centres), dims)
        sizes = sum(np.frombuffer(r.b, dtype=np.float64) for r in got)
        new = np.where(sizes[:, None] > 0, total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9), model.centres)
        moved = float(np.abs(new - model.centres).max())
        model.centres = new.astype(np.float32)
        if moved <= 1e-6:
            break
    else:
        warnings.warn(f"after {rounds} rounds the topics' centres still moved by {moved:.2g}", stacklevel=2)
    model.centres = model.centres[np.argsort(-sizes, kind="stable")]
    return model


def labelled(docs: DataFrame, model: Model, row: Column, seed: int) -> DataFrame:
    """row, source, lang, topic, tokens, u (a number in [0, 1) by id and text) of each row of docs."""
    return label(counted(docs, row, seed, len(model.weight)), model)


def label(rows: DataFrame, model: Model) -> DataFrame:
    """labelled() of the rows of counted()."""
    names = ["row", "source", "lang", "topic", "tokens", "u"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            topics = pa.array(model.topics(batch.column("counts")), pa.string())
            yield pa.RecordBatch.from_arrays([topics if n == "topic" else batch.column(n) for n in names], names)

    kind = rows.schema["row"].dataType.simpleString()
    return materialize(rows.drop("bytes").mapInArrow(run, f"row {kind}, source string, lang string, topic string, tokens bigint, u double"), "labelled")


def default_targets(rows: DataFrame, named: dict[str, int] | None = None, even: float = EVEN) -> dict:
    """Of each dimension's values with the most tokens, the shares to a power, scaled to what they have together."""
    out = {}
    for d in DIMENSIONS:
        top = rows.where(F.col(d).isNotNull()).groupBy(d).agg(F.sum("tokens").alias("n")).orderBy(F.desc("n"), d).limit((named or NAMED)[d]).collect()
        flat = {r[0]: float(r[1]) ** even for r in top}
        out[d] = {v: x / sum(flat.values()) for v, x in flat.items()}
    return out


def rake(sums: np.ndarray, codes: np.ndarray, targets: list[np.ndarray], rounds: int = 500, tolerance: float = 1e-12) -> np.ndarray:
    """Weights of cells (codes: a column a dimension) whose shares of every dimension are the targets'."""
    w = sums / sums.sum()
    for _ in range(rounds):
        worst = 0.0
        for d, want in enumerate(targets):
            have = np.bincount(codes[:, d], weights=w, minlength=len(want))
            factor = np.divide(want, have, out=np.ones_like(want), where=have > 0)
            worst = max(worst, float(np.abs(have - want)[have > 0].max(initial=0)))
            w = w * factor[codes[:, d]]
        if worst < tolerance:
            break
    return w / w.sum()


def probabilities(sums: np.ndarray, weights: np.ndarray, part: float) -> np.ndarray:
    """min(1, rate * weight / sum) with the rate at which the expected tokens are part of all, as far as that can be."""
    ratio = weights * sums.sum() / sums
    want, full = part * sums.sum(), np.zeros(len(sums), dtype=bool)
    while True:
        free = (ratio * sums)[~full].sum()
        rate = (want - sums[full].sum()) / free if free > 0 else 0.0
        more = ~full & (rate * ratio >= 1)
        if not more.any():
            return np.where(full, 1.0, np.clip(rate * ratio, 0, 1))
        full |= more


def fill(start: np.ndarray, caps: np.ndarray, total: float) -> np.ndarray:
    """min(caps, factor * start) with the factor at which the sum is total, or caps where they have no more."""
    out, full = np.zeros(len(start)), start <= 0
    rest = total
    while not full.all():
        factor = max(rest, 0.0) / start[~full].sum()
        more = ~full & (factor * start >= caps)
        if not more.any():
            out[~full] = factor * start[~full]
            break
        out[more] = caps[more]
        rest, full = rest - caps[more].sum(), full | more
    return out


def bounded(sums: np.ndarray, weights: np.ndarray, codes: np.ndarray, targets: list[np.ndarray], part: float, rounds: int = 3000, tolerance: float = 1e-9) -> np.ndarray:
    """Probabilities whose expected sample is part of all tokens and has the targets' shares, as far as the tokens suffice."""
    size = part * sums.sum()
    if (weights * size <= sums).all():
        return weights * size / sums
    wanted = [fill(t, np.bincount(codes[:, d], weights=sums, minlength=len(t)), size) for d, t in enumerate(targets)]
    m = fill(weights, sums, size)
    cells = [[np.flatnonzero(codes[:, d] == v) for v in range(len(t))] for d, t in enumerate(targets)]
    for _ in range(rounds):
        before = m.copy()
        for d, want in enumerate(wanted):
            for v, at in enumerate(cells[d]):
                m[at] = fill(m[at], sums[at], want[v])
        if np.abs(m - before).max() <= tolerance * size:
            break
    return np.clip(fill(m, sums, size) / sums, 0, 1)


def cell_columns(targets: dict) -> list[Column]:
    return [F.when(F.col(d).isin(*targets[d]), F.col(d)).otherwise("*").alias(f"cell_{d}") for d in DIMENSIONS]


def calibrate(rows: DataFrame, targets: dict, part: float = 0.7) -> list[tuple]:
    """(source, lang, topic, weight, probability) of each cell of rows, as of labelled()."""
    cells = rows.select(*cell_columns(targets), "tokens").groupBy(*(f"cell_{d}" for d in DIMENSIONS)).agg(F.sum("tokens").alias("n")).collect()
    cells = sorted(tuple(c) for c in cells)
    if not cells:
        return []
    sums = np.array([c[3] for c in cells], dtype=float)
    codes, wants = np.zeros((len(cells), 3), dtype=np.int64), []
    for d, name in enumerate(DIMENSIONS):
        values = sorted({c[d] for c in cells})
        codes[:, d] = [values.index(c[d]) for c in cells]
        have = np.bincount(codes[:, d], weights=sums) / sums.sum()
        want = np.array([targets[name].get(v, np.nan) for v in values])
        own = np.isnan(want)
        if (~own).any() and want[~own].sum() > 0:
            want[~own] *= (1 - have[own].sum()) / want[~own].sum()
        want[own] = have[own]
        wants.append(want)
    weights = rake(sums, codes, wants)
    gap = max(float(np.abs(np.bincount(codes[:, d], weights=weights, minlength=len(t)) - t).max()) for d, t in enumerate(wants))
    if gap > 1e-6:
        warnings.warn(f"raking left a share {gap:.2g} from its target: the cells don't allow all targets at once", stacklevel=2)
    return [(*c[:3], float(w / (s / sums.sum())), float(p)) for c, w, s, p in zip(cells, weights, sums, bounded(sums, weights, codes, wants, part), strict=True)]


def _mixed(docs: DataFrame, row: Column, targets: dict | None, part: float, seed: int) -> DataFrame:
    """row, source, lang, topic (of its cell), tokens, weight, probability, kept."""
    rows = counted(docs, row, seed)
    rows = label(rows, fit_counted(rows))
    targets = targets or default_targets(rows)
    keys = [f"cell_{d}" for d in DIMENSIONS]
    known = docs.sparkSession.createDataFrame(calibrate(rows, targets, part), ", ".join(f"{k} string" for k in keys) + ", weight double, probability double")
    both = rows.select("row", "tokens", "u", *cell_columns(targets)).join(F.broadcast(known), keys)
    return both.select("row", *[F.col(f"cell_{d}").alias(d) for d in DIMENSIONS], "tokens", "weight", "probability", (F.col("u") < F.col("probability")).alias("kept"))


def mix(docs: DataFrame, targets: dict | None = None, part: float = 0.7, seed: int = 17) -> DataFrame:
    """docs with __source, __lang, __topic, __tokens, __weight, __probability and __kept."""
    names = [*DIMENSIONS, "tokens", "weight", "probability", "kept"]
    mixed = _mixed(docs, _whole(docs), targets, part, seed)
    return mixed.select(*_fields(docs), *[F.col(n).alias(free_name(docs, f"__{n}")) for n in names])


def keep_sample(docs: DataFrame, targets: dict | None = None, part: float = 0.7, seed: int = 17) -> DataFrame:
    """The rows of docs that mix() keeps, with all their columns."""
    return _mixed(docs, _whole(docs), targets, part, seed).where("kept").select(*_fields(docs))


def _whole(docs: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def _fields(docs: DataFrame) -> list[Column]:
    return [F.col(f"row.`{c}`").alias(c) for c in docs.columns]


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(table(spark, sf_dir, "documents"), F.col("doc_id"), None, 0.7, 17).withColumnRenamed("row", "doc_id")
