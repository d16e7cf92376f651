"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of the whole text (shares of character classes, words, repetition, lines) are binned at quantiles of
the training sample; each tree grows level by level from gradient histograms. The forest is flattened into arrays
(feature, threshold, left, right, value), which numpy walks for all rows of a batch at once. Training takes at most
max_rows labelled rows, those of the least hash of their id, to the driver: max_rows * 29 numbers.

Defined results: a null or empty text has statistics of zero and gets a score like any other. Of labels repeated
for one id, the mean counts (1 from 0.5); of rows repeated under one labelled id, that of the least statistics teaches. A null label or id teaches nothing. Without labels, every score is 0.5;
with one class only, every score is that class's smoothed share. Rows with a null id are scored and are not held
out. An empty table gives an empty result. Only the id and the text are read, never lang, source or the id's value.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MAX_ROWS = 20_000
_CLASS = np.zeros(256, dtype=np.int64)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c", b".", b",", b"!?", b"#$%&*", b"|", b"<>{}[]()=;/\\_^~`@+", b"'\"-:"), 1):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 14
NAMES = [
    "log_bytes", "log_words", "bytes_per_word", "longest_word", "distinct_words", "top_word", "same_as_before", "same_as_two_before", "title_words", "shout_words",
    "odd_ends", "lines", "words_per_line", "distinct_lines", *(f"class_{k}" for k in range(15)),
]


def statistics(text: str | None) -> list[float]:
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [float(np.log1p(len(data)))] + [0.0] * (len(NAMES) - 1)
    n, lines = len(words), data.split(b"\n")
    counts = Counter(words)
    byte_counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    shares = np.bincount(_CLASS, weights=byte_counts, minlength=15) / len(data)
    ends = np.bincount(np.frombuffer(bytes(w[-1] for w in words), dtype=np.uint8), minlength=256)
    odd = sum(int(ends[_CLASS == k].sum()) for k in (8, 9, 10, 11))
    return [
        float(np.log1p(len(data))), float(np.log1p(n)), len(data) / n, float(max(map(len, words))), len(counts) / n, max(counts.values()) / n,
        sum(map(eq, words, words[1:])) / n, sum(map(eq, words, words[2:])) / n, sum(map(bytes.istitle, words)) / n, sum(map(bytes.isupper, words)) / n,
        odd / n, float(np.log1p(len(lines))), n / len(lines), len(set(lines)) / len(lines), *shares.tolist(),
    ]


@dataclass
class Forest:
    """Nodes of all trees in arrays. A leaf's children are itself, so a walk of depth steps ends at a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, least: int = 10, ridge: float = 1.0) -> Forest:
    """Newton steps of the logistic loss. A split needs least rows on either side."""
    share = (y.sum() + 1) / (len(y) + 2)
    nodes: list[list[float]] = []
    roots: list[int] = []
    base = float(np.log(share / (1 - share)))
    if len(y) >= 2 * least and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins)) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        columns, width = x.shape[1], bins
        flat = binned + np.arange(columns) * width
        total = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-total))
            grad, hess = p - y, p * (1 - p)
            roots.append(len(nodes))
            nodes.append([0, np.inf, 0, 0, 0.0])
            level = [(roots[-1], np.arange(len(y)))]
            for d in range(depth + 1):
                below = []
                for node, rows in level:
                    g, h = grad[rows].sum(), hess[rows].sum()
                    nodes[node][2] = nodes[node][3] = node
                    nodes[node][4] = float(-rate * g / (h + ridge))
                    total[rows] += nodes[node][4] if d == depth else 0
                    found = None
                    if d < depth and len(rows) >= 2 * least:
                        at = flat[rows].ravel()
                        hist = lambda w: np.cumsum(np.bincount(at, weights=None if w is None else np.repeat(w[rows], columns), minlength=columns * width).reshape(columns, width), axis=1)  # noqa: B023, E731
                        gs, hs, ns = hist(grad), hist(hess), hist(None)
                        gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g * g / (h + ridge)
                        gain[(ns < least) | (ns > len(rows) - least)] = 0
                        f, b = np.unravel_index(int(gain.argmax()), gain.shape)
                        if gain[f, b] > 1e-9 and b < len(cuts[f]):
                            found = int(f), int(b)
                    if found:
                        f, b = found
                        goes = binned[rows, f] <= b
                        nodes[node][:4] = [f, float(cuts[f][b]), len(nodes), len(nodes) + 1]
                        below += [(len(nodes), rows[goes]), (len(nodes) + 1, rows[~goes])]
                        nodes += [[0, np.inf, 0, 0, 0.0], [0, np.inf, 0, 0, 0.0]]
                    elif d < depth:
                        total[rows] += nodes[node][4]
                level = below
    table_ = np.array(nodes, dtype=float).reshape(-1, 5)
    whole = lambda k: table_[:, k].astype(np.int64)
    return Forest(whole(0), table_[:, 1], whole(2), whole(3), table_[:, 4], np.array(roots, dtype=np.int64), depth, base)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0, F.lit(False))


def _mapped(docs: DataFrame, names: list[str], function, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                rows = np.array([statistics(t.as_py()) for t in part.column(part.num_columns - 1)], dtype=float).reshape(-1, len(NAMES))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *function(rows)], names)

    return docs.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = MAX_ROWS, **options) -> Forest:
    """Fit on the labelled rows that aren't held out. The sample's ids and labels (max_rows at most) are broadcast, and
    one row an id comes back."""
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col(label_col).cast("double").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    known = known.where(~held_out()).groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("double").alias("label"))
    sample = known.orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    found = _mapped(rows, ["doc_id", "label", "x"], lambda x: [pa.array(list(x), pa.list_(pa.float64()))], f"doc_id {id_type}, label double, x array<double>")
    got = found.groupBy("doc_id").agg(F.min(F.struct("label", "x")).alias("row")).select("row.label", "row.x").toArrow()
    y = got.column("label").to_numpy()
    x = np.array(got.column("x").to_pylist(), dtype=float).reshape(-1, len(NAMES))
    order = np.lexsort((*x.T, y))  # the same forest whatever the order of arrival
    if not len(y):
        return Forest(*(np.zeros(0, dtype=np.int64),) * 6, 0, 0.0)
    return fit(x[order], y[order], **options)


def score(docs: DataFrame, forest: Forest, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, one row per row of docs."""
    rows = docs.select(F.col("doc_id").alias("doc_id"), held_out().alias("held_out"), F.col("text").alias("text"))

    def columns(x: np.ndarray) -> list[pa.Array]:
        s = forest.score(x)
        return [pa.array(s), pa.array((s >= threshold).astype(np.int32))]

    return _mapped(rows, ["doc_id", "held_out", "score", "predicted"], columns, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, forest: Forest, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score threshold or more, with all their columns."""
    names, schema = docs.columns, docs.schema
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                rows = np.array([statistics(t.as_py()) for t in part.column(at)], dtype=float).reshape(-1, len(NAMES))
                yield part.filter(pa.array(forest.score(rows) >= threshold))

    return docs.mapInArrow(run, schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
