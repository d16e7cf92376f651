"""Cost-balanced packing of token sequences.

Documents stream through in windows of bounded size. In a window, what goes over whole sequences is cut off a
document first; the rest is taken in descending length, and each goes to the sequence of the lowest estimated
cost (linear plus quadratic in the length of each piece, as attention costs) that has room for it. Where none
has, it is cut over the emptiest ones. A window opens as many tokens of room as it has: sequences of the full
length, and for the remainder one sequence for each power of two in it, which needs no padding. So a window is
its own unit of work, and nothing is shuffled or gathered.

Defined results: a null or empty text is the end id alone. Null or repeated ids are packed row by row. An empty
table gives an empty result. Only the id and the text are read. Windows follow the input's partitions, so which documents
share a sequence depends on how the files are split; each document's pieces and ids don't. A text and its ids are held
whole, some 10 bytes a byte of text.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WINDOW_TOKENS, WINDOW_DOCS = 1 << 21, 8192
#: Characters that every Unicode version puts in the same class; other texts go the slower way.
PLAIN = re.compile(r"[\x00-\u024f\u2000-\u206f\u20a0-\u20bf]*")
#: The merge ranks' splitter recurses over a run of one kind of character; texts with a longer one go the slower way.
LONG_RUN = re.compile(r"\s{10000}|\w{10000}|[^\s\w]{10000}")


@functools.lru_cache(maxsize=2)
def _encoders(vocabulary: str, ranks: str | None):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(vocabulary)
    if ranks is None:
        return slow, None, ()
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    added = tuple(x.content for x in slow.get_added_tokens_decoder().values())
    return slow, tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={}), added


def encode(texts: list[str], vocabulary: str, ranks: str | None = None) -> list[np.ndarray]:
    """The ids of the tokenizers vocabulary, without special tokens. ranks: the same vocabulary as merge ranks,
    which gives the same ids faster for texts of plain characters without an added token's string."""
    slow, fast, added = _encoders(vocabulary, ranks)
    out: list = [None] * len(texts)
    rest = []
    for k, text in enumerate(texts):
        if fast is not None and PLAIN.fullmatch(text) and not any(x in text for x in added) and (len(text) < 10_000 or not LONG_RUN.search(text)):
            out[k] = np.array(fast.encode_ordinary(text), dtype="<u4")
        else:
            rest.append(k)
    for k in rest:
        out[k] = np.array(slow.encode(texts[k], add_special_tokens=False).ids, dtype="<u4")
    return out


def tokenizer_files() -> tuple[str, str]:
    """The vocabulary and the same as merge ranks, where pack_documents() gets none."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def pack(sizes: list[int], room: int = 2048, linear: float = 1.0, quadratic: float = 1 / 2048) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; all sequences are full."""
    pieces, sequences, rest = [], 0, []
    for k, size in enumerate(sizes):
        for start in range(0, size - room + 1, room):
            pieces.append((k, start, room, sequences, 0))
            sequences += 1
        if size % room:
            rest.append((size % room, k))
    total = sum(x for x, _ in rest)
    caps = [room] * (total // room) + [1 << b for b in range(room.bit_length() - 1, -1, -1) if (total % room) >> b & 1]
    free, used, cost = np.array(caps, dtype=np.int64), np.zeros(len(caps), dtype=np.int64), np.zeros(len(caps))
    for length, k in sorted(rest, key=lambda x: (-x[0], x[1])):
        start = sizes[k] - length
        while length:
            fits = np.where(free >= length, cost, np.inf)
            at = int(fits.argmin())
            if fits[at] == np.inf:
                at = int(free.argmax())
            n = min(length, int(free[at]))
            pieces.append((k, start, n, sequences + at, int(used[at])))
            free[at] -= n
            used[at] += n
            cost[at] += linear * n + quadratic * n * n
            start, length = start + n, length - n
    return pieces


def pack_documents(docs: DataFrame, vocabulary: str | None = None, ranks: str | None = None, room: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if vocabulary is None:
        vocabulary, ranks = tokenizer_files()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def window(ids: list, tokens: list[np.ndarray], first: int) -> tuple[pa.RecordBatch, int]:
        pieces = pack([len(t) for t in tokens], room)
        rows = [(ids[k], start, n, zlib.crc32(tokens[k][start : start + n].tobytes()), len(tokens[k]), first + s, offset) for k, start, n, s, offset in pieces]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names), first + 1 + max(p[3] for p in pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        next_id = TaskContext.get().partitionId() << 40
        ids, tokens, total = [], [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                for i, t in zip(part.column(0).to_pylist(), encode([x or "" for x in part.column(1).to_pylist()], vocabulary, ranks), strict=True):
                    ids.append(i)
                    tokens.append(np.append(t, np.uint32(end_id)).astype("<u4"))
                    total += len(tokens[-1])
                    if total >= WINDOW_TOKENS or len(ids) >= WINDOW_DOCS:
                        out, next_id = window(ids, tokens, next_id)
                        yield out
                        ids, tokens, total = [], [], 0
        if ids:
            yield window(ids, tokens, next_id)[0]

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, ", ".join(f"`{n}` bigint" for n in names))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
