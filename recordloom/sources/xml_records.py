"""XML bytes to the ordered record stream: the one place where Python reads sources.

One row a record: relative_path, record_ordinal (from 0), kind, depth, qname, text_value, attributes (in order),
parent_ordinal, ancestors (ordinal and local name of each open element, outermost first; an end
record's own element is still open). A file is one task's
unit; a malformed file raises in strict mode and is one row of kind "error" otherwise.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from recordloom.functions.columns import CONTROLS

RECORD = T.StructType(
    [
        T.StructField("relative_path", T.StringType()),
        T.StructField("record_ordinal", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("qname", T.StringType()),
        T.StructField("text_value", T.StringType()),
        T.StructField("attributes", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))),
        T.StructField("parent_ordinal", T.LongType()),
        T.StructField("ancestors", T.ArrayType(T.StructType([T.StructField("ordinal", T.LongType()), T.StructField("name", T.StringType())]))),
    ]
)
_ATTRIBUTE = pa.struct([("name", pa.string()), ("value", pa.string())])
_ANCESTOR = pa.struct([("ordinal", pa.int64()), ("name", pa.string())])
_TYPES = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(_ATTRIBUTE), pa.int64(), pa.list_(_ANCESTOR)]
#: The escape U+E000 and the base U+E010 of escaped controls; Unicode white space.
_MARK, _BASE = "\uE000", 0xE010
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*")
_ESCAPED = re.compile(_MARK + "(.?)", re.S)


#: Bytes that the parser gets at a time.
CHUNK = 1 << 16


class SourceError(ValueError):
    pass


def sanitize_bytes(data: bytes) -> bytes:
    data = data.replace(_MARK.encode(), (_MARK * 2).encode())
    for c in CONTROLS:
        if bytes([c]) in data:
            data = data.replace(bytes([c]), (_MARK + chr(_BASE + c)).encode())
    return data


def restore(text: str) -> str:
    if _MARK not in text:
        return text

    def back(m: re.Match) -> str:
        if m[1] == _MARK:
            return _MARK
        if m[1] and ord(m[1]) - _BASE in CONTROLS:
            return chr(ord(m[1]) - _BASE)
        raise SourceError("invalid control escape")

    return _ESCAPED.sub(back, text)


def parse(data: bytes) -> Iterator[tuple]:
    """(kind, depth, qname, text, attributes, parent, ancestors) of each record in order, as the bytes are read: beside
    the file, no more than the records of CHUNK bytes are held."""
    clean = sanitize_bytes(data)
    out: list[tuple] = []  # the records from ordinal base on
    base = 0
    frames: list[dict] = []  # of open elements: ordinal, name, attributes, children, text, seen (anything since the start)
    p = expat.ParserCreate()
    p.ordered_attributes = True
    p.buffer_text = True

    def above(frames_: list[dict]) -> tuple[int | None, list[dict]]:
        return (frames_[-1]["ordinal"] if frames_ else None), [{"ordinal": f["ordinal"], "name": f["name"].rpartition(":")[2]} for f in frames_]

    def flush() -> None:
        if not frames:
            return
        top, value = frames[-1], restore("".join(frames[-1]["text"]))
        top["text"] = []
        if value and not _SPACE.fullmatch(value):
            kind, depth = ("element_text", len(frames) - 1) if not top["children"] else ("tail_text", len(frames))
            out.append((kind, depth, None, value, [], *above(frames)))

    def start(name: str, attributes: list[str]) -> None:
        if frames:
            flush()
            frames[-1]["children"] += 1
            frames[-1]["seen"] = True
        parent, chain = above(frames)
        pairs = [{"name": restore(n), "value": restore(v)} for n, v in zip(attributes[::2], attributes[1::2], strict=True)]
        name = restore(name)
        frames.append({"ordinal": base + len(out), "name": name, "children": 0, "text": [], "seen": False})
        out.append(("start_element", len(frames) - 1, name, None, pairs, parent, chain))

    def end(_: str) -> None:
        top = frames[-1]
        at = p.CurrentByteIndex
        if not top["seen"] and clean[at - 2 : at] == b"/>":
            out[top["ordinal"] - base] = ("empty_element", *out[top["ordinal"] - base][1:])
            frames.pop()
            return
        flush()
        out.append(("end_element", len(frames) - 1, top["name"], None, [], *above(frames)))
        frames.pop()

    def text(value: str) -> None:
        if frames:
            frames[-1]["text"].append(value)
            frames[-1]["seen"] = True

    def other(*_) -> None:
        if frames:
            frames[-1]["seen"] = True

    def default(value: str) -> None:
        if value.startswith("&") and value.endswith(";"):
            raise SourceError(f"unknown entity {value}")
        other()

    def declared(name: str, *_) -> None:
        raise SourceError(f"entity {name} is declared")

    p.EntityDeclHandler = declared
    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, end, text
    p.CommentHandler = p.ProcessingInstructionHandler = p.StartCdataSectionHandler = other
    p.DefaultHandler = default
    try:
        for at in range(0, max(1, len(clean)), CHUNK):
            p.Parse(clean[at : at + CHUNK], at + CHUNK >= len(clean))
            done = len(out) - 1  # the last may yet turn out to be empty
            if done > 0:
                yield from out[:done]
                del out[:done]
                base += done
    except expat.ExpatError as e:
        raise SourceError(str(e)) from e
    yield from out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], RECORD.names)


def scan(files: DataFrame, strict: bool = True, whole: bool = True) -> DataFrame:
    """Records of files (relative_path string, content binary). Where strict isn't set, a malformed file's row of kind
    "error" is its only one, or with whole unset follows the records ahead of the error (files are parsed once then)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("relative_path").to_pylist(), batch.column("content"), strict=True):
                data = content.as_buffer().to_pybytes()
                sent = 0
                try:
                    if not strict and whole:  # a malformed file has no record but its error
                        for _ in parse(data):
                            pass
                    records = ((path, n, *r) for n, r in enumerate(parse(data)))
                    while rows := list(itertools.islice(records, 8192)):
                        sent += len(rows)
                        yield _batch(rows)
                except SourceError as e:
                    if strict:
                        raise SourceError(f"{path}: {e}") from e
                    yield _batch([(path, sent, "error", 0, None, str(e), [], None, [])])

    return files.select("relative_path", "content").mapInArrow(run, RECORD)
