"""Counts and order-sensitive digests over records."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.columns import DIGEST_PREAMBLE, FINGERPRINT_PREAMBLE, control_count, trim_u

#: The tag byte of each kind.
TAGS = {"start_element": "01", "empty_element": "02", "element_text": "03", "tail_text": "04", "end_element": "05"}


def record_counts(records: DataFrame) -> DataFrame:
    """Per relative_path: elements, empty_elements, end_elements, attributes, element_texts, tail_texts, control_characters, records."""
    kind = F.col("kind")
    is_element = kind.isin("start_element", "empty_element")
    count = lambda c: F.count_if(c).cast("bigint")
    in_attributes = F.aggregate("attributes", F.lit(0).cast("bigint"), lambda n, a: n + control_count(a["name"]) + control_count(a["value"]))
    controls = F.coalesce(control_count("qname"), F.lit(0)) + F.coalesce(control_count("text_value"), F.lit(0)) + F.when(is_element, in_attributes).otherwise(0)
    return records.groupBy("relative_path").agg(
        count(is_element).alias("elements"),
        count(kind == "empty_element").alias("empty_elements"),
        count(kind == "end_element").alias("end_elements"),
        F.sum(F.when(is_element, F.size("attributes")).otherwise(0)).cast("bigint").alias("attributes"),
        count(kind == "element_text").alias("element_texts"),
        count(kind == "tail_text").alias("tail_texts"),
        F.sum(controls).cast("bigint").alias("control_characters"),
        F.count(F.lit(1)).alias("records"),
    )


def _hex64(n: Column) -> Column:
    return F.lpad(F.hex(n.cast("bigint")), 16, "0")


def _coded(s: Column) -> Column:
    return F.concat(_hex64(F.octet_length(s)), F.hex(F.encode(s, "UTF-8")))


def token_hex() -> Column:
    """A record's bytes in the digest, in hex."""
    tag = F.create_map(*[F.lit(x) for kv in TAGS.items() for x in kv])[F.col("kind")]
    attributes = F.concat(_hex64(F.size("attributes")), F.array_join(F.transform("attributes", lambda a: F.concat(_coded(a["name"]), _coded(a["value"]))), ""))
    more = F.when(F.col("kind").isin("start_element", "empty_element"), attributes).otherwise("")
    return F.concat(tag, _hex64(F.col("depth")), _coded(F.coalesce("qname", "text_value")), more)


def canonical_digest_collected(records: DataFrame, preamble: str = DIGEST_PREAMBLE) -> DataFrame:
    """relative_path, record_sha256 for small files: a file's token string is put together as one value."""
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("record_ordinal", token_hex().alias("t")))), lambda x: x["t"]), "")
    start = preamble.encode().hex() + "00"
    return records.groupBy("relative_path").agg(F.sha2(F.unhex(F.concat(F.lit(start), parts)), 256).alias("record_sha256"))


def canonical_digest(records: DataFrame, preamble: str = DIGEST_PREAMBLE, parts: int | None = None) -> DataFrame:
    """relative_path, record_sha256 for files of any size: sorted records run through one hash state. parts: tasks to share the files."""
    by = ["relative_path"] if parts is None else [parts, "relative_path"]
    rows = records.select("relative_path", "record_ordinal", F.unhex(token_hex()).alias("t")).repartition(*by).sortWithinPartitions("relative_path", "record_ordinal")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for path, token in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if path != now:
                    if state is not None:
                        out.append((now, state.hexdigest()))
                    now, state = path, hashlib.sha256(preamble.encode() + b"\0")
                state.update(token.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.string()) for k in (0, 1)], ["relative_path", "record_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], ["relative_path", "record_sha256"])

    return rows.mapInArrow(run, "relative_path string, record_sha256 string")


def headword_digest(headwords: DataFrame) -> DataFrame:
    """headwords: relative_path, entry_ordinal, headword. Count, digest, first (that isn't empty) and last."""
    h = trim_u("headword")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entry_ordinal", h.alias("h")))), lambda x: F.concat(x["h"], F.lit("\n"))), "")
    return headwords.groupBy("relative_path").agg(
        F.count(F.lit(1)).alias("headword_count"), F.sha2(lines, 256).alias("headword_sha256"), F.min_by(h, F.when(h != "", F.col("entry_ordinal"))).alias("first_headword"), F.max_by(h, "entry_ordinal").alias("last_headword")
    )


def schema_fingerprint(objects: DataFrame, preamble: str = FINGERPRINT_PREAMBLE) -> DataFrame:
    """objects: type, name, tbl_name, sql. One digest over the length-prefixed fields in order of type and name."""
    token = F.concat(*[_coded(F.col(c)) for c in ("type", "name", "tbl_name", "sql")])
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type", "name", token.alias("t")))), lambda x: x["t"]), "")
    return objects.agg(F.sha2(F.unhex(F.concat(F.lit(preamble.encode().hex() + "00"), parts)), 256).alias("fingerprint"))

