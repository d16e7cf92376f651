"""Independent audit of a book against its source. It shares no code with the scanner, the digest or the renderer."""

from __future__ import annotations

import hashlib
import html
import io
import json
import re
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values, stated again on purpose.
PREAMBLE = "recordloom/record-digest/v1"
PREFIXES = {"krdict": "01-한국어기초사전", "stdict": "02-표준국어대사전", "opendict": "03-우리말샘"}
ENTRY = {"krdict": "LexicalEntry", "stdict": "item", "opendict": "item"}
TITLES = {"krdict": "한국어기초사전", "stdict": "표준국어대사전", "opendict": "우리말샘"}
NAMESPACE = uuid.UUID("34a87ea1-f0e4-4f4d-8894-1de178aa7a3e")
TOKEN = re.compile(r"<!--.*?-->|<\?.*?\?>|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<!DOCTYPE(?:[^\[>]|\[.*?\])*>|<(?P<close>/?)(?P<name>[^\s/>!?][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?P<self>/?)>|(?P<text>[^<]+)", re.S)
PAIR = re.compile(r"([^\s=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", re.S)
WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*")
CHECKS = [
    "record_sha256", "record_counts", "entries", "headword_count", "headword_sha256", "first_headword", "last_headword", "output_filename",
    "metadata_title", "metadata_identifier", "metadata_language", "metadata_source", "metadata_modified", "metadata_collection", "metadata_group_position",
]


def events(text: str) -> Iterator[tuple]:
    """("start" | "empty", name, pairs), ("end", name), ("text", value)."""
    text, at = text.replace("\r\n", "\n").replace("\r", "\n"), 0
    for m in TOKEN.finditer(text):
        if m.start() != at:
            raise ValueError(f"not well-formed at {at}")
        at = m.end()
        if m["cdata"] is not None:
            yield "text", m["cdata"]
        elif m["text"] is not None:
            yield "text", html.unescape(m["text"])
        elif m["name"] is not None:
            if m["close"]:
                yield "end", m["name"]
            else:
                pairs = [(a, html.unescape(re.sub("[\t\n]", " ", b or c or ""))) for a, b, c in PAIR.findall(m["attrs"])]
                yield ("empty" if m["self"] else "start"), m["name"], pairs
    if at != len(text):
        raise ValueError(f"not well-formed at {at}")


def source_records(data: bytes) -> Iterator[tuple]:
    stack: list[list] = []

    def text() -> Iterator[tuple]:
        if stack:
            value, stack[-1][2] = stack[-1][2], ""
            if value and not WHITE.fullmatch(value):
                yield ("tail", len(stack), None, value, []) if stack[-1][1] else ("text", len(stack) - 1, None, value, [])

    for e in events(data.decode("utf-8-sig")):
        if e[0] == "text":
            if stack:
                stack[-1][2] += e[1]
        elif e[0] == "end":
            yield from text()
            if not stack or stack.pop()[0] != e[1]:
                raise ValueError(f"unexpected end of {e[1]}")
            yield "end", len(stack), e[1], None, []
        else:
            yield from text()
            if stack:
                stack[-1][1] += 1
            yield e[0], len(stack), e[1], None, e[2]
            if e[0] == "start":
                stack.append([e[1], 0, ""])
    if stack:
        raise ValueError("unexpected end of file")


def book_records(data: bytes) -> tuple[list[tuple], list[str], dict]:
    """Records, headings and metadata of a book, in reading order."""
    z = zipfile.ZipFile(io.BytesIO(data))
    opf = z.read("EPUB/package.opf").decode()
    href = {}
    spine, meta, tag, prop = [], {}, None, None
    for e in events(opf):
        if e[0] in ("start", "empty"):
            tag, pairs = e[1], dict(e[2])
            prop = pairs.get("property")
            if tag == "item" and pairs["media-type"] == "application/xhtml+xml":
                href[pairs["id"]] = pairs["href"]
            elif tag == "itemref":
                if pairs["idref"] not in href:
                    raise ValueError(f"the spine names {pairs['idref']}, which the manifest lacks")
                spine.append(href[pairs["idref"]])
        elif e[0] == "text" and tag and e[1].strip():
            meta[prop or tag] = e[1]
        else:
            tag = None
    if not spine:
        raise ValueError("the spine is empty")
    records, heads = [], []
    for name in spine:
        if name.startswith("/") or ".." in name.split("/"):
            raise ValueError(f"unsafe member {name}")
        now, classes, heading = None, [], None
        for e in events(z.read(f"EPUB/{name}").decode()):
            if e[0] == "start":
                pairs = dict(e[2])
                css = pairs.get("class", "").split()
                if pairs.get("data-kdep-record") == "true":
                    now = [pairs["data-kdep-kind"], int(pairs["data-kdep-depth"]), None, None, []]
                    classes = []
                if e[1] == "h2" and "entry-heading" in css:
                    heading = ""
                classes.append((e[1], css))
                if "xml-control" in css:
                    value = chr(int(pairs["data-codepoint"][2:], 16))
                    if ord(value) >= 32 or value in "\t\n\r":
                        raise ValueError("invalid control marker")
                    heading = heading + value if heading is not None else None
                    if now:
                        _append(now, [c for _, cs in classes[:-1] for c in cs], value)
                if now and "xml-attribute-value" in css and now[4]:
                    now[4][-1] = (now[4][-1][0], now[4][-1][1] or "")
                if now and {"xml-text-value", "xml-tail-value"} & set(css):
                    now[3] = ""
            elif e[0] == "text" and classes:
                css = [c for _, cs in classes for c in cs]
                if "xml-control" in css:
                    continue
                if heading is not None:
                    heading += e[1]
                if now:
                    _append(now, css, e[1])
            elif e[0] == "end":
                top = classes.pop() if classes else (None, [])
                if e[1] == "h2" and heading is not None:
                    heads.append(heading)
                    heading = None
                if now and "xml-record" in top[1]:
                    records.append(tuple(now))
                    now = None
    return records, heads, meta


def _append(now: list, css: list[str], value: str) -> None:
    if "xml-attribute-value" in css:
        now[4][-1] = (now[4][-1][0], now[4][-1][1] + value)
    elif "xml-attribute-name" in css:
        now[4].append((value, ""))
    elif "xml-text-value" in css or "xml-tail-value" in css:
        now[3] += value
    elif "xml-name" in css:
        now[2] = (now[2] or "") + value


def summary(records: list[tuple], heads: list[str], preamble: str = PREAMBLE) -> dict:
    sha = hashlib.sha256(preamble.encode() + b"\0")
    counts = dict.fromkeys(("elements", "empty_elements", "end_elements", "attributes", "element_texts", "tail_texts", "control_characters"), 0)
    for kind, depth, name, text, pairs in records:
        word = (name if name is not None else text or "").encode()
        sha.update(bytes([("start", "empty", "text", "tail", "end").index(kind) + 1]) + depth.to_bytes(8, "big") + len(word).to_bytes(8, "big") + word)
        if kind in ("start", "empty"):
            sha.update(len(pairs).to_bytes(8, "big"))
            for part in (x for p in pairs for x in p):
                sha.update(len(part.encode()).to_bytes(8, "big") + part.encode())
            counts["elements"] += 1
            counts["empty_elements"] += kind == "empty"
            counts["attributes"] += len(pairs)
        counts["end_elements"] += kind == "end"
        counts["element_texts"] += kind == "text"
        counts["tail_texts"] += kind == "tail"
        counts["control_characters"] += sum(ord(c) < 32 and c not in "\t\n\r" for x in (name or "", text or "", *(x for p in pairs for x in p)) for c in x)
    lines = "".join(h.strip() + "\n" for h in heads)
    return {"record_sha256": sha.hexdigest(), "record_counts": counts, "headword_count": len(heads), "headword_sha256": hashlib.sha256(lines.encode()).hexdigest(), "first_headword": next((h.strip() for h in heads if h.strip()), ""), "last_headword": heads[-1].strip() if heads else ""}


def source_heads(dictionary: str, records: list[tuple]) -> list[str]:
    heads, stack, now, count = [], [], None, 0
    for kind, depth, name, text, pairs in records:
        local = (name or "").rpartition(":")[2]
        if kind in ("start", "empty") and local == ENTRY[dictionary] and now is None:
            now, count, value = depth, count + 1, None
        if now is not None and value is None:
            if dictionary == "krdict" and local == "feat" and kind in ("start", "empty"):
                got = {}
                for a, b in pairs:
                    got.setdefault(a.rpartition(":")[2], b)
                value = got.get("val", "").strip() or None if got.get("att") == "writtenForm" else None
            elif dictionary != "krdict" and kind == "text" and stack[-2:] == ["word_info" if dictionary == "stdict" else "wordInfo", "word"]:
                value = text.strip() or None
        if now is not None and now == depth and (kind == "end" or kind == "empty" and local == ENTRY[dictionary]):
            heads.append(value or f"항목 {count}")
            now = None
        if kind == "start":
            stack.append(local)
        elif kind == "end":
            stack.pop()
    return heads


def compare(dictionary: str, path: str, number: int, total: int, filename: str, source: bytes, book: bytes, preamble: str = PREAMBLE) -> list[dict]:
    """The fifteen checks: name, passed, expected and actual as JSON."""
    wanted = list(source_records(source))
    want = summary(wanted, source_heads(dictionary, wanted), preamble)
    records, heads, meta = book_records(book)
    got = summary(records, heads, preamble)
    rows = [(k, want[k], got[k]) for k in CHECKS if k in want]
    rows.append(("entries", want["headword_count"], len(heads)))
    rows.append(("output_filename", f"{PREFIXES[dictionary]}-{number:03d}-of-{total:03d}.epub", filename))
    rows += [
        ("metadata_title", f"{TITLES[dictionary]} {number:03d}/{total:03d}", meta.get("dc:title")),
        ("metadata_identifier", f"urn:uuid:{uuid.uuid5(NAMESPACE, f'{dictionary}/{path}')}", meta.get("dc:identifier")),
        ("metadata_language", "ko", meta.get("dc:language")),
        ("metadata_source", path, meta.get("dc:source")),
        ("metadata_modified", "1980-01-01T00:00:00Z", meta.get("dcterms:modified")),
        ("metadata_collection", TITLES[dictionary], meta.get("belongs-to-collection")),
        ("metadata_group_position", str(number), meta.get("group-position")),
    ]
    rows.sort(key=lambda r: CHECKS.index(r[0]))
    return [{"name": n, "passed": a == b, "expected": json.dumps(a, ensure_ascii=False), "actual": json.dumps(b, ensure_ascii=False)} for n, a, b in rows]


def audit_books(books: DataFrame, preamble: str = PREAMBLE) -> DataFrame:
    """books: as of build_books(). relative_path, check, passed, expected, actual; one task reads one book and its source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows = compare(r["dictionary"], r["relative_path"], r["volume_number"], r["volume_total"], r["output_filename"], r["content"], r["epub"], preamble)
                cols = [[r["relative_path"]] * len(rows), *[[x[k] for x in rows] for k in ("name", "passed", "expected", "actual")]]
                kinds = [pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["relative_path", "check", "passed", "expected", "actual"])

    return books.mapInArrow(run, "relative_path string, check string, passed boolean, expected string, actual string")
