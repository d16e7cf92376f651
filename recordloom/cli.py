"""Command line: preflight, inspect, build, audit, batch, source-audit. Usage errors exit with 2, others with 3 and a code."""

from __future__ import annotations

import argparse
import json
import os
import subprocess
import sys
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions.columns import DICTIONARIES
from recordloom.operators import book, digest, entities, source_audit
from recordloom.operators.audit import audit_books
from recordloom.session import session
from recordloom.sources import catalog
from recordloom.sources.xml_records import scan

#: Error codes.
CODES = {
    "invalid source": "KDEP-E001", "missing dictionary": "KDEP-E002", "invalid output": "KDEP-E003", "unsafe output": "KDEP-E004", "catalog": "KDEP-E005", "invalid volume": "KDEP-E006",
    "source": "KDEP-E007", "output exists": "KDEP-E008", "build": "KDEP-E009", "audit": "KDEP-E010", "audit mismatch": "KDEP-E011", "batch": "KDEP-E012", "volume failures": "KDEP-E013",
}


class AppError(Exception):
    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.code = CODES[kind]


def names_of(choice: str) -> list[str]:
    return list(DICTIONARIES) if choice == "all" else [choice]


def check_paths(source: str, output: str | None, dictionaries: list[str]) -> tuple[str, str | None]:
    """Real paths. The source must be a folder with the dictionaries' folders; neither path may hold the other."""
    if not os.path.isdir(source):
        raise AppError("invalid source", f"{source} is no folder")
    source = os.path.realpath(source)
    for d in dictionaries:
        if not os.path.isdir(os.path.join(source, d)):
            raise AppError("missing dictionary", f"{source} has no folder {d}")
    if output is None:
        return source, None
    output = os.path.realpath(output)
    if os.path.exists(output) and not os.path.isdir(output):
        raise AppError("invalid output", f"{output} is no folder")
    if os.path.commonpath([source, output]) in (source, output):
        raise AppError("unsafe output", f"{source} and {output} hold each other")
    return source, output


def render(pairs: dict[str, Any]) -> str:
    plain = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
    return "\n".join(f"{k}={plain(v)}" for k, v in pairs.items())


def volumes_of(spark: SparkSession, source: str, dictionaries: list[str]) -> DataFrame:
    try:
        return catalog.select(spark, source, dictionaries)
    except catalog.CatalogError as e:
        raise AppError("catalog", str(e)) from e


def pick(spark: SparkSession, source: str, dictionary: str, number: int) -> DataFrame:
    """The volume's row with its content."""
    every = volumes_of(spark, source, [dictionary])
    row = every.where(F.col("volume_number") == number).first()
    if row is None:
        raise AppError("invalid volume", f"{dictionary} has {every.count()} volumes and no volume {number}")
    return catalog.with_content(spark, source, every.where(F.col("volume_number") == number), [row.relative_path])


def guarded(kind: str, run):
    try:
        return run()
    except (PySparkException, OSError, ValueError) as e:
        raise AppError(kind, str(e).strip().splitlines()[-1] if str(e).strip() else type(e).__name__) from e


def inspect(spark: SparkSession, source: str, dictionary: str, number: int) -> dict[str, Any]:
    volume = pick(spark, source, dictionary, number)

    def run():
        records = scan(volume)
        is_entry = entities.local_name("qname") == book.ENTRY_ELEMENTS[dictionary]
        n = records.agg(F.count_if(is_entry & F.col("kind").isin("start_element", "empty_element")).alias("n")).first().n
        return n, digest.record_counts(records).join(digest.canonical_digest(records), "relative_path").first()

    n, row = guarded("source", run)
    total = volume.first()
    names = ["record_sha256", "elements", "empty_elements", "end_elements", "attributes", "element_texts", "tail_texts", "control_characters"]
    return {"status": "inspected", "dictionary": dictionary, "volume": number, "volumes": total.volume_total, "source": row.relative_path, "entries": n, **{k: row[k] for k in names}}


def build(spark: SparkSession, source: str, output: str, dictionary: str, number: int, entries: int, size: int, overwrite: bool) -> dict[str, Any]:
    volume = pick(spark, source, dictionary, number)
    target = os.path.join(output, volume.select("output_filename").first()[0])
    if os.path.exists(target) and not overwrite:
        raise AppError("output exists", f"{target} exists")
    row = guarded("build", lambda: book.build_books(volume, entries, size).first())
    os.makedirs(output, exist_ok=True)
    with open(f"{target}.part", "wb") as f:
        f.write(row.epub)
    os.replace(f"{target}.part", target)
    return {"status": "built", "dictionary": dictionary, "volume": number, "source": row.relative_path, "output": target, "entries": row.entries, "chapters": row.chapters}


def audit(spark: SparkSession, source: str, output: str, dictionary: str, number: int) -> dict[str, Any]:
    """Compare the book with its source; the report is written beside the book even where they differ."""
    volume = pick(spark, source, dictionary, number)
    row = volume.select("output_filename", "relative_path").first()
    target = os.path.join(output, row.output_filename)
    if not os.path.isfile(target):
        raise AppError("audit", f"{target} is missing")
    there = spark.read.format("binaryFile").load(target).select(F.lit(row.relative_path).alias("relative_path"), F.col("content").alias("epub"))
    checks = [r.asDict() for r in guarded("audit", lambda: audit_books(volume.join(there, "relative_path")).collect())]
    failed = [c["check"] for c in checks if not c["passed"]]
    text = source_audit.to_json({"status": "failed" if failed else "passed", "checks": checks})
    source_audit.write_whole(f"{target}.audit.json", text, overwrite=True)
    if failed:
        raise AppError("audit mismatch", f"{target} differs from its source: {', '.join(failed)}")
    return {"status": "passed", "dictionary": dictionary, "volume": number, "output": target, "checks": len(checks), "report": f"{target}.audit.json"}


def batch(spark: SparkSession, source: str, output: str, dictionaries: list[str], jobs: int, entries: int, size: int, overwrite: bool, resume: bool, keep_going: bool, checker: list[str] | None = None) -> dict[str, Any]:
    """Build, audit and, with a checker (the words before the book's path), check every volume; a job a volume, jobs at a
    time. After a failure no more volumes start unless keep_going. With resume, a book that is there is only audited."""
    volumes = volumes_of(spark, source, dictionaries).collect()
    rank = {d: k for k, d in enumerate(dictionaries)}
    volumes.sort(key=lambda v: (rank[v.dictionary], v.volume_number))
    there = [v.output_filename for v in volumes if os.path.exists(os.path.join(output, v.output_filename))]
    if there and not overwrite and not resume:
        raise AppError("output exists", f"{len(there)} books exist, as {', '.join(there[:5])}")
    stopped = False

    def one(v) -> dict[str, Any]:
        nonlocal stopped
        row = {"dictionary": v.dictionary, "volume": v.volume_number, "source": v.relative_path, "output": v.output_filename, "status": "unprocessed", "entries": None, "code": None, "error": None}
        if stopped and not keep_going:
            return row
        try:
            if not (resume and v.output_filename in there):
                row["entries"] = build(spark, source, output, v.dictionary, v.volume_number, entries, size, overwrite)["entries"]
            audit(spark, source, output, v.dictionary, v.volume_number)
            if checker and subprocess.run([*checker, os.path.join(output, v.output_filename)], capture_output=True, check=False).returncode:
                raise AppError("volume failures", "the checker refuses the book")
            row["status"] = "passed"
        except AppError as e:
            stopped = True
            row |= {"status": "failed", "code": e.code, "error": str(e)}
        return row

    with ThreadPoolExecutor(jobs) as pool:
        rows = list(pool.map(one, volumes))
    count = lambda s: sum(r["status"] == s for r in rows)
    status = "failed" if count("failed") else "partial" if count("unprocessed") else "passed"
    totals = {"status": status, "volumes": len(rows), "passed": count("passed"), "failed": count("failed"), "unprocessed": count("unprocessed"), "entries": sum(r["entries"] or 0 for r in rows)}
    path = os.path.join(output, "batch-report.json")
    source_audit.write_whole(path, source_audit.to_json({**totals, "books": rows}), overwrite=True)
    if status != "passed":
        raise AppError("volume failures", f"{totals['failed']} volumes failed, {totals['unprocessed']} weren't processed; see {path}")
    return {**totals, "report": path}


def audit_source(spark: SparkSession, source: str, output: str, dictionaries: list[str], overwrite: bool) -> dict[str, Any]:
    """Identifiers and relations of the clean, tracked corpus: report.json, report.md, and as JSON lines, in full, what the
    report shows the first of or none: relations, entities, cycle groups, relation types."""
    parts = ["relations", "entities", "cycles", "types"]
    names = [os.path.join(output, x) for x in ("report.json", "report.md", *parts)]
    if not overwrite and any(map(os.path.exists, names)):
        raise AppError("output exists", f"{output} holds a report")
    guarded("catalog", lambda: catalog.require_clean(source, dictionaries))
    commit = guarded("catalog", lambda: catalog.git_revision(source))
    volumes = volumes_of(spark, source, dictionaries)
    files = catalog.with_content(spark, source, volumes, [r.relative_path for r in volumes.select("relative_path").collect()])
    frames = guarded("source", lambda: source_audit.audit(files, commit))
    value = source_audit.report(frames, commit)
    source_audit.write_whole(names[0], source_audit.to_json(value), overwrite)
    source_audit.write_whole(names[1], source_audit.to_markdown(value), overwrite)
    for part, path in zip(parts, names[2:], strict=True):
        frames[part].write.mode("overwrite" if overwrite else "errorifexists").json(f"file://{path}")
    return {"status": "audited", "commit": commit, "entries": sum(r["entries"] for r in value["entry_counts"]), "relations": sum(r["relations"] for r in value["statuses"]), "cycles": value["cycles"]["groups"], "report": names[0]}


def positive(text: str) -> int:
    n = int(text)
    if n < 1:
        raise argparse.ArgumentTypeError("must be 1 or more")
    return n


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="recordloom")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("preflight", "inspect", "build", "audit", "batch", "source-audit"):
        p = commands.add_parser(name)
        many = name in ("preflight", "batch", "source-audit")
        p.add_argument("--source", required=True)
        if name != "inspect":
            p.add_argument("--output", required=True)
        p.add_argument("--dictionary", choices=[*DICTIONARIES, *(["all"] if many else [])], **({"default": "all"} if many else {"required": True}))
        if not many:
            p.add_argument("--volume", type=positive, default=1)
        if name in ("build", "batch"):
            p.add_argument("--entries-per-chapter", type=positive, default=book.ENTRIES)
            p.add_argument("--chapter-bytes", type=positive, default=book.BYTES)
        if name in ("preflight", "batch"):
            p.add_argument("--jobs", type=positive, default=1)
            p.add_argument("--keep-going", action="store_true")
        if name in ("preflight", "build", "source-audit"):
            p.add_argument("--overwrite", action="store_true")
        if name == "batch":
            either = p.add_mutually_exclusive_group()
            either.add_argument("--overwrite", action="store_true")
            either.add_argument("--resume", action="store_true")
            p.add_argument("--checker", nargs="+", help="command that refuses a bad book, given its path")
    return top


def run(a: argparse.Namespace, spark: SparkSession | None = None) -> dict[str, Any]:
    names = names_of(a.dictionary)
    source, output = check_paths(a.source, getattr(a, "output", None), names)
    if a.command == "preflight":
        return {"status": "ready", "source": source, "output": output, "dictionary": a.dictionary, "jobs": a.jobs, "overwrite": a.overwrite, "keep_going": a.keep_going}
    spark = spark or session("recordloom-cli")
    if a.command == "inspect":
        return inspect(spark, source, a.dictionary, a.volume)
    if a.command == "build":
        return build(spark, source, output, a.dictionary, a.volume, a.entries_per_chapter, a.chapter_bytes, a.overwrite)
    if a.command == "audit":
        return audit(spark, source, output, a.dictionary, a.volume)
    if a.command == "batch":
        return batch(spark, source, output, names, a.jobs, a.entries_per_chapter, a.chapter_bytes, a.overwrite, a.resume, a.keep_going, a.checker)
    return audit_source(spark, source, output, names, a.overwrite)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        print(render(run(parser().parse_args(argv), spark)))
    except AppError as e:
        print(f"error[{e.code}]: {json.dumps(str(e), ensure_ascii=False)}", file=sys.stderr)
        return 3
    return 0


if __name__ == "__main__":
    sys.exit(main())
