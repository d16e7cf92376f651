"""Batch status: one row a volume, rolled up."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.operators.audit import audit_books
from recordloom.operators.book import build_books
from recordloom.session import cut


def rollup(statuses: DataFrame) -> DataFrame:
    """statuses: corpus, status (passed, failed, unprocessed), entries. Failed before partial before passed."""
    n = lambda s: F.count_if(F.col("status") == s).cast("bigint")
    out = statuses.groupBy("corpus").agg(F.count_if(F.col("status") != "unprocessed").cast("bigint").alias("processed"), n("passed").alias("passed"), n("failed").alias("failed"), n("unprocessed").alias("unprocessed"), F.coalesce(F.sum("entries"), F.lit(0)).cast("bigint").alias("entries"))
    return out.withColumn("status", F.when(F.col("failed") > 0, "failed").when(F.col("unprocessed") > 0, "partial").otherwise("passed"))


def batch(volumes: DataFrame, corpus: str = "corpus") -> DataFrame:
    """Build and audit every volume: corpus, relative_path, status, entries, failed_checks (JSON)."""
    books = cut(build_books(volumes), "books")
    verdicts = audit_books(books).groupBy("relative_path").agg(F.to_json(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("check"))))).alias("failed_checks"))
    rows = books.select("relative_path", "entries").join(verdicts, "relative_path")
    return rows.select(F.lit(corpus).alias("corpus"), "relative_path", F.when(F.col("failed_checks") == "[]", "passed").otherwise("failed").alias("status"), "entries", "failed_checks")


def report(rolled: DataFrame) -> str:
    """Pretty JSON of the roll-up, with a line end."""
    return json.dumps([r.asDict() for r in rolled.orderBy("corpus").collect()], indent=2, ensure_ascii=False) + "\n"
