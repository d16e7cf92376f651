"""Shared helpers: scratch tables in the cluster's shared folder, text normalisation."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Fixed value: the characters \x20 and \x09-\x0D.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a temporary folder, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="recordloom-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/recordloom-{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage ends here, so a lost
    executor costs a re-read and not a recomputation. Whoever owns the folder removes it."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that df doesn't have, whatever the case of letters."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def lower_ascii(text: Column | str) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty."""
    col = F.col(text) if isinstance(text, str) else text
    return F.translate(F.coalesce(col, F.lit("")), UPPER, UPPER.lower())


def with_join_key(df: DataFrame, name: str, *cols: str) -> DataFrame:
    """Add a hash of cols as a further join key. An aggregate by cols alone then doesn't already have the
    join's partitioning, so both sides get a plain exchange, which adaptive execution can split at a hot key."""
    return df.withColumn(name, F.xxhash64(*cols))
