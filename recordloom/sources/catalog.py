"""Which files there are: layout check, manifest join, volume numbers, output names."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordloom.functions.columns import FILE_PREFIXES


class CatalogError(ValueError):
    pass


def layout_ok(path: Column | str, dictionaries: list[str]) -> Column:
    """Exactly two components, the first one of the dictionaries, the extension xml."""
    col = F.col(path) if isinstance(path, str) else path
    return col.rlike(rf"^({'|'.join(dictionaries)})/[^/]+\.xml$")


def discover(spark: SparkSession, root: str, dictionaries: list[str]) -> DataFrame:
    """relative_path of the regular files under root whose layout holds; links don't count."""
    found = []
    for name in dictionaries:
        folder = os.path.join(root, name)
        for x in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
            if x.endswith(".xml") and os.path.isfile(os.path.join(folder, x)) and not os.path.islink(os.path.join(folder, x)):
                found.append((f"{name}/{x}",))
    return spark.createDataFrame(found, "relative_path string")


def tracked(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that the manifest names."""
    return files.join(manifest.select("relative_path"), "relative_path", "left_semi")


def volumes(files: DataFrame, prefix: Column | None = None) -> DataFrame:
    """files (dictionary, relative_path) with volume_number, volume_total and output_filename."""
    each = W.partitionBy("dictionary")
    out = files.withColumn("volume_number", F.row_number().over(each.orderBy("relative_path")).cast("bigint")).withColumn("volume_total", F.count(F.lit(1)).over(each))
    series = F.create_map(*[F.lit(x) for pair in FILE_PREFIXES.items() for x in pair])[F.col("dictionary")]
    name = F.concat(F.coalesce(series, "dictionary") if prefix is None else prefix, F.lit("-"), F.format_string("%03d", "volume_number"), F.lit("-of-"), F.format_string("%03d", "volume_total"), F.lit(".epub"))
    return out.withColumn("output_filename", name)


def _git(root: str, *words: str) -> subprocess.CompletedProcess:
    return subprocess.run(["git", "-c", f"safe.directory={os.path.realpath(root)}", "-C", root, *words], capture_output=True, check=False)


def git_tracked(spark: SparkSession, root: str, dictionaries: list[str]) -> DataFrame:
    """relative_path of the XML files under root that git tracks, as a manifest for tracked(). A dictionary without any is an error."""
    found = []
    for name in dictionaries:
        listed = _git(root, "ls-files", "-z", "--", f"{name}/*.xml")
        if listed.returncode:
            raise CatalogError(f"{root}: {listed.stderr.decode(errors='replace').strip()}")
        paths = [p for p in listed.stdout.decode().split("\0") if p]
        if not paths:
            raise CatalogError(f"{root}: no tracked XML file of {name}")
        found += [(p,) for p in paths]
    return spark.createDataFrame(found, "relative_path string")


def git_revision(root: str) -> str:
    got = _git(root, "rev-parse", "HEAD")
    if got.returncode:
        raise CatalogError(f"{root} has no revision")
    return got.stdout.decode().strip()


def require_clean(root: str, dictionaries: list[str]) -> None:
    """Neither the working tree nor the index may differ from the revision in the dictionaries' XML files."""
    globs = [f"{name}/*.xml" for name in dictionaries]
    for staged in ([], ["--cached"]):
        if _git(root, "diff", "--quiet", *staged, "--", *globs).returncode:
            raise CatalogError(f"{root}: the XML files differ from the revision")


def select(spark: SparkSession, root: str, dictionaries: list[str]) -> DataFrame:
    """The catalogue of root: dictionary, relative_path, volume_number, volume_total, output_filename of its tracked regular files."""
    manifest = git_tracked(spark, root, dictionaries).where(layout_ok("relative_path", dictionaries))
    missing = manifest.join(discover(spark, root, dictionaries), "relative_path", "left_anti").first()
    if missing:
        raise CatalogError(f"{missing.relative_path} is tracked but is no regular file")
    return volumes(manifest.select(F.substring_index("relative_path", "/", 1).alias("dictionary"), "relative_path"))


def with_content(spark: SparkSession, root: str, files: DataFrame, paths: list[str]) -> DataFrame:
    """files joined with the bytes of paths (below root)."""
    read = spark.read.format("binaryFile").load([os.path.join(root, p) for p in paths])
    return files.join(read.select(F.concat_ws("/", F.slice(F.split("path", "/"), -2, 2)).alias("relative_path"), "content"), "relative_path")
