"""Key profiles: missing, malformed, duplicate and colliding keys at corpus, file and entry scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordloom.functions.columns import key_or_null, numeric_key


def key_profile(rows: DataFrame) -> DataFrame:
    """rows: namespace, key. Two-level aggregation: per key first, then per namespace."""
    k = key_or_null("key")
    per = rows.groupBy("namespace", k.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    has, dup = F.col("k").isNotNull(), F.col("k").isNotNull() & (F.col("n") > 1)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    out = per.groupBy("namespace").agg(
        F.sum("n").cast("bigint").alias("present"),
        zero(F.sum(F.when(~has, F.col("n")))).alias("missing"),
        zero(F.sum(F.when(has & ~F.col("k").rlike("^[0-9]+$"), F.col("n")))).alias("malformed"),
        F.count_if(has).cast("bigint").alias("distinct_keys"),
        F.count_if(dup).cast("bigint").alias("duplicate_values"),
        zero(F.sum(F.when(dup, F.col("n") - 1))).alias("duplicate_occurrences"),
        F.greatest(zero(F.max(F.when(dup, F.col("n")))), F.lit(1).cast("bigint")).alias("max_occurrences"),
    )
    return out.withColumn("globally_unique", (F.col("missing") == 0) & (F.col("duplicate_values") == 0))


def scope_profile(rows: DataFrame, scopes: DataFrame) -> DataFrame:
    """rows: namespace, scope, key; scopes: namespace, scopes (all there are, with or without rows)."""
    per = rows.where(key_or_null("key").isNotNull()).groupBy("namespace", "scope", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    each = per.groupBy("namespace", "scope").agg(F.count(F.lit(1)).alias("v"), F.sum(F.col("n") - 1).alias("o"), F.max("n").alias("m"))
    total = each.groupBy("namespace").agg(F.count(F.lit(1)).alias("scopes_with_duplicates"), F.sum("v").alias("duplicate_values"), F.sum("o").alias("duplicate_occurrences"), F.max("m").alias("max_occurrences"))
    names = ["scopes_with_duplicates", "duplicate_values", "duplicate_occurrences", "max_occurrences"]
    return scopes.join(total, "namespace", "left").select("namespace", F.col("scopes").cast("bigint").alias("scopes"), *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in names])


def duplicate_samples(rows: DataFrame, sample: int = 5) -> DataFrame:
    """rows: key, at (scan order), locator. key, occurrences, the first locators in scan order."""
    # the rank filter is pushed into the sort, so a hot key keeps only its sample
    first = rows.withColumn("r", F.row_number().over(W.partitionBy("key").orderBy("at"))).where(F.col("r") <= sample)
    picked = first.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "locator"))), lambda x: x["locator"]), " ").alias("locators"))
    counted = rows.groupBy("key").agg(F.count(F.lit(1)).alias("occurrences")).where("occurrences > 1")
    return counted.join(picked, "key").select("key", "occurrences", "locators")


def numeric_collisions(rows: DataFrame, namespaces: list[str], sample: int = 10) -> DataFrame:
    """rows: namespace, key. For each unordered pair of namespaces: how many numeric keys they share, and the smallest.

    Namespaces are few and fixed, so a number carries the array of those that have it; no pair join is needed."""
    spark = rows.sparkSession
    rank = {n: k for k, n in enumerate(namespaces)}
    per = rows.select(numeric_key("key").alias("n"), "namespace").where("n IS NOT NULL").groupBy("n").agg(F.array_sort(F.collect_set(F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])[F.col("namespace")])).alias("ns"))
    pairs = F.flatten(F.transform("ns", lambda a: F.transform(F.filter("ns", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    each = per.where(F.size("ns") > 1).select("n", F.explode(pairs).alias("p")).select("n", "p.a", "p.b")
    counts = each.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    least = each.withColumn("r", F.row_number().over(W.partitionBy("a", "b").orderBy("n"))).where(F.col("r") <= sample).groupBy("a", "b").agg(F.array_join(F.transform(F.array_sort(F.collect_list("n")), lambda x: x.cast("string")), " ").alias("samples"))
    every = spark.createDataFrame([(i, j, namespaces[i], namespaces[j]) for i in range(len(namespaces)) for j in range(i + 1, len(namespaces))], "a int, b int, left_namespace string, right_namespace string")
    out = F.broadcast(every).join(counts.join(least, ["a", "b"]), ["a", "b"], "left")
    return out.select("left_namespace", "right_namespace", F.coalesce("shared", F.lit(0)).cast("bigint").alias("shared"), F.coalesce("samples", F.lit("")).alias("samples"))
