"""Relation resolution: candidates by key, an ordered chain of narrowing rules, a verdict with its reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.columns import key_or_null, labels_compatible, single, target_kinds, trim_u, url_host, url_query

STATUSES = ["resolved", "self_reference", "unresolved", "ambiguous"]


def resolve(relations: DataFrame, candidates: DataFrame) -> DataFrame:
    """relations: relation_id, dictionary, source_entry_id, six arrays. candidates: dictionary, entity_kind, native_key,
    canonical_id, owner_entry_id, entry_key, headword, homonym. Adds target_namespace, target_key,
    candidate_target_ids (all, before narrowing), status, reason, target_id, target_entry_id.

    A key's candidates are put together once, those that the rules can't tell apart as one with their number, so what a
    relation carries doesn't grow with the candidates of its key but by their ids, which no shuffle sees after that."""
    key_of = key_or_null(single("target_keys"))
    asked = relations.withColumn("target_key", key_of).withColumn("kinds", target_kinds("dictionary", "units"))
    key, alike = ["dictionary", "kinds", "target_key"], ["entry_key", "headword", "homonym"]
    wanted = asked.where("target_key IS NOT NULL").select(*key).distinct().withColumn("entity_kind", F.explode("kinds"))
    pool = candidates.select("dictionary", "entity_kind", F.col("native_key").alias("target_key"), "canonical_id", "owner_entry_id", *alike)
    each = wanted.join(pool, ["dictionary", "entity_kind", "target_key"]).drop("entity_kind").distinct()
    one = F.min(F.struct("canonical_id", "owner_entry_id")).alias("one")  # read only where it is the only one
    groups = each.groupBy(*key, *alike).agg(F.count(F.lit(1)).alias("n"), one, F.collect_list("canonical_id").alias("ids"))
    found = groups.groupBy(*key).agg(F.collect_list(F.struct(*alike, "n", "one")).alias("found"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    none = F.array().cast(found.schema["found"].dataType)
    # a hash as a further key gives both sides a plain exchange; relations without a key are spread, as they meet nothing
    meet = F.xxhash64("dictionary", "target_key")
    spread = asked.withColumn("meet", F.when(F.col("target_key").isNull(), F.xxhash64("relation_id")).otherwise(meet))
    rows = spread.join(found.withColumn("meet", meet), [*key, "meet"], "left").withColumn("found", F.coalesce("found", none))

    def narrow(rows: DataFrame, name: str, asked_for: Column, test, message: Column | str) -> DataFrame:
        """Keep what matches, if anything does; if nothing does though something is eligible, note the conflict."""
        match = F.filter("eligible", test)
        none_match = asked_for & (F.size("eligible") > 0) & (F.size("m") == 0)
        rows = rows.withColumn("m", F.when(asked_for, match).otherwise(F.col("eligible")))
        rows = rows.withColumn("conflicts", F.when(none_match, F.array_append("conflicts", F.lit(message) if isinstance(message, str) else message)).otherwise(F.col("conflicts")))
        return rows.withColumn("eligible", F.when(F.size("m") > 0, F.col("m")).otherwise(F.col("eligible"))).drop("m")

    d, std, open_ = F.col("dictionary"), F.col("dictionary") == "stdict", F.col("dictionary") == "opendict"
    n = {f: F.size(f) for f in ("types", "target_keys", "words", "homonyms", "units", "urls")}
    rows = rows.withColumn("target_namespace", F.when(F.size("kinds") == 1, F.concat(d, F.lit(":"), F.get("kinds", F.lit(0)))))
    tests = [
        (n["types"] != 1, "relation type is missing or repeated"),
        (n["target_keys"] > 1, "target key is repeated"),
        (std & (n["units"] != 1), "standard-dictionary target unit is missing, repeated, or unknown"),
        (n["urls"] > 1, "target URL is repeated"),
        ((n["words"] > 1) | (n["homonyms"] > 1), "target label discriminator is repeated"),
    ]
    conflicts = F.array_compact(F.array(*[F.when(t, m) for t, m in tests]))
    rows = rows.withColumn("conflicts", conflicts).withColumn("eligible", F.when(F.col("target_key").isNull(), none).otherwise(F.col("found")))
    rows = rows.withColumn("url", single("urls")).withColumn("word_no", url_query("url", "word_no")).withColumn("sense_no", url_query("url", "sense_no"))
    host = F.concat(d, F.lit(".korean.go.kr"))
    one_url = n["urls"] == 1
    more = F.array_compact(
        F.array(
            F.when(one_url & ~url_host("url").eqNullSafe(host), F.concat(F.lit("URL host does not match "), host)),
            F.when(one_url & std & F.col("word_no").isNull(), "standard-dictionary URL has no word_no"),
            F.when(one_url & open_ & F.col("sense_no").isNotNull() & (F.col("sense_no") != F.col("target_key")), "open-dictionary URL sense_no conflicts with target key"),
            F.when(one_url & open_ & F.col("sense_no").isNull(), "open-dictionary URL has no sense_no"),
        )
    )
    rows = rows.withColumn("conflicts", F.concat("conflicts", more))
    rows = rows.withColumn("word", single("words")).withColumn("number", trim_u(single("homonyms"))).withColumn("owner_key", trim_u("word_no"))
    rows = narrow(rows, "url", one_url & std & F.col("word_no").isNotNull(), lambda c: c["entry_key"] == F.col("owner_key"), "URL word_no conflicts with target candidate owner")
    rows = narrow(rows, "word", n["words"] == 1, lambda c: labels_compatible(F.col("word"), c["headword"]), "relation word conflicts with all keyed candidates")
    rows = narrow(rows, "homonym", (d == "krdict") & (n["homonyms"] == 1), lambda c: c["homonym"] == F.col("number"), "relation homonym number conflicts with all keyed candidates")
    left = F.aggregate("eligible", F.lit(0).cast("bigint"), lambda n, c: n + c["n"])
    only = F.get("eligible", F.lit(0))["one"]
    verdicts = [
        (F.size("conflicts") > 0, "ambiguous", F.array_join("conflicts", "; ")),
        (F.col("target_key").isNull(), "unresolved", F.lit("relation has no usable target key")),
        (left == 0, "unresolved", F.lit("no candidate exists in the declared dictionary and entity namespace")),
        ((left == 1) & (only["owner_entry_id"] == F.col("source_entry_id")), "self_reference", F.lit("unique target resolves to the owning source entry")),
        (left == 1, "resolved", F.lit("one candidate matches key, target kind, URL, and available label discriminators")),
    ]
    status, reason = F.lit("ambiguous"), F.lit("multiple candidates remain after applying authoritative discriminators")
    for test, s, r in reversed(verdicts):
        status, reason = F.when(test, s).otherwise(status), F.when(test, r).otherwise(reason)
    hit = status.isin("resolved", "self_reference")
    rows = rows.withColumns({"status": status, "reason": reason, "target_id": F.when(hit, only["canonical_id"]), "target_entry_id": F.when(hit, only["owner_entry_id"])})
    ids = F.coalesce("ids", F.array().cast("array<string>")).alias("candidate_target_ids")
    return rows.select(*relations.columns, "target_namespace", "target_key", ids, "status", "reason", "target_id", "target_entry_id")


def status_counts(resolved: DataFrame) -> DataFrame:
    """Per dictionary: relations and the four statuses."""
    return resolved.groupBy("dictionary").agg(F.count(F.lit(1)).alias("relations"), *[F.count_if(F.col("status") == s).cast("bigint").alias(s) for s in STATUSES])


def type_label(types: str = "types") -> Column:
    return F.when(F.size(types) == 0, "(missing)").when(F.size(types) == 1, trim_u(single(types))).otherwise(F.concat(F.lit("(multiple: "), F.array_join(types, " | "), F.lit(")")))


def type_counts(relations: DataFrame) -> DataFrame:
    return relations.groupBy("dictionary", type_label().alias("relation_type")).agg(F.count(F.lit(1)).alias("relations"))
