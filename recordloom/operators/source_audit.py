"""Audit of a corpus' identifiers and relations: the reports as DataFrames, and their JSON and Markdown forms.

Counts, statuses, namespaces, collisions and cycle groups are small (bounded by the formats' namespaces and kinds) and
go into the report; relations, entities and duplicate keys grow with the corpus and stay DataFrames to be written.
"""

from __future__ import annotations

import json
import os
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.functions.columns import DICTIONARIES
from recordloom.operators import entities, graph, profiles, relations
from recordloom.session import cut
from recordloom.sources.xml_records import scan

KINDS = ["entry", "part_of_speech", "common_pattern", "sense"]
NAMESPACES = [f"{d}:{k}" for d in DICTIONARIES for k in KINDS]
#: Cycle groups that the report shows; all of them are in the frame "cycles".
SHOWN_CYCLES = 100


def audit(files: DataFrame, commit: str) -> dict[str, DataFrame]:
    """files: relative_path, content. The frames entities, relations, entry_counts, namespaces, file_scopes, entry_scopes,
    collisions, statuses, types, cycles, evidence."""
    spark = files.sparkSession
    inner = cut(entities.with_entries(scan(files)), "audit-records")
    named = cut(entities.identified(entities.entries(inner), entities.entities(inner), commit), "audit-entities")
    found = entities.relations(inner)
    tops = named.where("entity_kind = 'entry'").select("relative_path", "entry_at", "entry_ordinal", F.col("canonical_id").alias("source_entry_id"))
    owners = named.select("relative_path", F.col("entity_at").alias("source_at"), F.col("canonical_id").alias("own_id"))
    found = found.join(tops, ["relative_path", "entry_at"]).join(owners, ["relative_path", "source_at"], "left")
    found = found.withColumn("source_entity_id", F.coalesce("own_id", "source_entry_id")).withColumn("relation_id", F.concat("relative_path", F.lit("#entry="), "entry_ordinal", F.lit("#relation="), "relation_ordinal"))
    links = found.select("relation_id", "relative_path", "entry_ordinal", "relation_ordinal", "dictionary", "source_entity_id", "source_entry_id", *entities.FIELDS)
    resolved = cut(relations.resolve(links, named), "audit-relations")
    edges = resolved.where("status = 'resolved'").select(F.col("source_entry_id").alias("a"), F.col("target_entry_id").alias("b"))
    components = cut(graph.strong_components(edges), "audit-components")
    member = components.select("node", "component")
    ends = resolved.join(member.select(F.col("node").alias("source_entry_id"), F.col("component").alias("ca")), "source_entry_id", "left").join(member.select(F.col("node").alias("target_entry_id"), F.col("component").alias("cb")), "target_entry_id", "left")
    marked = ends.withColumn("in_cycle", F.coalesce((F.col("status") == "resolved") & (F.col("ca") == F.col("cb")), F.lit(False))).select(*resolved.columns, "in_cycle")
    keys = named.select(F.concat("dictionary", F.lit(":"), "entity_kind").alias("namespace"), F.col("native_key").alias("key"), "dictionary", "relative_path", "entry_at")
    every = F.broadcast(spark.createDataFrame([(n, n.split(":")[0]) for n in NAMESPACES], "namespace string, dictionary string"))
    profile = every.select("namespace").join(profiles.key_profile(keys.select("namespace", "key")), "namespace", "left")
    numbers = [c for c in profile.columns if c not in ("namespace", "globally_unique")]
    profile = profile.select("namespace", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in numbers], F.coalesce("globally_unique", F.lit(True)).alias("globally_unique"))

    def scopes(scope, unit: DataFrame) -> DataFrame:
        total = every.join(unit.groupBy("dictionary").agg(F.count(F.lit(1)).alias("scopes")), "dictionary", "left").select("namespace", F.coalesce("scopes", F.lit(0)).alias("scopes"))
        return profiles.scope_profile(keys.select("namespace", scope.alias("scope"), "key"), total)

    of_files = files.select(F.substring_index("relative_path", "/", 1).alias("dictionary"))
    counts = every.select("dictionary").distinct().join(tops.select(F.substring_index("relative_path", "/", 1).alias("dictionary")).groupBy("dictionary").agg(F.count(F.lit(1)).alias("entries")), "dictionary", "left")
    place = F.struct("relative_path", "entry_ordinal", "relation_ordinal")
    first = marked.groupBy("status").agg(*[F.min_by(c, F.struct(entities.dictionary_rank(), place)).alias(c) for c in ("relation_id", "source_entry_id", "target_key", "reason")])
    return {
        "entities": named,
        "relations": marked,
        "entry_counts": counts.select("dictionary", F.coalesce("entries", F.lit(0)).cast("bigint").alias("entries")),
        "namespaces": profile,
        "file_scopes": scopes(F.col("relative_path"), of_files),
        "entry_scopes": scopes(F.concat_ws("#", "relative_path", "entry_at"), tops.select(F.substring_index("relative_path", "/", 1).alias("dictionary"))),
        "collisions": profiles.numeric_collisions(keys.select("namespace", "key"), NAMESPACES),
        "statuses": relations.status_counts(marked),
        "types": relations.type_counts(marked),
        "cycles": graph.cycle_groups(edges, components),
        "evidence": first,
    }


def report(frames: dict[str, DataFrame], commit: str) -> dict[str, Any]:
    """The small frames as plain values. Relation types can be many; the 1,000 most frequent are listed and the rest counted."""
    rows = lambda name, *order: [r.asDict(recursive=True) for r in frames[name].orderBy(*order).collect()]
    cycles = frames["cycles"].agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("relation_edges"), F.lit(0)).alias("relation_edges")).first().asDict()
    shown = [r.asDict() for r in frames["cycles"].orderBy("sample", "component").limit(SHOWN_CYCLES).collect()]
    types = [r.asDict() for r in frames["types"].orderBy(F.desc("relations"), "dictionary", "relation_type").limit(1000).collect()]
    rank = {d: k for k, d in enumerate(DICTIONARIES)}
    return {
        "commit": commit,
        "entry_counts": sorted(rows("entry_counts", "dictionary"), key=lambda r: rank[r["dictionary"]]),
        "namespaces": sorted(rows("namespaces", "namespace"), key=lambda r: NAMESPACES.index(r["namespace"])),
        "file_scopes": rows("file_scopes", "namespace"),
        "entry_scopes": rows("entry_scopes", "namespace"),
        "collisions": rows("collisions", "left_namespace", "right_namespace"),
        "statuses": sorted(rows("statuses", "dictionary"), key=lambda r: rank[r["dictionary"]]),
        "types": types,
        "type_count": frames["types"].count(),
        "cycles": {**cycles, "shown": shown},
        "evidence": rows("evidence", "status"),
    }


def write_whole(path: str, text: str, overwrite: bool = False) -> None:
    """Write text to a file that is there in whole or not at all."""
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(path)
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(part, path)


def to_json(value: Any) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False) + "\n"


def cell(value: Any) -> str:
    text = "" if value is None else ", ".join(map(str, value)) if isinstance(value, list) else str(value)
    return text.replace("|", "\\|").replace("\r", " ").replace("\n", " ")


def _table(rows: list[dict], columns: list[str]) -> str:
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows]) + "\n"


def to_markdown(value: dict[str, Any]) -> str:
    """The report for readers: eight sections."""
    unique = [r["namespace"] for r in value["namespaces"] if r["present"] and r["globally_unique"]]
    shared = [r for r in value["collisions"] if r["shared"]]
    keys = ["present", "missing", "malformed", "distinct_keys", "duplicate_values", "duplicate_occurrences", "max_occurrences", "globally_unique"]
    total = value["cycles"]
    parts = [
        ("Entry counts", _table(value["entry_counts"], ["dictionary", "entries"])),
        ("Identifier namespaces", _table(value["namespaces"], ["namespace", *keys])),
        ("Cross-namespace numeric collisions", _table(shared, ["left_namespace", "right_namespace", "shared", "samples"]) if shared else "None.\n"),
        ("Relation status", _table(value["statuses"], ["dictionary", "relations", *relations.STATUSES])),
        ("Relation types", _table(value["types"], ["dictionary", "relation_type", "relations"])),
        ("Cycles", f"{total['groups']} groups, {total['relation_edges']} relations.\n\n" + _table(total["shown"], ["members", "relation_edges", "sample"])),
        ("Representative evidence", _table(value["evidence"], ["status", "relation_id", "source_entry_id", "target_key", "reason"])),
        ("Canonical namespaces", f"Keys are unique by themselves in: {', '.join(unique) or 'none'}. Elsewhere an id needs its dictionary, kind, owner and, where a key repeats, its place.\n"),
    ]
    return f"# Identifiers and relations\n\nRevision {value['commit']}\n\n" + "\n".join(f"## {title}\n\n{body}" for title, body in parts)
