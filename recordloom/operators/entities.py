"""Entries, nested entities and relations out of the record stream. Paths are array expressions over ancestors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordloom.functions.columns import DICTIONARIES, ENTRY_ELEMENTS, canonical_id, key_or_null, local_name, locator

#: Element names by dictionary.
KINDS = {("krdict", "Sense"): "sense", ("stdict", "pos_info"): "part_of_speech", ("stdict", "comm_pattern_info"): "common_pattern", ("stdict", "sense_info"): "sense", ("opendict", "senseInfo"): "sense"}
KEY_ELEMENTS = {("stdict", "part_of_speech"): "pos_code", ("stdict", "common_pattern"): "comm_pattern_code", ("stdict", "sense"): "sense_code", ("opendict", "sense"): "sense_no"}
CONTAINERS = {"krdict": "SenseRelation", "stdict": "lexical_info", "opendict": "relation_info"}
FEAT_FIELDS = {"type": "types", "id": "target_keys", "lemma": "words", "homonymNumber": "homonyms"}
TEXT_FIELDS = {"type": "types", "link_target_code": "target_keys", "word": "words", "unit": "units", "link": "urls"}
FIELDS = ["types", "target_keys", "words", "homonyms", "units", "urls"]


def attribute(name: str, attributes: str = "attributes") -> Column:
    """Value of the first attribute with this local name."""
    return F.get(F.filter(attributes, lambda a: local_name(a["name"]) == name), F.lit(0))["value"]


def _by(table: dict, *cols: Column) -> Column:
    out = F.lit(None).cast("string")
    for key, value in table.items():
        key = key if isinstance(key, tuple) else (key,)
        test = F.lit(True)
        for c, k in zip(cols, key, strict=True):
            test = test & (c == k)
        out = F.when(test, value).otherwise(out)
    return out


def _one_of(names: list[str]):
    return lambda a: a["name"].isin(*names)


def with_entries(records: DataFrame) -> DataFrame:
    """records in an entry, with dictionary, local, entry_at (record ordinal of its start) and path (names from the entry on, the record's own excluded).

    An entry starts at a start element of its name with none open; an empty element starts none."""
    dictionary = F.substring_index("relative_path", "/", 1)
    marked = records.withColumn("dictionary", dictionary).withColumn("local", local_name("qname")).withColumn("entry_element", _by(ENTRY_ELEMENTS, F.col("dictionary")))
    first = F.array_position(F.transform("ancestors", lambda a: a["name"]), F.col("entry_element"))
    own = (F.col("kind") == "start_element") & (F.col("local") == F.col("entry_element")) & (first == 0)
    inside = F.slice("ancestors", first.cast("int"), F.size("ancestors"))
    out = marked.withColumn("inside", F.when(first > 0, inside)).withColumn("entry_at", F.when(first > 0, F.get("inside", F.lit(0))["ordinal"]).when(own, F.col("record_ordinal")))
    return out.where("entry_at IS NOT NULL").withColumn("path", F.transform(F.coalesce("inside", F.array().cast("array<struct<ordinal:bigint,name:string>>")), lambda a: a["name"]))


def entries(inner: DataFrame) -> DataFrame:
    """relative_path, entry_at, entry_ordinal (from 1), dictionary, native_key, headword, homonym. inner: as of with_entries()."""
    krdict = F.col("dictionary") == "krdict"
    own = F.col("record_ordinal") == F.col("entry_at")
    text = F.col("kind") == "element_text"
    feat = (F.col("kind") == "empty_element") & (F.col("local") == "feat")
    depth, leaf = F.size("path"), F.try_element_at("path", F.lit(-1))
    own_key = F.when(own, F.when(krdict, F.coalesce(F.when(attribute("att") == "id", attribute("val")), attribute("id"))).otherwise(attribute("target_code")))
    text_key = F.when(~krdict & text & (leaf == "target_code") & (depth == 2), F.col("text_value"))
    written = krdict & feat & (attribute("att") == "writtenForm") & F.array_contains("path", "Lemma")
    word = ~krdict & text & (leaf == "word") & (F.array_contains("path", "word_info") | F.array_contains("path", "wordInfo"))
    related = F.exists("path", lambda p: p.isin(*CONTAINERS.values()))
    head = F.when(written, attribute("val")).when(word & ~related, F.col("text_value"))
    number = F.when(krdict & feat & (attribute("att") == "homonym_number") & (depth == 1), attribute("val")).when((F.col("dictionary") == "opendict") & text & (leaf == "group_order") & (depth == 2), F.col("text_value"))
    at = lambda value: F.min_by(value, F.when(value.isNotNull(), F.col("record_ordinal")))
    found = inner.groupBy("relative_path", "dictionary", "entry_at").agg(F.coalesce(at(own_key), at(text_key)).alias("k"), at(head).alias("h"), at(number).alias("n"))
    return found.select("relative_path", "dictionary", "entry_at", F.row_number().over(W.partitionBy("relative_path").orderBy("entry_at")).cast("bigint").alias("entry_ordinal"), key_or_null("k").alias("native_key"), key_or_null("h").alias("headword"), key_or_null("n").alias("homonym"))


def entities(inner: DataFrame) -> DataFrame:
    """Nested entities: relative_path, dictionary, entry_at, entity_at, entity_kind, native_key, pos, pattern, sense ordinals (the entity's own among them)."""
    kind = _by(KINDS, F.col("dictionary"), F.col("local"))
    starts = inner.where((F.col("kind") == "start_element") & kind.isNotNull()).select("relative_path", "dictionary", "entry_at", F.col("record_ordinal").alias("entity_at"), kind.alias("entity_kind"), F.when(F.col("dictionary") == "krdict", F.coalesce(F.when(attribute("att") == "id", attribute("val")), attribute("id"))).alias("own_key"), F.col("ancestors").alias("above"))
    leaf = F.try_element_at("path", F.lit(-1))
    texts = inner.where((F.col("kind") == "element_text") & leaf.isin(*KEY_ELEMENTS.values())).select("relative_path", F.try_element_at("ancestors", F.lit(-2))["ordinal"].alias("entity_at"), leaf.alias("element"), "text_value", F.col("record_ordinal").alias("at"))
    keys = texts.groupBy("relative_path", "entity_at", "element").agg(F.min_by("text_value", "at").alias("text_key"))
    found = starts.withColumn("element", _by(KEY_ELEMENTS, F.col("dictionary"), F.col("entity_kind"))).join(keys, ["relative_path", "entity_at", "element"], "left")
    order = W.partitionBy("relative_path", "entry_at").orderBy("entity_at")
    n = lambda k: F.when(F.col("entity_kind") == k, F.row_number().over(W.partitionBy("relative_path", "entry_at", "entity_kind").orderBy("entity_at")))
    out = found.withColumn("key", key_or_null(F.coalesce("own_key", "text_key")))
    for name, k in (("pos", "part_of_speech"), ("pattern", "common_pattern"), ("sense", "sense")):
        out = out.withColumn(f"own_{name}", n(k))
    open_ids = F.transform("above", lambda a: a["ordinal"])
    for name in ("pos", "pattern"):
        last = F.last(F.when(F.col(f"own_{name}").isNotNull(), F.struct(F.col("entity_at").alias("at"), F.col(f"own_{name}").alias("n"))), ignorenulls=True).over(order)
        out = out.withColumn(f"last_{name}", last)
    up = lambda name: F.coalesce(F.col(f"own_{name}"), F.when(F.array_contains(open_ids, F.col(f"last_{name}.at")), F.col(f"last_{name}.n")))
    return out.select("relative_path", "dictionary", "entry_at", "entity_at", "entity_kind", F.col("key").alias("native_key"), up("pos").alias("pos"), up("pattern").alias("pattern"), F.col("own_sense").alias("sense"))


def identified(entry_rows: DataFrame, entity_rows: DataFrame, commit: str) -> DataFrame:
    """All entities with canonical_id and owner_entry_id. Entry keys count corpus-wide in a dictionary, nested ones within the entry."""
    # counted by an aggregate, which combines before its shuffle; rows without a key meet no count and stay where they are
    counts = entry_rows.where("native_key IS NOT NULL").groupBy("dictionary", "native_key").agg(F.count(F.lit(1)).alias("occurrences"))
    keyed = entry_rows.join(counts, ["dictionary", "native_key"], "left").withColumn("occurrences", F.coalesce("occurrences", F.lit(0)))
    place = locator(F.col("dictionary"), F.col("relative_path"), F.col("entry_ordinal"))
    none = F.lit(None).cast("string")
    tops = keyed.select("*", place.alias("locator"), canonical_id(commit, F.col("dictionary"), F.lit("entry"), F.col("native_key"), F.col("occurrences"), none, place).alias("canonical_id"))
    nested = entity_rows.join(tops.select("relative_path", "entry_at", "entry_ordinal", "headword", "homonym", F.col("native_key").alias("entry_key"), F.col("canonical_id").alias("owner_entry_id")), ["relative_path", "entry_at"])
    nested = nested.withColumn("occurrences", F.when(F.col("native_key").isNull(), 0).otherwise(F.count("native_key").over(W.partitionBy("relative_path", "entry_at", "entity_kind", "native_key"))))
    where = locator(F.col("dictionary"), F.col("relative_path"), F.col("entry_ordinal"), F.col("pos"), F.col("pattern"), F.col("sense"))
    nested = nested.withColumn("locator", where).withColumn("canonical_id", canonical_id(commit, F.col("dictionary"), F.col("entity_kind"), F.col("native_key"), F.col("occurrences"), F.col("owner_entry_id"), where))
    cols = ["dictionary", "entity_kind", "native_key", "relative_path", "entry_at", "entry_ordinal", "entity_at", "pos", "pattern", "sense", "locator", "canonical_id", "owner_entry_id", "entry_key", "headword", "homonym"]
    whole = tops.withColumns({"entity_kind": F.lit("entry"), "entity_at": F.col("entry_at"), "pos": F.lit(None).cast("int"), "pattern": F.lit(None).cast("int"), "sense": F.lit(None).cast("int"), "owner_entry_id": F.col("canonical_id"), "entry_key": F.col("native_key")})
    return whole.select(*cols).unionByName(nested.select(*cols))


def relations(inner: DataFrame) -> DataFrame:
    """relative_path, dictionary, entry_at, relation_at, relation_ordinal (from 1 in an entry), source_at (the nearest open sense, pattern, part of speech, else the entry), six arrays of raw fields."""
    container = _by(CONTAINERS, F.col("dictionary"))
    tops = inner.where((F.col("kind") == "start_element") & (F.col("local") == container))
    source = F.lit(None).cast("bigint")
    for kind in ("part_of_speech", "common_pattern", "sense"):
        names = [n for (_, n), k in KINDS.items() if k == kind]
        open_ = F.filter("inside", _one_of(names))
        source = F.coalesce(F.try_element_at(open_, F.lit(-1))["ordinal"], source)
    tops = tops.select("relative_path", "dictionary", "entry_at", F.col("record_ordinal").alias("relation_at"), F.coalesce(source, F.col("entry_at")).alias("source_at"))
    tops = tops.withColumn("relation_ordinal", F.row_number().over(W.partitionBy("relative_path", "entry_at").orderBy("relation_at")).cast("bigint"))
    leaf = F.try_element_at("path", F.lit(-1))
    krdict = F.col("dictionary") == "krdict"
    feat = krdict & (F.col("kind") == "empty_element") & (F.col("local") == "feat") & (leaf == container)
    field = F.when(feat, _by(FEAT_FIELDS, attribute("att"))).when(~krdict & (F.col("kind") == "element_text"), _by(TEXT_FIELDS, leaf))
    holder = F.try_element_at(F.filter("inside", lambda a: a["name"] == container), F.lit(-1))["ordinal"]
    values = inner.select("relative_path", holder.alias("relation_at"), field.alias("field"), F.when(feat, attribute("val")).otherwise(F.col("text_value")).alias("value"), F.col("record_ordinal").alias("at")).where("relation_at IS NOT NULL AND field IS NOT NULL AND value IS NOT NULL")
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == f, F.struct("at", "value")))), lambda x: x["value"]).alias(f) for f in FIELDS]
    got = values.groupBy("relative_path", "relation_at").agg(*lists)
    empty = {f: F.coalesce(f, F.array().cast("array<string>")) for f in FIELDS}
    return tops.join(got, ["relative_path", "relation_at"], "left").withColumns(empty)


def dictionary_rank(col: str = "dictionary") -> Column:
    return F.array_position(F.array(*[F.lit(d) for d in DICTIONARIES]), F.col(col))
