"""Constraints, integrity and life cycle of the staged record store."""

from __future__ import annotations

import functools
import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.functions.columns import DICTIONARIES, ENTITY_KINDS, ENTRY_ELEMENTS, ID_PREFIX, local_name
from recordloom.operators.digest import canonical_digest, schema_fingerprint
from recordloom.operators.entities import entries, identified, with_entries
from recordloom.operators.migrations import APPLICATION
from recordloom.session import cut
from recordloom.sources.xml_records import RECORD, scan

VERSION = 1
COMMIT = re.compile("[0-9a-f]{40}")
#: Files that an error names at most.
SHOWN = 20
#: Bytes of files, and rows of a store's table, that a task takes, about. Shuffles get a number of parts by these: adaptive
#: execution would join parts by their compressed bytes, and records in memory are some hundred times as large.
TASK_BYTES, TASK_ROWS = 1 << 21, 1 << 17
RECORD_DDL = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RECORD)

def foreign_key(name: str, child: DataFrame, parent: DataFrame, pairs: list[tuple[str, str]], parts: int | None = None) -> DataFrame:
    """constraint, violations: rows of child without a parent; a null key is exempt. parts: tasks to share the keys."""
    names = [a for a, _ in pairs]
    keys = parent.select(*[F.col(b).alias(a) for a, b in pairs])
    present = functools.reduce(lambda x, y: x & y, [F.col(a).isNotNull() for a in names])
    rows = child.where(present).select(*names)
    if parts:
        rows, keys = rows.repartition(parts, *names), keys.repartition(parts, *names)
    return rows.join(keys, names, "left_anti").agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("constraint"), "violations")


def check_rules(table: str, rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """table, rule, violations: one pass counts where each rule is false (null passes, as in SQL)."""
    counts = rows.agg(*[F.count_if(~rule).cast("bigint").alias(name) for name, rule in rules.items()])
    stack = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules]))
    return counts.select(stack.alias("x")).select(F.lit(table).alias("table_name"), "x.rule", "x.violations")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)


def reference_checks(entities: DataFrame, prefix: Column) -> DataFrame:
    """check_name, violations over entity (canonical_id, corpus_id, relative_path, kind, parent_id): ids outside their
    namespace, entries with a parent, nested without one, parents of another file, parents that are missing."""
    parent = entities.select(F.col("canonical_id").alias("parent_id"), F.col("relative_path").alias("parent_path"), F.lit(1).alias("known"))
    rows = entities.withColumn("prefix", prefix).join(parent, "parent_id", "left")
    tests = {
        "id_namespace": ~F.startswith("canonical_id", "prefix"),
        "entry_has_parent": (F.col("kind") == "entry") & F.col("parent_id").isNotNull(),
        "nested_without_parent": (F.col("kind") != "entry") & F.col("parent_id").isNull(),
        "parent_in_other_file": F.col("known").isNotNull() & (F.col("parent_path") != F.col("relative_path")),
        "parent_missing": F.col("parent_id").isNotNull() & F.col("known").isNull(),
    }
    counts = rows.agg(*[F.count_if(t).cast("bigint").alias(n) for n, t in tests.items()])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(n).alias("violations")) for n in tests]))
    return counts.select(each.alias("x")).select("x.check_name", "x.violations")


def owner_checks(entity: DataFrame, entry_projection: DataFrame, text_projection: DataFrame, relation: DataFrame, relation_candidate: DataFrame) -> DataFrame:
    """check_name, violations: projections, relations and candidates whose owners don't fit. entity: canonical_id,
    corpus_id, entity_kind, parent_entry_id. The keys are ids, so no join key is hot but a relation's many candidates and the
    missing target. Joins have parts by the rows, and relations without a target are spread over them."""
    parts = (entity.count() + relation.count()) // (2 * TASK_ROWS) + 1

    def side(name: str) -> DataFrame:
        owner = F.when(F.col("entity_kind") == "entry", F.col("canonical_id")).otherwise(F.col("parent_entry_id"))
        return entity.select(F.col("canonical_id").alias(f"{name}_id"), F.struct("corpus_id", "entity_kind", owner.alias("owner")).alias(name))

    def join(rows: DataFrame, name: str, key: str) -> DataFrame:
        return rows.repartition(parts, key).join(side(name).repartition(parts, key), key)

    def join_if_any(rows: DataFrame, name: str, key: str) -> DataFrame:
        spot = F.when(F.col(key).isNull(), F.xxhash64("relation_id")).otherwise(F.xxhash64(key))
        return rows.withColumn("spot", spot).repartition(parts, key, "spot").join(side(name).withColumn("spot", F.xxhash64(key)).repartition(parts, key, "spot"), [key, "spot"], "left").drop("spot")

    def count(rows: DataFrame, wrong: Column, name: str) -> DataFrame:
        return rows.agg(F.count_if(wrong).cast("bigint").alias("violations")).select(F.lit(name).alias("check_name"), "violations")

    c = F.col
    entries_ = join(entry_projection.select("entry_id"), "entry", "entry_id")
    texts = join(join(text_projection.select("entry_id", c("entity_id").alias("owner_id")), "entry", "entry_id"), "owner", "owner_id")
    wrong_text = (c("entry.entity_kind") != "entry") | (c("owner.corpus_id") != c("entry.corpus_id")) | (c("entry_id") != c("owner.owner"))
    names = {"source_entity_id": "source_id", "source_entry_id": "source_entry_id", "resolved_target_id": "target_id", "resolved_target_entry_id": "target_entry_id"}
    links = join(join(relation.select("relation_id", *[c(a).alias(b) for a, b in names.items()]), "source", "source_id"), "source_entry", "source_entry_id")
    links = join_if_any(join_if_any(links, "target", "target_id"), "target_entry", "target_entry_id")
    wrong_target = (c("target_entry.entity_kind") != "entry") | (c("target.corpus_id") != c("source.corpus_id")) | (c("target_entry.corpus_id") != c("source.corpus_id")) | (c("target_entry_id") != c("target.owner"))
    wrong_link = (c("source_entry.entity_kind") != "entry") | (c("source_entry.corpus_id") != c("source.corpus_id")) | (c("source_entry_id") != c("source.owner")) | (c("target_id").isNotNull() & wrong_target)
    sources = relation.select("relation_id", c("source_entity_id").alias("source_id")).repartition(parts, "relation_id")
    pairs = relation_candidate.select("relation_id", c("candidate_target_id").alias("target_id")).repartition(parts, "relation_id").join(sources, "relation_id")
    pairs = join(join(pairs, "source", "source_id"), "target", "target_id")
    return union_all([
        count(entries_, c("entry.entity_kind") != "entry", "entry_projection_owner"),
        count(texts, wrong_text, "text_projection_owner"),
        count(links, wrong_link, "relation_owner"),
        count(pairs, c("target.corpus_id") != c("source.corpus_id"), "candidate_corpus"),
    ])


def catalog_difference(stored: DataFrame, expected: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """key, verdict (missing, unexpected, changed) by a full outer join."""
    s = stored.select(F.col(key), F.struct(*cols).alias("s"))
    e = expected.select(F.col(key), F.struct(*cols).alias("e"))
    verdict = F.when(F.col("s").isNull(), "missing").when(F.col("e").isNull(), "unexpected").when(~F.col("s").eqNullSafe(F.col("e")), "changed")
    return s.join(e, key, "full").select(key, verdict.alias("verdict")).where("verdict IS NOT NULL")


def pending(catalog: DataFrame, completed: DataFrame, key: str) -> DataFrame:
    return catalog.join(completed.select(key).distinct(), key, "left_anti")


class StoreError(ValueError):
    pass


#: The columns of each table of a store. `batch` (the run that wrote a row) is the folder's name.
TABLES = {
    "source_file": "relative_path string, dictionary string, source_sha256 string, record_sha256 string, records bigint, entries bigint",
    "source_record": RECORD_DDL,
    "source_attribute": "relative_path string, record_ordinal bigint, attribute_ordinal int, name string, value string",
    "entity": "canonical_id string, dictionary string, entity_kind string, native_key string, relative_path string, entry_ordinal bigint, locator string, owner_entry_id string",
    "entry_projection": "relative_path string, entry_ordinal bigint, headword string, homonym string",
}
_ELEMENT = "kind IN ('start_element', 'empty_element', 'end_element')"
RULES = {
    "source_file": {
        "dictionary": f"dictionary IN ({', '.join(repr(d) for d in DICTIONARIES)})",
        "path": "relative_path RLIKE '^[^/]+/[^/]+[.]xml$'",
        "source_digest": "source_sha256 RLIKE '^[0-9a-f]{64}$'",
        "record_digest": "record_sha256 RLIKE '^[0-9a-f]{64}$'",
        "counts": "records >= 0 AND entries >= 0",
    },
    "source_record": {
        "kind": f"{_ELEMENT} OR kind IN ('element_text', 'tail_text')",
        "depth": "depth >= 0 AND record_ordinal >= 0",
        "element": f"NOT {_ELEMENT} OR (coalesce(qname, '') <> '' AND text_value IS NULL)",
        "text": f"{_ELEMENT} OR (qname IS NULL AND text_value IS NOT NULL)",
        "attributes": "kind IN ('start_element', 'empty_element') OR size(attributes) = 0",
    },
    "source_attribute": {"name": "coalesce(name, '') <> ''", "ordinal": "attribute_ordinal >= 0"},
    "entity": {
        "id": f"canonical_id LIKE '{ID_PREFIX}/%'",
        "kind": f"entity_kind IN ({', '.join(repr(k) for k in ENTITY_KINDS)})",
        "owner": "(entity_kind = 'entry') = (owner_entry_id = canonical_id)",
    },
    "entry_projection": {"headword": "coalesce(headword, '') <> ''", "ordinal": "entry_ordinal >= 1"},
}
UNIQUE = {
    "source_file": [["relative_path"]],
    "source_record": [["relative_path", "record_ordinal"]],
    "source_attribute": [["relative_path", "record_ordinal", "attribute_ordinal"]],
    "entity": [["canonical_id"], ["locator"], ["dictionary", "entity_kind", "native_key"]],
    "entry_projection": [["relative_path", "entry_ordinal"]],
}
FOREIGN = {
    "record_of_file": ("source_record", "source_file", ["relative_path"]),
    "attribute_of_record": ("source_attribute", "source_record", ["relative_path", "record_ordinal"]),
    "entity_of_file": ("entity", "source_file", ["relative_path"]),
    "projection_of_entry": ("entry_projection", "entity", ["relative_path", "entry_ordinal"]),
}


def duplicates(name: str, rows: DataFrame, key: list[str], parts: int | None = None) -> DataFrame:
    """constraint, violations: keys (without nulls) that more than one row has. parts: tasks to share the keys."""
    whole = functools.reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
    keys = rows.where(whole).select(*key)
    more = (keys.repartition(parts, *key) if parts else keys).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return more.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("constraint"), "violations")


def shape_faults(records: DataFrame, found: DataFrame) -> DataFrame:
    """relative_path, fault of files whose records no import takes: malformed, an entry in an entry, an empty entry,
    an entry without a key or a headword, a key that two entries of a file have. A file may have several rows. found: the
    records' entries()."""
    mine = functools.reduce(lambda out, d: out.when(F.col("d") == d, ENTRY_ELEMENTS[d]), ENTRY_ELEMENTS, F.when(F.lit(False), ""))
    named = records.withColumn("d", F.substring_index("relative_path", "/", 1)).withColumn("mine", mine).withColumn("local", local_name("qname"))
    opens = F.col("kind").isin("start_element", "empty_element") & (F.col("local") == F.col("mine"))
    inside = F.exists("ancestors", lambda a: a["name"] == F.col("mine"))
    fault = F.when(F.col("kind") == "error", F.concat(F.lit("malformed: "), "text_value")).when(opens & inside, "an entry within an entry").when(opens & (F.col("kind") == "empty_element"), "an empty entry")
    shape = named.select("relative_path", fault.alias("fault")).where("fault IS NOT NULL")
    bare = found.where("native_key IS NULL OR headword IS NULL").select("relative_path", F.lit("an entry has no key or no headword").alias("fault"))
    twice = found.where("native_key IS NOT NULL").groupBy("relative_path", "native_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("relative_path", F.lit("two entries have one key").alias("fault"))
    return union_all([shape, bare, twice])


class Store:
    """A corpus as Parquet tables under a folder of any file system that Spark writes.

    A run of add() imports all files that aren't complete in one pass and writes them under a batch of its own. Rows
    count once the batch's `source_file` rows are there: these are written last, as one file, so a file is in the store
    with all its rows or not at all, whatever a lost run left behind. `store.json` is written by begin(), `ready.json`
    by finalize() after every check holds; neither is ever rewritten. Let one run write at a time."""

    def __init__(self, spark: SparkSession, root: str, commit: str, target: str | None = None):
        self.spark, self.root, self.commit = spark, root.rstrip("/"), commit
        self.target = (target or root).rstrip("/")

    # -- life cycle

    @classmethod
    def begin(cls, spark: SparkSession, root: str, commit: str, mode: str = "new") -> Store:
        """new: root must not exist. resume: root must be an importing store of this commit and these tables. rebuild:
        root must be a store; the import works beside it and takes its place in finalize()."""
        if not COMMIT.fullmatch(commit):
            raise StoreError("a commit is 40 lower-case hex digits")
        here = cls(spark, root, commit)
        there = cls(spark, here.root + ".rebuild", commit, root)
        if mode == "resume":
            here.check_importing()
            return here
        if mode not in ("new", "rebuild"):
            raise StoreError(f"there is no mode {mode}")
        if mode == "new" and here._exists(here.root):
            raise StoreError(f"{root} exists")
        if mode == "rebuild":
            here._description()
        if there._exists(there.root):
            raise StoreError(f"{there.root} is left of another rebuild: resume or remove it")
        made = here if mode == "new" else there
        made._put("store.json", {"application": APPLICATION, "version": VERSION, "commit": commit, "fingerprint": made.expected_fingerprint()})
        return made

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _exists(self, path: str) -> bool:
        return self._fs().exists(self._path(path))

    def _put(self, name: str, value: dict) -> None:
        fs, part, whole = self._fs(), self._path(f"{self.root}/_{name}.part"), self._path(f"{self.root}/{name}")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()
        if not fs.rename(part, whole):
            raise StoreError(f"{self.root}/{name} can't be written")

    def _get(self, name: str) -> dict | None:
        if not self._exists(f"{self.root}/{name}"):
            return None
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.root}/{name}").collect()))

    def _description(self) -> dict:
        got = self._get("store.json")
        if got is None or got.get("application") != APPLICATION:
            raise StoreError(f"{self.root} is no store")
        if got["version"] > VERSION:
            raise StoreError(f"{self.root} has version {got['version']}, newer than {VERSION}")
        if got["fingerprint"] != self.expected_fingerprint():
            raise StoreError(f"{self.root} has other tables than version {VERSION}")
        return got

    def check_importing(self) -> None:
        if self._description()["commit"] != self.commit:
            raise StoreError(f"{self.root} is of another commit")
        if self._get("ready.json") is not None:
            raise StoreError(f"{self.root} is ready already")

    def abandon(self) -> None:
        """Remove an import that isn't ready; a store that is being rebuilt stays as it is."""
        self.check_importing()
        self._fs().delete(self._path(self.root), True)

    # -- tables

    def _fingerprint(self, tables: dict[str, str]) -> str:
        rows = [("table", name, name, columns) for name, columns in tables.items()]
        return schema_fingerprint(self.spark.createDataFrame(rows, "type string, name string, tbl_name string, sql string")).first().fingerprint

    def expected_fingerprint(self) -> str:
        return self._fingerprint({name: T.StructType.fromDDL(ddl).simpleString() for name, ddl in TABLES.items()})

    def _written(self, name: str) -> DataFrame:
        folder = f"{self.root}/{name}"
        if not self._exists(folder):
            return self.spark.createDataFrame([], f"{TABLES[name]}, batch string")
        return self.spark.read.schema(f"{TABLES[name]}, batch string").parquet(folder)

    def table(self, name: str) -> DataFrame:
        """Rows of complete files."""
        rows = self._written(name)
        return rows if name == "source_file" else rows.join(self._written("source_file").select("relative_path", "batch"), ["relative_path", "batch"], "left_semi")

    def completed(self) -> DataFrame:
        return self.table("source_file").drop("batch")

    def _write(self, batch: str, name: str, rows: DataFrame) -> DataFrame:
        to = f"{self.root}/{name}/batch={batch}"
        rows.select(*T.StructType.fromDDL(TABLES[name]).names).write.parquet(to)
        return self.spark.read.schema(TABLES[name]).parquet(to)

    # -- import

    def add(self, files: DataFrame) -> DataFrame:
        """Import the files (relative_path, content) that aren't complete, all in one batch; complete ones are left as
        they are if their bytes are the same, else it is an error. Files with a fault (shape_faults()) are left out and
        named in the error that follows; the others are in the store then."""
        self.check_importing()
        done = self.completed()
        sums = files.select("relative_path", F.sha2("content", 256).alias("source_sha256"))
        other = sums.join(done.select("relative_path", F.col("source_sha256").alias("known")), "relative_path").where("known <> source_sha256").first()
        if other:
            raise StoreError(f"{other.relative_path}: its bytes aren't those that were imported")
        todo = pending(files, done, "relative_path")
        if todo.isEmpty():
            return done
        batch = uuid.uuid4().hex
        parts = (todo.agg(F.sum(F.octet_length("content"))).first()[0] or 0) // TASK_BYTES + 1
        dealt = todo.repartition(parts)
        records = self._write(batch, "source_record", scan(dealt, strict=False, whole=False))
        found = cut(entries(with_entries(records)), "entries")
        faults = shape_faults(records, found).groupBy("relative_path").agg(F.min("fault").alias("fault"))
        attributes = records.select("relative_path", "record_ordinal", F.posexplode("attributes").alias("attribute_ordinal", "a")).select("relative_path", "record_ordinal", "attribute_ordinal", "a.name", "a.value")
        attributes = self._write(batch, "source_attribute", attributes)
        none = self.spark.createDataFrame([], "relative_path string, entry_at bigint, dictionary string, entity_at bigint, entity_kind string, native_key string, pos int, pattern int, sense int")
        self._write(batch, "entity", identified(found, none, self.commit))
        projection = self._write(batch, "entry_projection", found)
        # what was written is read back and must have the digest of the source
        again = scan(dealt, strict=False, whole=False).where("kind <> 'error'")
        source = canonical_digest(again, parts=parts).withColumnRenamed("record_sha256", "of_source")
        facts = rebuilt(records.where("kind <> 'error'"), attributes, parts).join(source, "relative_path", "left").join(sums, "relative_path")
        facts = facts.join(records.groupBy("relative_path").agg(F.count(F.lit(1)).alias("records")), "relative_path")
        facts = facts.join(projection.groupBy("relative_path").agg(F.count(F.lit(1)).alias("entries")), "relative_path", "left")
        good = facts.where("record_sha256 = of_source").join(faults, "relative_path", "left_anti")
        row = good.withColumn("dictionary", F.substring_index("relative_path", "/", 1)).withColumn("entries", F.coalesce("entries", F.lit(0)))
        stored = self._write(batch, "source_file", row.repartition(1))  # coalesce() would have one task do all of the above
        # the batch's own folder: Spark takes two listings of one folder in a plan for the same, todo's older one too
        left = pending(todo, stored, "relative_path").select("relative_path").join(faults, "relative_path", "left").orderBy("relative_path")
        named = [f"{r.relative_path}: {r.fault or 'the stored records differ from the source'}" for r in left.limit(SHOWN).collect()]
        if named:
            raise StoreError("; ".join(named))
        return self.completed()

    def checks(self, files: DataFrame | None = None) -> DataFrame:
        """constraint, violations of every rule, unique key and foreign key; with the expected files also those that are
        pending, that nobody expects, or whose bytes differ."""
        tables = {name: self.table(name) for name in TABLES}
        out = [check_rules(t, tables[t], {n: F.expr(x) for n, x in rules.items()}).select(F.concat_ws(".", "table_name", "rule").alias("constraint"), "violations") for t, rules in RULES.items()]
        parts = (self.completed().agg(F.sum("records")).first()[0] or 0) // TASK_ROWS + 1
        out += [duplicates(f"{t}.unique({','.join(key)})", tables[t], key, parts) for t, keys in UNIQUE.items() for key in keys]
        # source_file is small: its joins need no parts
        out += [foreign_key(n, tables[child], tables[parent], [(k, k) for k in key], None if parent == "source_file" else parts) for n, (child, parent, key) in FOREIGN.items()]
        entries_ = tables["entry_projection"].groupBy("relative_path").agg(F.count(F.lit(1)).alias("found"))
        counted = tables["source_record"].groupBy("relative_path").agg(F.count(F.lit(1)).alias("held"))
        sums = tables["source_file"].join(entries_, "relative_path", "left").join(counted, "relative_path", "left")
        wrong = (F.col("entries") != F.coalesce("found", F.lit(0))) | (F.col("records") != F.coalesce("held", F.lit(0)))
        out.append(sums.agg(F.count_if(wrong).cast("bigint").alias("violations")).select(F.lit("source_file.sums").alias("constraint"), "violations"))
        if files is not None:
            want = files.select("relative_path", F.sha2("content", 256).alias("source_sha256"))
            verdicts = catalog_difference(self.completed(), want, "relative_path", ["source_sha256"])
            counts = [F.count_if(F.col("verdict") == v).cast("bigint").alias(v) for v in ("missing", "unexpected", "changed")]
            each = F.explode(F.array(*[F.struct(F.lit(f"files.{v}").alias("constraint"), F.col(v).alias("violations")) for v in ("missing", "unexpected", "changed")]))
            out.append(verdicts.agg(*counts).select(each.alias("x")).select("x.constraint", "x.violations"))
        return union_all(out)

    def finalize(self, files: DataFrame) -> dict:
        """Check everything, write the descriptor and, after a rebuild, put the store in the old one's place."""
        self.check_importing()
        actual = {name: T.StructType([f for f in self.spark.read.parquet(f"{self.root}/{name}").schema if f.name != "batch"]).simpleString() if self._exists(f"{self.root}/{name}") else "" for name in TABLES}
        missing = [name for name, columns in actual.items() if not columns]
        if missing:
            raise StoreError(f"the store lacks {', '.join(missing)}")
        if self._fingerprint(actual) != self.expected_fingerprint():
            raise StoreError("the tables don't have the columns of this version")
        failed = {r.constraint: r.violations for r in self.checks(files).where("violations > 0").collect()}
        if "files.missing" in failed:
            raise StoreError(f"some files are pending: {failed['files.missing']}")
        if failed:
            raise StoreError("; ".join(f"{k}: {n}" for k, n in sorted(failed.items())))
        total = self.completed().agg(F.count(F.lit(1)).alias("files"), F.sum("entries").alias("entries")).first()
        descriptor = {"commit": self.commit, "state": "ready", "source_files": total.files, "entries": total.entries or 0}
        self._put("ready.json", descriptor)
        if self.target != self.root:
            self._publish()
        return descriptor

    def _publish(self) -> None:
        fs, old = self._fs(), f"{self.target}.old"
        if not fs.rename(self._path(self.target), self._path(old)):
            raise StoreError(f"{self.target} can't be moved")
        if not fs.rename(self._path(self.root), self._path(self.target)):
            fs.rename(self._path(old), self._path(self.target))
            raise StoreError(f"{self.root} can't take the place of {self.target}")
        fs.delete(self._path(old), True)
        self.root = self.target

    def descriptor(self) -> dict:
        """Of a ready store, checked against its version, commit and tables."""
        if self._description()["commit"] != self.commit:
            raise StoreError(f"{self.root} is of another commit")
        got = self._get("ready.json")
        if got is None:
            raise StoreError(f"{self.root} isn't ready")
        return got


def rebuilt(records: DataFrame, attributes: DataFrame, parts: int) -> DataFrame:
    """Digest of stored records with their attributes joined back in order, by so many tasks."""
    at = ["relative_path", "record_ordinal"]
    records, attributes = records.select(*at, "kind", "depth", "qname", "text_value").repartition(parts, *at), attributes.repartition(parts, *at)
    lists = attributes.groupBy("relative_path", "record_ordinal").agg(F.transform(F.array_sort(F.collect_list(F.struct("attribute_ordinal", "name", "value"))), lambda a: F.struct(a["name"].alias("name"), a["value"].alias("value"))).alias("joined"))
    rows = records.join(lists, at, "left").withColumn("attributes", F.coalesce("joined", F.array().cast("array<struct<name:string,value:string>>")))
    return canonical_digest(rows, parts=parts)
