"""Queries over the driver's tables. Each pairs a Spark program built from the operators with equivalent SQL.

An adapter renders relational rows as XML files of bounded size and runs the real scanner over them, where a query
is about sources; the SQL derives the same rows on its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import columns as C
from recordloom.operators import batch, book, digest, entities, graph, profiles, relations, store
from recordloom.session import cut, scratch
from recordloom.sources import catalog, xml_records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
COMMIT = "0123456789abcdef0123456789abcdef01234567"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def s(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("string")


# -- adapters


def customer_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of 500 customers as lexical entries: relative_path, content."""
    c = table(spark, d, "customer")
    path = F.concat(F.lit("krdict/"), F.lpad(s(F.floor(F.col("c_custkey") / 500)), 6, "0"), F.lit(".xml"))
    entry = F.concat(F.lit('<LexicalEntry att="id" val="'), s("c_custkey"), F.lit('"><feat att="homonym_number" val="'), s("c_nationkey"), F.lit('"/><Lemma><feat att="writtenForm" val="'), C.escape_xml("c_name"), F.lit('"/></Lemma></LexicalEntry>'))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", entry.alias("e")))), lambda x: x["e"]), "\n")
    return c.groupBy(path.alias("relative_path")).agg(F.encode(F.concat(F.lit("<LexicalResource><Lexicon>"), whole, F.lit("</Lexicon></LexicalResource>")), "UTF-8").alias("content"))


CUSTOMER_EVENTS = """
c AS (SELECT 'krdict/' || lpad((c_custkey // 500)::VARCHAR, 6, '0') || '.xml' AS relative_path, c_custkey, c_nationkey, c_name,
             row_number() OVER (PARTITION BY c_custkey // 500 ORDER BY c_custkey) - 1 AS i,
             count(*) OVER (PARTITION BY c_custkey // 500) AS n FROM customer),
ev AS (
 SELECT relative_path, 2 + 6 * i AS record_ordinal, 'start_element' AS kind, 2 AS depth, 'LexicalEntry' AS qname, 'att=id|val=' || c_custkey AS attrs FROM c
 UNION ALL SELECT relative_path, 3 + 6 * i, 'empty_element', 3, 'feat', 'att=homonym_number|val=' || c_nationkey FROM c
 UNION ALL SELECT relative_path, 4 + 6 * i, 'start_element', 3, 'Lemma', '' FROM c
 UNION ALL SELECT relative_path, 5 + 6 * i, 'empty_element', 4, 'feat', 'att=writtenForm|val=' || c_name FROM c
 UNION ALL SELECT relative_path, 6 + 6 * i, 'end_element', 3, 'Lemma', '' FROM c
 UNION ALL SELECT relative_path, 7 + 6 * i, 'end_element', 2, 'LexicalEntry', '' FROM c
 UNION ALL SELECT DISTINCT relative_path, 0, 'start_element', 0, 'LexicalResource', '' FROM c
 UNION ALL SELECT DISTINCT relative_path, 1, 'start_element', 1, 'Lexicon', '' FROM c
 UNION ALL SELECT DISTINCT relative_path, 2 + 6 * n, 'end_element', 1, 'Lexicon', '' FROM c
 UNION ALL SELECT DISTINCT relative_path, 3 + 6 * n, 'end_element', 0, 'LexicalResource', '' FROM c)
"""


def customer_records(spark: SparkSession, d: str) -> DataFrame:
    return xml_records.scan(customer_files(spark, d))


def nation_files(spark: SparkSession, d: str) -> DataFrame:
    """A file a region with its nations as items: mixed content, so texts and tails."""
    n = table(spark, d, "nation")
    item = F.concat(F.lit('<item target_code="'), s("n_nationkey"), F.lit('"><b/>'), C.escape_xml("n_name"), F.lit("<w>"), C.escape_xml("n_name"), F.lit("</w></item>"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", item.alias("e")))), lambda x: x["e"]), "")
    return n.groupBy(F.concat(F.lit("stdict/"), s("n_regionkey"), F.lit(".xml")).alias("relative_path")).agg(F.encode(F.concat(F.lit("<channel>"), whole, F.lit("</channel>")), "UTF-8").alias("content"))


# -- sources, counts, digests


@query("""
SELECT r_name AS dictionary, r_name || '/' || n_name || '.xml' AS relative_path,
       row_number() OVER (PARTITION BY r_name ORDER BY n_name) AS volume_number, count(*) OVER (PARTITION BY r_name) AS volume_total,
       r_name || '-' || lpad((row_number() OVER (PARTITION BY r_name ORDER BY n_name))::VARCHAR, 3, '0') || '-of-' || lpad((count(*) OVER (PARTITION BY r_name))::VARCHAR, 3, '0') || '.epub' AS output_filename
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def volume_catalog(spark, d):
    files = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return catalog.volumes(files.select(F.col("r_name").alias("dictionary"), F.concat("r_name", F.lit("/"), "n_name", F.lit(".xml")).alias("relative_path")))


@query(f"WITH {CUSTOMER_EVENTS} SELECT relative_path, record_ordinal::BIGINT AS record_ordinal, kind, depth::INTEGER AS depth, qname, attrs FROM ev")
def record_stream(spark, d):
    attrs = F.array_join(F.transform("attributes", lambda a: F.concat(a["name"], F.lit("="), a["value"])), "|")
    return customer_records(spark, d).select("relative_path", "record_ordinal", "kind", "depth", "qname", attrs.alias("attrs"))


@query(f"""WITH {CUSTOMER_EVENTS} SELECT relative_path, count(*) FILTER (kind IN ('start_element', 'empty_element')) AS elements, count(*) FILTER (kind = 'empty_element') AS empty_elements,
 count(*) FILTER (kind = 'end_element') AS end_elements, sum(CASE WHEN attrs = '' THEN 0 ELSE 2 END)::BIGINT AS attributes, 0::BIGINT AS element_texts, 0::BIGINT AS tail_texts, 0::BIGINT AS control_characters, count(*) AS records
 FROM ev GROUP BY relative_path""")
def record_counts(spark, d):
    return digest.record_counts(customer_records(spark, d))


_L = "printf('%016x', {0}) "


@query("""
WITH x AS (SELECT n_regionkey, n_nationkey, n_name, printf('%016x', octet_length(encode(n_name))) || hex(encode(n_name)) AS nm, n_nationkey::VARCHAR AS k FROM nation),
t AS (SELECT n_regionkey, n_nationkey,
 '01' || printf('%016x', 1) || printf('%016x', 4) || hex(encode('item')) || printf('%016x', 1) || printf('%016x', 11) || hex(encode('target_code')) || printf('%016x', length(k)) || hex(encode(k))
 || '02' || printf('%016x', 2) || printf('%016x', 1) || hex(encode('b')) || printf('%016x', 0)
 || '04' || printf('%016x', 2) || nm
 || '01' || printf('%016x', 2) || printf('%016x', 1) || hex(encode('w')) || printf('%016x', 0)
 || '03' || printf('%016x', 2) || nm || '05' || printf('%016x', 2) || printf('%016x', 1) || hex(encode('w'))
 || '05' || printf('%016x', 1) || printf('%016x', 4) || hex(encode('item')) AS tok FROM x)
SELECT 'stdict/' || n_regionkey || '.xml' AS relative_path,
 sha256(unhex(hex(encode('recordloom/record-digest/v1')) || '00' || '01' || printf('%016x', 0) || printf('%016x', 7) || hex(encode('channel')) || printf('%016x', 0)
 || string_agg(tok, '' ORDER BY n_nationkey) || '05' || printf('%016x', 0) || printf('%016x', 7) || hex(encode('channel')))) AS record_sha256
FROM t GROUP BY n_regionkey""")
def canonical_digest(spark, d):
    return digest.canonical_digest(xml_records.scan(nation_files(spark, d)))


QUERIES["canonical_digest_collected"] = lambda spark, d: digest.canonical_digest_collected(xml_records.scan(nation_files(spark, d)))
SQL["canonical_digest_collected"] = SQL["canonical_digest"]


@query("""
SELECT p_brand || '/' || (p_partkey // 500) AS relative_path, count(*) AS headword_count, sha256(string_agg(trim(p_name) || chr(10), '' ORDER BY p_partkey)) AS headword_sha256,
 arg_min(trim(p_name), p_partkey) AS first_headword, arg_max(trim(p_name), p_partkey) AS last_headword FROM part GROUP BY 1""")
def headword_digest(spark, d):
    p = table(spark, d, "part")
    return digest.headword_digest(p.select(F.concat("p_brand", F.lit("/"), s(F.floor(F.col("p_partkey") / 500))).alias("relative_path"), F.col("p_partkey").alias("entry_ordinal"), F.col("p_name").alias("headword")))


@query("""
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN length(text) ELSE 0 END::BIGINT AS controls, true AS equal_again,
 (length(text) + CASE WHEN doc_id % 7 = 0 THEN 2 * length(text) ELSE 0 END)::BIGINT AS sanitized_chars
FROM documents""")
def control_roundtrip(spark, d):
    text = F.when(F.col("doc_id") % 7 == 0, F.concat(F.repeat(F.lit(chr(8)), F.length("text")), "text")).otherwise(F.col("text"))
    docs = table(spark, d, "documents").select("doc_id", text.alias("t")).withColumn("clean", C.sanitize("t"))
    return docs.select("doc_id", C.control_count("t").alias("controls"), (C.restore("clean") == F.col("t")).alias("equal_again"), F.length("clean").cast("bigint").alias("sanitized_chars"))


_ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"


@query(f"SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN '<span class=\"xml-control\" data-codepoint=\"U+0008\">' || chr(9224) || ' U+0008</span>' ELSE '' END || {_ESC.format('text')}) AS rendered_sha256 FROM documents")
def render_value(spark, d):
    text = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit(chr(8)), "text")).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.sha2(C.render_value(text), 256).alias("rendered_sha256"))


_NAME = "CASE event_type WHEN 'view' THEN 'x:Word' WHEN 'click' THEN 'Sense' WHEN 'purchase' THEN 'exampleInfo' WHEN 'signup' THEN 'feat' ELSE 'y:translation' END"


@query(f"""SELECT event_id, CASE event_type WHEN 'view' THEN 'semantic-headword' WHEN 'click' THEN 'semantic-definition' WHEN 'purchase' THEN 'semantic-example'
 WHEN 'signup' THEN CASE WHEN user_id % 2 = 0 THEN 'semantic-headword' ELSE 'none' END ELSE 'semantic-translation' END AS css FROM events""")
def semantic_class(spark, d):
    att = F.array(F.struct(F.lit("att").alias("name"), F.when(F.col("user_id") % 2 == 0, "writtenForm").otherwise("other").alias("value")))
    return table(spark, d, "events").select("event_id", F.coalesce(C.semantic_class(F.expr(_NAME), att), F.lit("none")).alias("css"))


@query("SELECT page_id, url_encode(url) AS encoded FROM pages")
def percent_encode(spark, d):
    return table(spark, d, "pages").select("page_id", C.percent_encode("url").alias("encoded"))


@query(f"""
WITH o AS (SELECT o_orderkey, o_custkey::VARCHAR AS k, o_orderkey % 8 AS f, row_number() OVER (PARTITION BY o_orderkey % 8 ORDER BY o_orderkey) AS e, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_orderkey, 'kweb:v1/{COMMIT}/stdict/entry/' || k || CASE WHEN n = 1 THEN '' ELSE '/at/' || url_encode('stdict:stdict/' || f || '.xml#entry=' || e) END AS canonical_id FROM o""")
def canonical_ids(spark, d):
    from pyspark.sql import Window as W

    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 8).alias("f"))
    o = o.withColumn("e", F.row_number().over(W.partitionBy("f").orderBy("o_orderkey"))).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("o_custkey")))
    place = C.locator(F.lit("stdict"), F.concat(F.lit("stdict/"), s("f"), F.lit(".xml")), F.col("e"))
    return o.select("o_orderkey", C.canonical_id(COMMIT, F.lit("stdict"), F.lit("entry"), s("o_custkey"), F.col("n"), F.lit(None).cast("string"), place).alias("canonical_id"))


@query(r"""
SELECT page_id, lower(regexp_extract(url, '^.*?://([^/?#:@]*)', 1)) AS host,
 CASE WHEN contains(url, '?') THEN list_last(list_filter(string_split(regexp_replace(url, '^[^?]*\?', ''), '&'), lambda p: starts_with(p, 'page='))) END AS page_pair,
 CASE WHEN contains(url, '?') THEN substr(list_last(list_filter(string_split(regexp_replace(url, '^[^?]*\?', ''), '&'), lambda p: starts_with(p, 'page='))), 6) END AS page_value
FROM pages""")
def url_host_query(spark, d):
    value = C.url_query("url", "page")
    return table(spark, d, "pages").select("page_id", C.url_host("url").alias("host"), F.concat(F.lit("page="), value).alias("page_pair"), value.alias("page_value"))


@query(r"""
WITH w AS (SELECT p_partkey, p_name AS h, k, CASE k WHEN 0 THEN p_name WHEN 1 THEN ' ' || p_name || ' ' WHEN 2 THEN p_name || '7' WHEN 3 THEN p_name || '07' WHEN 4 THEN p_name || '007' WHEN 5 THEN p_name || '0007' ELSE p_name || 'x07' END AS word
 FROM part, range(7) r(k))
SELECT p_partkey, k::INTEGER AS k, trim(word) = h OR regexp_full_match(substr(trim(word), length(h) + 1), '[0-9]{2,3}') AND NOT regexp_matches(h, '[0-9]$') AND starts_with(trim(word), h) AS compatible
FROM w""")
def labels_compatible(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("h"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("k"))
    words = ["h", F.concat(F.lit(" "), "h", F.lit(" ")), *[F.concat("h", F.lit(x)) for x in ("7", "07", "007", "0007", "x07")]]
    word = F.get(F.array(*words), F.col("k"))
    return p.select("p_partkey", "k", C.labels_compatible(word, F.col("h")).alias("compatible"))


# -- profiles

KEYS = {"orders:cust": ("orders", "o_custkey"), "lineitem:part": ("lineitem", "l_partkey"), "part:part": ("part", "p_partkey"), "part:type": ("part", "p_type"), "supplier:nation": ("supplier", "s_nationkey"), "customer:cust": ("customer", "c_custkey")}
_KEYS_SQL = " UNION ALL ".join(f"SELECT '{n}' AS namespace, CASE WHEN {c}::VARCHAR LIKE '%7' THEN ' ' ELSE {c}::VARCHAR END AS key FROM {t}" for n, (t, c) in KEYS.items())


def key_rows(spark, d, blank: bool = True) -> DataFrame:
    each = [table(spark, d, t).select(F.lit(n).alias("namespace"), s(c).alias("key")) for n, (t, c) in KEYS.items()]
    rows = store.union_all(each)
    return rows.withColumn("key", F.when(F.col("key").like("%7"), " ").otherwise(F.col("key"))) if blank else rows


@query(f"""
WITH k AS ({_KEYS_SQL}), p AS (SELECT namespace, nullif(trim(key), '') AS k, count(*) AS n FROM k GROUP BY 1, 2)
SELECT namespace, sum(n)::BIGINT AS present, coalesce(sum(n) FILTER (k IS NULL), 0)::BIGINT AS missing, coalesce(sum(n) FILTER (k IS NOT NULL AND NOT regexp_full_match(k, '[0-9]+')), 0)::BIGINT AS malformed,
 count(k) AS distinct_keys, count(*) FILTER (k IS NOT NULL AND n > 1) AS duplicate_values, coalesce(sum(n - 1) FILTER (k IS NOT NULL AND n > 1), 0)::BIGINT AS duplicate_occurrences,
 greatest(coalesce(max(n) FILTER (k IS NOT NULL AND n > 1), 0), 1)::BIGINT AS max_occurrences,
 coalesce(sum(n) FILTER (k IS NULL), 0) = 0 AND count(*) FILTER (k IS NOT NULL AND n > 1) = 0 AS globally_unique
FROM p GROUP BY namespace""")
def key_profile(spark, d):
    return profiles.key_profile(key_rows(spark, d))


@query("""
WITH r AS (SELECT 'file' AS namespace, (l_suppkey % 8)::VARCHAR AS scope, l_partkey::VARCHAR AS key FROM lineitem UNION ALL SELECT 'entry', l_orderkey::VARCHAR, (l_partkey % 50)::VARCHAR FROM lineitem UNION ALL SELECT 'line', l_orderkey::VARCHAR, l_linenumber::VARCHAR FROM lineitem),
t AS (SELECT namespace, count(DISTINCT scope) AS scopes FROM r GROUP BY 1), p AS (SELECT namespace, scope, key, count(*) AS n FROM r GROUP BY ALL HAVING count(*) > 1),
e AS (SELECT namespace, scope, count(*) AS v, sum(n - 1) AS o, max(n) AS m FROM p GROUP BY 1, 2)
SELECT t.namespace, t.scopes, coalesce(count(e.scope), 0)::BIGINT AS scopes_with_duplicates, coalesce(sum(v), 0)::BIGINT AS duplicate_values, coalesce(sum(o), 0)::BIGINT AS duplicate_occurrences, coalesce(max(m), 0)::BIGINT AS max_occurrences
FROM t LEFT JOIN e USING (namespace) GROUP BY t.namespace, t.scopes""")
def scope_profile(spark, d):
    line = table(spark, d, "lineitem")
    each = [("file", s(F.col("l_suppkey") % 8), s("l_partkey")), ("entry", s("l_orderkey"), s(F.col("l_partkey") % 50)), ("line", s("l_orderkey"), s("l_linenumber"))]
    rows = store.union_all([line.select(F.lit(n).alias("namespace"), a.alias("scope"), b.alias("key")) for n, a, b in each])
    return profiles.scope_profile(rows, rows.groupBy("namespace").agg(F.count_distinct("scope").alias("scopes")))


@query("""
WITH r AS (SELECT l_partkey::VARCHAR AS key, l_orderkey || '.' || l_linenumber AS locator, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber) AS r FROM lineitem)
SELECT key, count(*) AS occurrences, string_agg(locator, ' ' ORDER BY r) FILTER (r <= 5) AS locators FROM r GROUP BY key HAVING count(*) > 1""")
def duplicate_groups(spark, d):
    line = table(spark, d, "lineitem")
    return profiles.duplicate_samples(line.select(s("l_partkey").alias("key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), F.concat(s("l_orderkey"), F.lit("."), s("l_linenumber")).alias("locator")))


_NS = sorted(KEYS)
_VALUES = ", ".join(f"({k}, '{n}')" for k, n in enumerate(_NS))


@query(f"""
WITH k AS ({" UNION ALL ".join(f"SELECT '{n}' AS namespace, {c}::VARCHAR AS key FROM {t}" for n, (t, c) in KEYS.items())}),
n AS (SELECT DISTINCT namespace, key::BIGINT AS n FROM k WHERE regexp_full_match(key, '[0-9]+')), v(i, ns) AS (VALUES {_VALUES}),
p AS (SELECT a.ns AS l, b.ns AS r FROM v a JOIN v b ON a.i < b.i), j AS (SELECT p.l, p.r, x.n FROM p JOIN n x ON x.namespace = p.l JOIN n y ON y.namespace = p.r AND x.n = y.n)
SELECT p.l AS left_namespace, p.r AS right_namespace, count(j.n) AS shared, coalesce(array_to_string(list_slice(list_sort(list(j.n) FILTER (j.n IS NOT NULL)), 1, 10), ' '), '') AS samples
FROM p LEFT JOIN j ON p.l = j.l AND p.r = j.r GROUP BY 1, 2""")
def numeric_collisions(spark, d):
    return profiles.numeric_collisions(key_rows(spark, d, blank=False), _NS)


# -- relations

_DICT = "CASE {0} % 3 WHEN 0 THEN 'krdict' WHEN 1 THEN 'stdict' ELSE 'opendict' END"
_RELATIONS_SQL = f"""
r AS (SELECT o_orderkey AS relation_id, {_DICT.format("o_orderkey")} AS dictionary, 'c' || (o_orderkey % 97) AS source_entry_id,
 CASE o_orderkey % 11 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['a', 'b'] ELSE [' t' || (o_orderkey % 5)] END AS types,
 CASE o_orderkey % 13 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['1', '2'] WHEN 2 THEN [' '] ELSE [(o_custkey % 120)::VARCHAR] END AS target_keys,
 CASE o_orderkey % 7 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['x', 'y'] WHEN 2 THEN ['w' || (o_custkey % 4) || '012'] ELSE ['w' || (o_custkey % 4)] END AS words,
 CASE o_orderkey % 5 WHEN 0 THEN [(o_custkey % 3)::VARCHAR] ELSE []::VARCHAR[] END AS homonyms,
 CASE o_orderkey % 17 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['?'] WHEN 2 THEN ['품사'] WHEN 3 THEN ['의미'] ELSE ['어휘'] END AS units,
 CASE o_orderkey % 4 WHEN 0 THEN ['https://' || {_DICT.format("o_orderkey")} || '.korean.go.kr/v?word_no=' || (o_custkey % 120) || '&sense_no=' || (o_custkey % 121)]
  WHEN 1 THEN ['https://' || {_DICT.format("o_orderkey")} || '.korean.go.kr/v'] ELSE []::VARCHAR[] END AS urls FROM orders),
c AS (SELECT {_DICT.format("c_custkey")} AS dictionary, CASE WHEN c_custkey % 9 = 8 THEN 'sense' WHEN c_custkey % 9 = 7 THEN 'part_of_speech' ELSE 'entry' END AS entity_kind, (c_custkey % 100)::VARCHAR AS native_key,
 'k' || c_custkey AS canonical_id, 'c' || (c_custkey % 97) AS owner_entry_id, (c_custkey % 100)::VARCHAR AS entry_key, 'w' || (c_custkey % 4) AS headword, (c_custkey % 3)::VARCHAR AS homonym FROM customer)
"""


def relation_rows(spark, d) -> tuple[DataFrame, DataFrame]:
    none = F.array().cast("array<string>")
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    name = F.expr(_DICT.format("o_orderkey"))
    cust = lambda m: s(F.col("o_custkey") % m)
    host = F.concat(F.lit("https://"), name, F.lit(".korean.go.kr/v"))
    lits = lambda *x: F.array(*map(F.lit, x))
    r = o.select(
        k.alias("relation_id"), name.alias("dictionary"), F.concat(F.lit("c"), s(k % 97)).alias("source_entry_id"),
        F.when(k % 11 == 0, none).when(k % 11 == 1, lits("a", "b")).otherwise(F.array(F.concat(F.lit(" t"), s(k % 5)))).alias("types"),
        F.when(k % 13 == 0, none).when(k % 13 == 1, lits("1", "2")).when(k % 13 == 2, lits(" ")).otherwise(F.array(cust(120))).alias("target_keys"),
        F.when(k % 7 == 0, none).when(k % 7 == 1, lits("x", "y")).when(k % 7 == 2, F.array(F.concat(F.lit("w"), cust(4), F.lit("012")))).otherwise(F.array(F.concat(F.lit("w"), cust(4)))).alias("words"),
        F.when(k % 5 == 0, F.array(cust(3))).otherwise(none).alias("homonyms"),
        F.when(k % 17 == 0, none).when(k % 17 == 1, lits("?")).when(k % 17 == 2, lits("품사")).when(k % 17 == 3, lits("의미")).otherwise(lits("어휘")).alias("units"),
        F.when(k % 4 == 0, F.array(F.concat(host, F.lit("?word_no="), cust(120), F.lit("&sense_no="), cust(121)))).when(k % 4 == 1, F.array(host)).otherwise(none).alias("urls"),
    )
    c, n = table(spark, d, "customer"), F.col("c_custkey")
    cands = c.select(
        F.expr(_DICT.format("c_custkey")).alias("dictionary"), F.when(n % 9 == 8, "sense").when(n % 9 == 7, "part_of_speech").otherwise("entry").alias("entity_kind"), s(n % 100).alias("native_key"),
        F.concat(F.lit("k"), s(n)).alias("canonical_id"), F.concat(F.lit("c"), s(n % 97)).alias("owner_entry_id"), s(n % 100).alias("entry_key"), F.concat(F.lit("w"), s(n % 4)).alias("headword"), s(n % 3).alias("homonym"),
    )
    return r, cands


_NARROW = "CASE WHEN {ask} AND len(list_filter({e}, lambda x: {test})) > 0 THEN list_filter({e}, lambda x: {test}) ELSE {e} END"
_MISS = "CASE WHEN {ask} AND len({e}) > 0 AND len(list_filter({e}, lambda x: {test})) = 0 THEN ['{text}'] ELSE []::VARCHAR[] END"
_URL = {"ask": "len(urls) = 1 AND dictionary = 'stdict' AND word_no IS NOT NULL", "test": "x.entry_key = word_no"}
_WORD = {"ask": "len(words) = 1", "test": "trim(words[1]) = x.headword OR (length(regexp_extract(trim(words[1]), '([0-9]*)$', 1)) IN (2, 3) AND left(trim(words[1]), length(trim(words[1])) - length(regexp_extract(trim(words[1]), '([0-9]*)$', 1))) = x.headword)"}
_HOM = {"ask": "dictionary = 'krdict' AND len(homonyms) = 1", "test": "x.homonym = trim(homonyms[1])"}
_RESOLVE_SQL = f"""
WITH {_RELATIONS_SQL},
k AS (SELECT r.*, CASE WHEN len(target_keys) = 1 THEN nullif(trim(target_keys[1]), '') END AS target_key,
 CASE WHEN dictionary <> 'stdict' THEN ['entry'] WHEN len(units) = 1 AND units[1] = '어휘' THEN ['entry'] WHEN len(units) = 1 AND units[1] = '품사' THEN ['part_of_speech'] WHEN len(units) = 1 AND units[1] = '의미' THEN ['sense'] ELSE ['entry', 'part_of_speech', 'common_pattern', 'sense'] END AS kinds,
 CASE WHEN len(urls) = 1 THEN nullif(regexp_extract(urls[1], 'word_no=([0-9]+)', 1), '') END AS word_no, CASE WHEN len(urls) = 1 THEN nullif(regexp_extract(urls[1], 'sense_no=([0-9]+)', 1), '') END AS sense_no FROM r),
f AS (SELECT k.relation_id, list(DISTINCT c) AS found FROM k JOIN c ON c.dictionary = k.dictionary AND list_contains(k.kinds, c.entity_kind) AND c.native_key = k.target_key GROUP BY 1),
a AS (SELECT k.*, coalesce(f.found, []) AS e0,
 list_filter([CASE WHEN len(types) <> 1 THEN 'relation type is missing or repeated' END, CASE WHEN len(target_keys) > 1 THEN 'target key is repeated' END,
  CASE WHEN dictionary = 'stdict' AND len(units) <> 1 THEN 'standard-dictionary target unit is missing, repeated, or unknown' END, CASE WHEN len(words) > 1 OR len(homonyms) > 1 THEN 'target label discriminator is repeated' END,
  CASE WHEN len(urls) = 1 AND dictionary = 'stdict' AND word_no IS NULL THEN 'standard-dictionary URL has no word_no' END,
  CASE WHEN len(urls) = 1 AND dictionary = 'opendict' AND sense_no IS NOT NULL AND target_key IS NOT NULL AND sense_no <> target_key THEN 'open-dictionary URL sense_no conflicts with target key' END,
  CASE WHEN len(urls) = 1 AND dictionary = 'opendict' AND sense_no IS NULL THEN 'open-dictionary URL has no sense_no' END], lambda x: x IS NOT NULL) AS c0 FROM k LEFT JOIN f USING (relation_id)),
b AS (SELECT *, {_NARROW.format(e="e0", **_URL)} AS e1, c0 || {_MISS.format(e="e0", text="URL word_no conflicts with target candidate owner", **_URL)} AS c1 FROM a),
g AS (SELECT *, {_NARROW.format(e="e1", **_WORD)} AS e2, c1 || {_MISS.format(e="e1", text="relation word conflicts with all keyed candidates", **_WORD)} AS c2 FROM b),
h AS (SELECT *, {_NARROW.format(e="e2", **_HOM)} AS e3, c2 || {_MISS.format(e="e2", text="relation homonym number conflicts with all keyed candidates", **_HOM)} AS c3 FROM g),
v AS (SELECT *, CASE WHEN len(c3) > 0 THEN 'ambiguous' WHEN target_key IS NULL OR len(e3) = 0 THEN 'unresolved' WHEN len(e3) = 1 AND e3[1].owner_entry_id = source_entry_id THEN 'self_reference' WHEN len(e3) = 1 THEN 'resolved' ELSE 'ambiguous' END AS status FROM h)
"""


@query(f"""WITH {_RELATIONS_SQL} SELECT relation_id, dictionary, (SELECT count(*) FROM c WHERE c.dictionary = r.dictionary AND c.entity_kind = 'entry' AND c.native_key = r.target_keys[1]) AS candidates
FROM r WHERE len(target_keys) = 1 AND dictionary <> 'stdict'""")
def relation_candidates(spark, d):
    r, c = relation_rows(spark, d)
    asked = r.where((F.size("target_keys") == 1) & (F.col("dictionary") != "stdict")).select("relation_id", "dictionary", F.get("target_keys", F.lit(0)).alias("native_key"))
    counts = c.where("entity_kind = 'entry'").groupBy("dictionary", "native_key").agg(F.count(F.lit(1)).alias("n"))
    return asked.join(counts, ["dictionary", "native_key"], "left").select("relation_id", "dictionary", F.coalesce("n", F.lit(0)).cast("bigint").alias("candidates"))


@query(_RESOLVE_SQL + """SELECT relation_id, dictionary, coalesce(CASE WHEN len(kinds) = 1 THEN dictionary || ':' || kinds[1] END, '') AS target_namespace, coalesce(target_key, '') AS target_key,
 array_to_string(list_sort(list_transform(e0, lambda x: x.canonical_id)), ' ') AS candidate_target_ids, status,
 CASE WHEN len(c3) > 0 THEN array_to_string(c3, '; ') WHEN target_key IS NULL THEN 'relation has no usable target key' WHEN len(e3) = 0 THEN 'no candidate exists in the declared dictionary and entity namespace'
  WHEN status = 'self_reference' THEN 'unique target resolves to the owning source entry' WHEN status = 'resolved' THEN 'one candidate matches key, target kind, URL, and available label discriminators'
  ELSE 'multiple candidates remain after applying authoritative discriminators' END AS reason,
 coalesce(CASE WHEN status IN ('resolved', 'self_reference') THEN e3[1].canonical_id END, '') AS target_id FROM v""")
def relation_resolution(spark, d):
    got = relations.resolve(*relation_rows(spark, d))
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return got.select("relation_id", "dictionary", blank("target_namespace"), blank("target_key"), F.array_join("candidate_target_ids", " ").alias("candidate_target_ids"), "status", "reason", blank("target_id"))


@query(_RESOLVE_SQL + """SELECT dictionary, count(*) AS relations, count(*) FILTER (status = 'resolved') AS resolved, count(*) FILTER (status = 'self_reference') AS self_reference, count(*) FILTER (status = 'unresolved') AS unresolved, count(*) FILTER (status = 'ambiguous') AS ambiguous FROM v GROUP BY dictionary""")
def relation_status_counts(spark, d):
    return relations.status_counts(relations.resolve(*relation_rows(spark, d)))


@query(_RESOLVE_SQL + "SELECT status, min(relation_id) AS first_relation, arg_min(source_entry_id, relation_id) AS source_entry_id FROM v GROUP BY status")
def status_evidence(spark, d):
    got = relations.resolve(*relation_rows(spark, d))
    return got.groupBy("status").agg(F.min("relation_id").alias("first_relation"), F.min_by("source_entry_id", "relation_id").alias("source_entry_id"))


@query(f"""WITH {_RELATIONS_SQL} SELECT dictionary, CASE len(types) WHEN 0 THEN '(missing)' WHEN 1 THEN trim(types[1]) ELSE '(multiple: ' || array_to_string(types, ' | ') || ')' END AS relation_type, count(*) AS relations FROM r GROUP BY 1, 2""")
def relation_type_counts(spark, d):
    return relations.type_counts(relation_rows(spark, d)[0])


# -- graph

_EDGES_SQL = """
e AS (SELECT s_suppkey AS a, (s_suppkey * 7 + s_nationkey) % 83 + 1 AS b FROM supplier UNION ALL SELECT s_suppkey, (s_suppkey + s_nationkey * 13) % 83 + 1 FROM supplier WHERE s_acctbal > 6000),
reach AS (SELECT DISTINCT a, b FROM e WHERE a <> b UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
pairs AS (SELECT x.a AS node, x.b AS other FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a AND x.a <> x.b),
comp AS (SELECT node, least(node, min(other)) AS component, count(DISTINCT other) + 1 AS members FROM pairs GROUP BY node)
"""


def graph_edges(spark, d) -> DataFrame:
    x = table(spark, d, "supplier")
    one = x.select(F.col("s_suppkey").alias("a"), ((F.col("s_suppkey") * 7 + F.col("s_nationkey")) % 83 + 1).alias("b"))
    return one.unionAll(x.where("s_acctbal > 6000").select("s_suppkey", (F.col("s_suppkey") + F.col("s_nationkey") * 13) % 83 + 1))


@query(f"WITH RECURSIVE {_EDGES_SQL} SELECT node, component, members FROM comp")
def scc_members(spark, d):
    return graph.strong_components(graph_edges(spark, d))


@query(f"WITH RECURSIVE {_EDGES_SQL} SELECT node, component, members FROM comp")
def scc_members_in_rounds(spark, d):
    """The same by the distributed rounds, which graphs of over graph.DRIVER_EDGES edges take."""
    return graph.strong_components(graph_edges(spark, d), driver_edges=0)


@query(f"""WITH RECURSIVE {_EDGES_SQL} SELECT component, max(members) AS members, (SELECT count(*) FROM e JOIN comp x ON e.a = x.node JOIN comp y ON e.b = y.node WHERE e.a <> e.b AND x.component = y.component AND x.component = comp.component) AS relation_edges,
 array_to_string(list_slice(list_sort(list(node)), 1, 10), ' ') AS sample FROM comp GROUP BY component""")
def cycle_summary(spark, d):
    edges = graph_edges(spark, d)
    got = graph.cycle_groups(edges, graph.strong_components(edges))
    return got.select("component", "members", "relation_edges", F.array_join(F.transform("sample", s), " ").alias("sample"))


# -- store


@query("""SELECT o_orderkey, o_orderstatus AS qname, count(l_orderkey) AS attributes, coalesce(string_agg('l' || l_linenumber || '=' || l_partkey, '|' ORDER BY l_linenumber, l_partkey), '') AS attrs,
 coalesce(bool_and(ok), true) AS contiguous FROM orders LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) = l_linenumber AS ok FROM lineitem) ON o_orderkey = l_orderkey GROUP BY 1, 2""")
def attribute_reassembly(spark, d):
    line = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    o = table(spark, d, "orders").join(line, "o_orderkey", "left")
    attrs = F.array_join(F.transform("x", lambda a: F.concat(F.lit("l"), s(a["l_linenumber"]), F.lit("="), s(a["l_partkey"]))), "|")
    steady = F.forall(F.transform("x", lambda a, i: a["l_linenumber"] == i + 1), lambda b: b)
    return o.select("o_orderkey", F.col("o_orderstatus").alias("qname"), F.coalesce(F.size("x"), F.lit(0)).cast("bigint").alias("attributes"), F.coalesce(attrs, F.lit("")).alias("attrs"), F.coalesce(steady, F.lit(True)).alias("contiguous"))


FKS = {
    "lineitem_orders": ("lineitem", "orders", [("l_orderkey", "o_orderkey")], "l_orderkey % 10 <> 3"),
    "lineitem_part": ("lineitem", "part", [("l_partkey", "p_partkey")], "p_partkey % 50 <> 7"),
    "lineitem_supplier": ("lineitem", "supplier", [("l_suppkey", "s_suppkey")], "true"),
    "orders_customer": ("orders", "customer", [("o_custkey", "c_custkey")], "c_mktsegment <> 'BUILDING'"),
    "customer_nation": ("customer", "nation", [("c_nationkey", "n_nationkey")], "n_nationkey < 20"),
    "nation_region": ("nation", "region", [("n_regionkey", "r_regionkey")], "true"),
}
FKS["lineitem_orders"] = ("lineitem", "orders", [("l_orderkey", "o_orderkey")], "o_orderkey % 10 <> 3")


@query(" UNION ALL ".join(f"SELECT '{n}' AS \"constraint\", count(*) AS violations FROM {c} WHERE {k[0][0]} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} WHERE {k[0][1]} = {k[0][0]} AND {w})" for n, (c, p, k, w) in FKS.items()))
def fk_violations(spark, d):
    return store.union_all([store.foreign_key(n, table(spark, d, c), table(spark, d, p).where(w), k) for n, (c, p, k, w) in FKS.items()])


RULES = {
    "orders": {"status_known": "o_orderstatus IN ('F', 'O')", "price_positive": "o_totalprice > 1000", "priority_not_blank": "o_orderpriority <> ''"},
    "lineitem": {"discount_in_range": "l_discount BETWEEN 0 AND 0.05", "line_positive": "l_linenumber >= 1", "flag_with_status": "(l_returnflag = 'N') = (l_linestatus = 'O')"},
    "customer": {"balance_not_negative": "c_acctbal >= 0", "name_form": "c_name LIKE 'Customer#%'"},
    "pages": {"url_relative": "url NOT LIKE '%..%'", "has_scheme": "url LIKE 'https://%'"},
}


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, '{n}' AS rule, count(*) FILTER (NOT ({x})) AS violations FROM {t}" for t, rules in RULES.items() for n, x in rules.items()))
def check_violations(spark, d):
    return store.union_all([store.check_rules(t, table(spark, d, t), {n: F.expr(x) for n, x in rules.items()}) for t, rules in RULES.items()])


@query("""
WITH ent AS (SELECT 'kweb:v1/c/stdict/entry/' || o_orderkey AS canonical_id, (o_orderkey % 8)::VARCHAR AS relative_path, 'entry' AS kind, CASE WHEN o_orderkey % 101 = 0 THEN 'kweb:v1/c/stdict/entry/1' END AS parent_id FROM orders
 UNION ALL SELECT CASE WHEN l_orderkey % 89 = 0 THEN 'bad/' ELSE 'kweb:v1/c/stdict/' END || 'entry/' || l_orderkey || '/sense/' || l_linenumber, ((l_orderkey + CASE WHEN l_orderkey % 97 = 0 THEN 1 ELSE 0 END) % 8)::VARCHAR, 'sense',
  CASE WHEN l_orderkey % 103 = 0 THEN NULL WHEN l_orderkey % 107 = 0 THEN 'gone' ELSE 'kweb:v1/c/stdict/entry/' || l_orderkey END FROM lineitem),
j AS (SELECT e.*, p.canonical_id AS known, p.relative_path AS parent_path FROM ent e LEFT JOIN ent p ON e.parent_id = p.canonical_id)
SELECT 'id_namespace' AS check_name, count(*) FILTER (NOT starts_with(canonical_id, 'kweb:v1/c/stdict/')) AS violations FROM j UNION ALL SELECT 'entry_has_parent', count(*) FILTER (kind = 'entry' AND parent_id IS NOT NULL) FROM j
UNION ALL SELECT 'nested_without_parent', count(*) FILTER (kind <> 'entry' AND parent_id IS NULL) FROM j UNION ALL SELECT 'parent_in_other_file', count(*) FILTER (known IS NOT NULL AND parent_path <> relative_path) FROM j
UNION ALL SELECT 'parent_missing', count(*) FILTER (parent_id IS NOT NULL AND known IS NULL) FROM j""")
def reference_checks(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    top = F.lit("kweb:v1/c/stdict/")
    k, n = F.col("o_orderkey"), F.col("l_orderkey")
    entry = o.select(F.concat(top, F.lit("entry/"), s(k)).alias("canonical_id"), s(k % 8).alias("relative_path"), F.lit("entry").alias("kind"), F.when(k % 101 == 0, F.concat(top, F.lit("entry/1"))).alias("parent_id"))
    parent = F.when(n % 103 == 0, F.lit(None)).when(n % 107 == 0, "gone").otherwise(F.concat(top, F.lit("entry/"), s(n)))
    sense = li.select(F.concat(F.when(n % 89 == 0, "bad/").otherwise(top), F.lit("entry/"), s(n), F.lit("/sense/"), s("l_linenumber")).alias("canonical_id"), s((n + F.when(n % 97 == 0, 1).otherwise(0)) % 8).alias("relative_path"), F.lit("sense").alias("kind"), parent.alias("parent_id"))
    return store.reference_checks(entry.unionByName(sense), top)


_OWNERS = """
ent AS (SELECT 'e' || o_orderkey AS canonical_id, CASE WHEN o_orderkey % 83 = 0 THEN 'k2' ELSE 'k1' END AS corpus_id, 'entry' AS entity_kind, NULL::VARCHAR AS parent_entry_id FROM orders
 UNION ALL SELECT 's' || l_orderkey || '.' || l_linenumber, CASE WHEN l_partkey % 61 = 0 THEN 'k2' ELSE 'k1' END, 'sense', 'e' || l_orderkey FROM lineitem),
own AS (SELECT *, CASE WHEN entity_kind = 'entry' THEN canonical_id ELSE parent_entry_id END AS owner FROM ent),
ep AS (SELECT CASE WHEN o_orderkey % 71 = 0 THEN 's' || o_orderkey || '.1' ELSE 'e' || o_orderkey END AS entry_id FROM orders),
tp AS (SELECT 'e' || (l_orderkey + CASE WHEN l_suppkey % 17 = 0 THEN 1 ELSE 0 END) AS entry_id, 's' || l_orderkey || '.' || l_linenumber AS entity_id FROM lineitem),
rel AS (SELECT l_orderkey * 10 + l_linenumber AS relation_id, 's' || l_orderkey || '.' || l_linenumber AS source_entity_id, CASE WHEN l_linenumber = 7 THEN 's' || l_orderkey || '.1' ELSE 'e' || l_orderkey END AS source_entry_id,
 CASE WHEN l_returnflag <> 'N' THEN 's' || l_orderkey || '.1' END AS resolved_target_id, CASE WHEN l_returnflag <> 'N' THEN 'e' || (l_orderkey + CASE WHEN l_returnflag = 'A' AND l_linenumber = 3 THEN 1 ELSE 0 END) END AS resolved_target_entry_id FROM lineitem),
cand AS (SELECT l_orderkey * 10 + l_linenumber AS relation_id, 'e' || (l_orderkey + 1) AS candidate_target_id FROM lineitem)
"""


@query(f"""WITH {_OWNERS}
SELECT 'entry_projection_owner' AS check_name, count(*) FILTER (e.entity_kind <> 'entry') AS violations FROM ep JOIN own e ON e.canonical_id = ep.entry_id
UNION ALL SELECT 'text_projection_owner', count(*) FILTER (e.entity_kind <> 'entry' OR o.corpus_id <> e.corpus_id OR tp.entry_id <> o.owner) FROM tp JOIN own e ON e.canonical_id = tp.entry_id JOIN own o ON o.canonical_id = tp.entity_id
UNION ALL SELECT 'relation_owner', count(*) FILTER (b.entity_kind <> 'entry' OR b.corpus_id <> a.corpus_id OR rel.source_entry_id <> a.owner
 OR (resolved_target_id IS NOT NULL AND (d.entity_kind <> 'entry' OR c.corpus_id <> a.corpus_id OR d.corpus_id <> a.corpus_id OR resolved_target_entry_id <> c.owner)))
 FROM rel JOIN own a ON a.canonical_id = source_entity_id JOIN own b ON b.canonical_id = source_entry_id LEFT JOIN own c ON c.canonical_id = resolved_target_id LEFT JOIN own d ON d.canonical_id = resolved_target_entry_id
UNION ALL SELECT 'candidate_corpus', count(*) FILTER (t.corpus_id <> a.corpus_id) FROM cand JOIN rel USING (relation_id) JOIN own a ON a.canonical_id = source_entity_id JOIN own t ON t.canonical_id = candidate_target_id""")
def owner_checks(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    ok, lk, ln = F.col("o_orderkey"), F.col("l_orderkey"), F.col("l_linenumber")
    entry = lambda k: F.concat(F.lit("e"), s(k))
    sense = lambda k, n: F.concat(F.lit("s"), s(k), F.lit("."), s(n))
    corpus = lambda odd: F.when(odd, "k2").otherwise("k1").alias("corpus_id")
    plus = lambda odd: lk + F.when(odd, 1).otherwise(0)
    flag = F.col("l_returnflag")
    entity = o.select(entry(ok).alias("canonical_id"), corpus(ok % 83 == 0), F.lit("entry").alias("entity_kind"), F.lit(None).cast("string").alias("parent_entry_id"))
    entity = entity.unionByName(li.select(sense(lk, ln).alias("canonical_id"), corpus(F.col("l_partkey") % 61 == 0), F.lit("sense").alias("entity_kind"), entry(lk).alias("parent_entry_id")))
    heads = o.select(F.when(ok % 71 == 0, sense(ok, F.lit(1))).otherwise(entry(ok)).alias("entry_id"))
    texts = li.select(entry(plus(F.col("l_suppkey") % 17 == 0)).alias("entry_id"), sense(lk, ln).alias("entity_id"))
    relation = li.select(
        (lk * 10 + ln).alias("relation_id"), sense(lk, ln).alias("source_entity_id"), F.when(ln == 7, sense(lk, F.lit(1))).otherwise(entry(lk)).alias("source_entry_id"),
        F.when(flag != "N", sense(lk, F.lit(1))).alias("resolved_target_id"), F.when(flag != "N", entry(plus((flag == "A") & (ln == 3)))).alias("resolved_target_entry_id"),
    )
    cands = li.select((lk * 10 + ln).alias("relation_id"), entry(lk + 1).alias("candidate_target_id"))
    return store.owner_checks(entity, heads, texts, relation, cands)


@query("SELECT r_name, n_name, c_name FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey ORDER BY r_regionkey, n_nationkey, c_custkey LIMIT 1")
def representative_entry(spark, d):
    first = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return first.orderBy("r_regionkey", "n_nationkey", "c_custkey").select("r_name", "n_name", "c_name").limit(1)


@query("""
WITH e AS (SELECT n_nationkey + 2 AS k, n_name AS x, n_regionkey AS y FROM nation WHERE n_nationkey < 20 UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey > 22), st AS (SELECT n_nationkey AS k, n_name AS x, n_regionkey AS y FROM nation)
SELECT coalesce(st.k, e.k) AS k, CASE WHEN st.k IS NULL THEN 'missing' WHEN e.k IS NULL THEN 'unexpected' ELSE 'changed' END AS verdict FROM st FULL JOIN e ON st.k = e.k WHERE st.k IS NULL OR e.k IS NULL OR st.x <> e.x OR st.y <> e.y""")
def expected_catalog_diff(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("x"), F.col("n_regionkey").alias("y"))
    expected = n.where("k < 20").withColumn("k", F.col("k") + 2).unionByName(n.where("k > 22"))
    return store.catalog_difference(n, expected, "k", ["x", "y"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_totalprice < 50000)")
def resume_pending(spark, d):
    o = table(spark, d, "orders")
    return store.pending(o.select("o_orderkey", "o_custkey"), o.where("o_orderstatus = 'F' OR o_totalprice < 50000"), "o_orderkey")


@query("""SELECT count(DISTINCT c_custkey // 500) AS files, count(*) AS entries, count(DISTINCT c_custkey) = count(*) AS unique_keys, min(c_name) FILTER (c_custkey = (SELECT min(c_custkey) FROM customer)) AS representative, count(*) FILTER (trim(c_name) = '') AS blank_headwords FROM customer""")
def ready_descriptor(spark, d):
    found = entities.entries(entities.with_entries(customer_records(spark, d)))
    one = found.agg(F.count_distinct("relative_path").alias("files"), F.count(F.lit(1)).alias("entries"), (F.count_distinct("native_key") == F.count(F.lit(1))).alias("unique_keys"), F.min_by("headword", F.struct("relative_path", "entry_ordinal")).alias("representative"), F.count_if(F.col("headword").isNull()).cast("bigint").alias("blank_headwords"))
    return one


@query("""SELECT 'krdict/' || lpad((c_custkey // 500)::VARCHAR, 6, '0') || '.xml' AS relative_path, row_number() OVER (PARTITION BY c_custkey // 500 ORDER BY c_custkey) AS entry_ordinal, c_custkey::VARCHAR AS native_key, c_name AS headword, c_nationkey::VARCHAR AS homonym,
 'kweb:v1/""" + COMMIT + """/krdict/entry/' || c_custkey AS canonical_id FROM customer""")
def entity_extraction(spark, d):
    inner = entities.with_entries(customer_records(spark, d))
    got = entities.identified(entities.entries(inner), entities.entities(inner), COMMIT)
    return got.select("relative_path", "entry_ordinal", "native_key", "headword", "homonym", "canonical_id")


# -- books


def document_fragments(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    volume = F.concat("source", F.lit("/"), s(F.floor(F.col("doc_id") / 1000)))
    entry = F.col("doc_id") % 5 != 0
    return docs.select(volume.alias("volume"), F.col("doc_id").alias("ordinal"), F.octet_length("text").alias("bytes"), entry.alias("is_entry"), F.when(entry, 3).otherwise(1).alias("records"), F.when(entry, F.col("doc_id")).alias("entry_number"))


_SPLIT = """
f AS (SELECT source || '/' || (doc_id // 1000) AS volume, doc_id AS ordinal, octet_length(encode(text)) AS bytes, doc_id % 5 <> 0 AS is_entry, CASE WHEN doc_id % 5 <> 0 THEN 3 ELSE 1 END AS records, row_number() OVER (PARTITION BY source, doc_id // 1000 ORDER BY doc_id) AS i FROM documents),
w AS (SELECT volume, ordinal, bytes, is_entry, records, i, 1 AS chapter, is_entry::INT AS ne, bytes AS nb FROM f WHERE i = 1
 UNION ALL SELECT f.volume, f.ordinal, f.bytes, f.is_entry, f.records, f.i, w.chapter + x.split::INT, CASE WHEN x.split THEN 0 ELSE w.ne END + f.is_entry::INT, CASE WHEN x.split THEN 0 ELSE w.nb END + f.bytes
 FROM w JOIN f ON f.volume = w.volume AND f.i = w.i + 1, LATERAL (SELECT (f.is_entry AND w.ne >= 7) OR w.nb + f.bytes > 20000 AS split) x)
"""


@query(f"WITH RECURSIVE {_SPLIT} SELECT volume, ordinal, chapter::BIGINT AS chapter FROM w")
def chapter_split(spark, d):
    return book.split_chapters(document_fragments(spark, d), 7, 20000).select("volume", "ordinal", "chapter")


@query(f"""WITH RECURSIVE {_SPLIT} SELECT volume, chapter::BIGINT AS chapter, sum(records)::BIGINT AS records, count(*) FILTER (is_entry) AS entries, sum(bytes)::BIGINT AS bytes,
 CASE WHEN count(*) FILTER (is_entry) > 0 THEN chapter || '장 · ' || min(ordinal) FILTER (is_entry) || '–' || max(ordinal) FILTER (is_entry) || '항목 (' || count(*) FILTER (is_entry) || '개)' ELSE chapter || '장 · 문서 레코드 ' || sum(records)::BIGINT || '개' END AS label
 FROM w GROUP BY volume, chapter""")
def chapter_nav(spark, d):
    return book.chapter_infos(book.split_chapters(document_fragments(spark, d), 7, 20000)).select("volume", "chapter", "records", "entries", "bytes", "label")


@query(f"""
WITH h AS (SELECT n_nationkey, lower(sha1(unhex('{C.BOOK_NAMESPACE.replace("-", "")}') || encode('krdict/krdict/' || n_name || '.xml'))) AS h FROM nation)
SELECT n_nationkey, 'urn:uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS identifier FROM h""")
def book_identifiers(spark, d):
    name = F.concat(F.lit("krdict/krdict/"), "n_name", F.lit(".xml"))
    return table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("urn:uuid:"), C.uuid5(C.BOOK_NAMESPACE, name)).alias("identifier"))


_DIV = """'<div class="xml-record ' || {css} || '" data-kdep-record="true" data-kdep-kind="' || {kind} || '" data-kdep-depth="' || depth || '" style="--xml-depth: ' || depth || '">' || {body} || '</div>' || chr(10)"""
_ATTR = """'<span class="xml-attribute"><code class="xml-attribute-name">' || split_part(p, '=', 1) || '</code><span class="xml-token">=&quot;</span><span class="xml-attribute-value">' || split_part(p, '=', 2) || '</span><span class="xml-token">&quot;</span></span>'"""
_BLOCK = f"""CASE WHEN kind = 'end_element' THEN {_DIV.format(css="'xml-end'", kind="'end'", body="'<span class=\"xml-token\">&lt;/</span><code class=\"xml-name\">' || qname || '</code><span class=\"xml-token\">&gt;</span>'")}
 ELSE {_DIV.format(css="CASE WHEN kind = 'start_element' THEN 'xml-start' ELSE 'xml-empty' END || CASE WHEN qname = 'Lemma' OR attrs LIKE 'att=writtenForm%' THEN ' semantic-headword' ELSE '' END", kind="CASE WHEN kind = 'start_element' THEN 'start' ELSE 'empty' END", body="'<span class=\"xml-token\">&lt;</span><code class=\"xml-name\">' || qname || '</code>' || CASE WHEN attrs = '' THEN '' ELSE array_to_string(list_transform(string_split(attrs, '|'), lambda p: " + _ATTR + "), '') END || '<span class=\"xml-token\">' || CASE WHEN kind = 'start_element' THEN '&gt;' ELSE '/&gt;' END || '</span>'")} END"""


@query(f"WITH {CUSTOMER_EVENTS} SELECT relative_path, record_ordinal::BIGINT AS record_ordinal, sha256({_BLOCK}) AS block_sha256 FROM ev")
def record_xhtml(spark, d):
    return customer_records(spark, d).select("relative_path", "record_ordinal", F.sha2(book.record_block(), 256).alias("block_sha256"))


@query(f"""WITH {CUSTOMER_EVENTS}, b AS (SELECT relative_path, record_ordinal, {_BLOCK} AS block FROM ev)
SELECT c.relative_path, c.i + 1 AS entry_ordinal, sha256('<article class="entry" id="entry-' || lpad((c.i + 1)::VARCHAR, 7, '0') || '">' || chr(10) || '<h2 class="entry-heading">' || c.c_name || '</h2>' || chr(10) || '<div class="entry-records">' || chr(10)
 || string_agg(block, '' ORDER BY record_ordinal) || '</div>' || chr(10) || '</article>' || chr(10)) AS fragment_sha256
FROM c JOIN b ON b.relative_path = c.relative_path AND b.record_ordinal BETWEEN 2 + 6 * c.i AND 7 + 6 * c.i GROUP BY c.relative_path, c.i, c.c_name""")
def entry_fragment_digest(spark, d):
    inner = entities.with_entries(customer_records(spark, d))
    heads = entities.entries(inner).select("relative_path", "entry_at", "entry_ordinal", "headword")
    got = book.entry_fragments(inner.join(heads, ["relative_path", "entry_at"]))
    return got.select("relative_path", "entry_ordinal", F.sha2("fragment", 256).alias("fragment_sha256"))


@query("""
WITH a AS (SELECT doc_id, sha256(text) AS h, length(text) AS n, lang FROM documents), b AS (SELECT doc_id, sha256(CASE WHEN doc_id % 50 = 0 THEN text || ' ' ELSE text END) AS h, length(CASE WHEN doc_id % 50 = 0 THEN text || ' ' ELSE text END) AS n, CASE WHEN doc_id % 70 = 0 THEN 'xx' ELSE lang END AS lang FROM documents),
j AS (SELECT a.h = b.h AS record_sha256, a.n = b.n AS chars, a.lang = b.lang AS metadata_language FROM a JOIN b USING (doc_id))
SELECT 'record_sha256' AS name, count(*) FILTER (record_sha256) AS passed, count(*) FILTER (NOT record_sha256) AS failed FROM j UNION ALL SELECT 'chars', count(*) FILTER (chars), count(*) FILTER (NOT chars) FROM j UNION ALL SELECT 'metadata_language', count(*) FILTER (metadata_language), count(*) FILTER (NOT metadata_language) FROM j""")
def audit_checks(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    changed = docs.select("doc_id", F.when(F.col("doc_id") % 50 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")).alias("text"), F.when(F.col("doc_id") % 70 == 0, "xx").otherwise(F.col("lang")).alias("lang"))
    facts = lambda x, p: x.select("doc_id", F.sha2("text", 256).alias(f"{p}h"), F.length("text").alias(f"{p}n"), F.col("lang").alias(f"{p}l"))
    both = facts(docs, "a").join(facts(changed, "b"), "doc_id")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), (F.col(f"a{c}") == F.col(f"b{c}")).alias("ok")) for n, c in (("record_sha256", "h"), ("chars", "n"), ("metadata_language", "l"))]))
    return both.select(each.alias("x")).groupBy("x.name").agg(F.count_if("x.ok").cast("bigint").alias("passed"), F.count_if(~F.col("x.ok")).cast("bigint").alias("failed"))


@query("""
WITH v AS (SELECT lang || '/' || source AS corpus, CASE WHEN l.doc_id IS NULL THEN 'unprocessed' WHEN toxic = 1 THEN 'failed' ELSE 'passed' END AS status, CASE WHEN quality = 1 THEN n_chars END AS entries FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT corpus, count(*) FILTER (status <> 'unprocessed') AS processed, count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'unprocessed') AS unprocessed, coalesce(sum(entries), 0)::BIGINT AS entries,
 CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN 'failed' WHEN count(*) FILTER (status = 'unprocessed') > 0 THEN 'partial' ELSE 'passed' END AS status FROM v GROUP BY corpus""")
def corpus_rollup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    status = F.when(F.col("quality").isNull(), "unprocessed").when(F.col("toxic") == 1, "failed").otherwise("passed")
    return batch.rollup(docs.select(F.concat("lang", F.lit("/"), "source").alias("corpus"), status.alias("status"), F.when(F.col("quality") == 1, F.col("n_chars")).alias("entries")))


@query("""SELECT 'nation' AS table_name, sha256(string_agg(n_nationkey || ',' || n_name || ',' || n_regionkey || chr(10), '' ORDER BY n_nationkey)) AS dump_sha256, count(*) AS n_rows FROM nation UNION ALL SELECT 'region', sha256(string_agg(r_regionkey || ',' || r_name || chr(10), '' ORDER BY r_regionkey)), count(*) FROM region""")
def logical_dump(spark, d):
    def dump(name, cols):
        line = F.concat(F.concat_ws(",", *[s(c) for c in cols]), F.lit("\n"))
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(cols[0], line.alias("l")))), lambda x: x["l"]), "")
        return table(spark, d, name).agg(F.sha2(text, 256).alias("dump_sha256"), F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "dump_sha256", "n_rows")

    return dump("nation", ["n_nationkey", "n_name", "n_regionkey"]).unionByName(dump("region", ["r_regionkey", "r_name"]))


@query("""
WITH o AS (SELECT 'table' AS type, r_name AS name, r_name AS tbl_name, 'CREATE TABLE ' || r_name AS sql FROM region), t AS (SELECT type, name, array_to_string(list_transform([type, name, tbl_name, sql], lambda x: printf('%016x', octet_length(encode(x))) || hex(encode(x))), '') AS tok FROM o)
SELECT sha256(unhex(hex(encode('recordloom/schema-fingerprint/v1')) || '00' || string_agg(tok, '' ORDER BY type, name))) AS fingerprint FROM t""")
def schema_fingerprint(spark, d):
    objects = table(spark, d, "region").select(F.lit("table").alias("type"), F.col("r_name").alias("name"), F.col("r_name").alias("tbl_name"), F.concat(F.lit("CREATE TABLE "), "r_name").alias("sql"))
    return digest.schema_fingerprint(objects, C.FINGERPRINT_PREAMBLE)


def built_store(spark: SparkSession, d: str) -> store.Store:
    """A store of the customers' files, imported and ready, in the shared folder."""
    files = cut(customer_files(spark, d), "files")
    made = store.Store.begin(spark, scratch(spark, "store"), COMMIT)
    made.add(files)
    made.finalize(files)
    return made


@query(f"""WITH {CUSTOMER_EVENTS} SELECT relative_path, count(*) AS records, count(*) FILTER (qname = 'LexicalEntry' AND kind = 'start_element') AS entries, sum(CASE attrs WHEN '' THEN 0 ELSE 2 END)::BIGINT AS attributes FROM ev GROUP BY relative_path""")
def store_import(spark, d):
    """Rows of a store that an import made: its files with their records, entries and attributes."""
    made = built_store(spark, d)
    attributes = made.table("source_attribute").groupBy("relative_path").agg(F.count(F.lit(1)).alias("attributes"))
    return made.completed().join(attributes, "relative_path", "left").select("relative_path", "records", "entries", F.coalesce("attributes", F.lit(0).cast("bigint")).alias("attributes"))


@query(f"""WITH c AS (SELECT 'krdict/' || lpad((c_custkey // 500)::VARCHAR, 6, '0') || '.xml' AS relative_path, row_number() OVER (PARTITION BY c_custkey // 500 ORDER BY c_custkey) AS entry_ordinal, * FROM customer)
SELECT 'kweb:v1/{COMMIT}/krdict/entry/' || c_custkey AS canonical_id, c_custkey::VARCHAR AS native_key, relative_path, entry_ordinal, c_name AS headword, c_nationkey::VARCHAR AS homonym FROM c""")
def store_entries(spark, d):
    """Entries of a store with what its projection says of them."""
    made = built_store(spark, d)
    return made.table("entity").join(made.table("entry_projection"), ["relative_path", "entry_ordinal"]).select("canonical_id", "native_key", "relative_path", "entry_ordinal", "headword", "homonym")


@query()
def strict_xml_quarantine(spark, d):
    """Raw web pages are no XML: each that isn't well-formed is one row of kind error."""
    pages = table(spark, d, "pages").select(F.concat(F.lit("page/"), s("page_id")).alias("relative_path"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content"))
    return xml_records.scan(pages, strict=False).groupBy("relative_path").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("kind") == "error").cast("bigint").alias("errors"))


@query("SELECT 'krdict/' || lpad((c_custkey // 500)::VARCHAR, 6, '0') || '.xml' AS relative_path, 'passed' AS status, count(*) AS entries, '[]' AS failed_checks FROM customer GROUP BY c_custkey // 500")
def epub_roundtrip(spark, d):
    """Build each volume's book, read it back and audit it against its source."""
    files = customer_files(spark, d)
    volumes = catalog.volumes(files.select(F.lit("krdict").alias("dictionary"), "relative_path"))
    return batch.batch(volumes.join(files, "relative_path")).select("relative_path", "status", "entries", "failed_checks")
