import hashlib
import io
import os
import re
import struct
import zipfile

import pytest

from recordloom.functions import columns as C
from recordloom.operators import audit, book, digest, entities, graph, relations, store
from recordloom.sources import catalog, xml_records

KR = """<?xml version="1.0"?><!DOCTYPE LexicalResource><LexicalResource xmlns:f="urn:f"><Lexicon>
<LexicalEntry att="id" val="0001"><feat att="homonym_number" val="1"/><Lemma><feat att="writtenForm" val=" 가나 "/></Lemma>
 <Sense att="id" val="1"><SenseRelation><feat att="type" val="관련"/><feat att="id" val="2"/><feat att="lemma" val="다라"/></SenseRelation></Sense><Sense att="id" val="9"/>
 <f:mark tone="&lt;high\x08" f:rank="12"/>before<i></i>after<![CDATA[ <&> ]]><!-- aside --> last</LexicalEntry>
<LexicalEntry id="2"><Lemma><feat att="writtenForm" val="다라"/></Lemma><Sense att="id" val="1"><SenseRelation><feat att="type" val="역"/><feat att="id" val="0001"/><feat att="lemma" val="가나"/></SenseRelation></Sense></LexicalEntry>
<LexicalEntry/></Lexicon></LexicalResource>""".encode()
ST = "<channel><item><target_code>0010</target_code><word_info><word>본</word><pos_info><pos_code>1</pos_code><sense_info><sense_code>11</sense_code><lexical_info><word>본</word><unit>의미</unit><type>t</type><link_target_code>11</link_target_code></lexical_info></sense_info></pos_info></word_info></item></channel>".encode()


def files(spark, **contents):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in contents.items()], "relative_path string, content binary")


def test_kinds_and_order():
    got = [(r[0], r[1], r[2] if r[2] is not None else r[3]) for r in xml_records.parse(b"<a x='1'> <b/>t<c></c>u<d>v</d> </a>")]
    assert got == [("start_element", 0, "a"), ("empty_element", 1, "b"), ("tail_text", 1, "t"), ("start_element", 1, "c"), ("end_element", 1, "c"), ("tail_text", 1, "u"), ("start_element", 1, "d"), ("element_text", 1, "v"), ("end_element", 1, "d"), ("end_element", 0, "a")]


@pytest.mark.parametrize("bad", [b'<!DOCTYPE a [<!ENTITY e "boo">]><a x="&e;"/>', b'<!DOCTYPE a [<!ENTITY e "boo">]><a>&e;</a>', b"<a>", b"<a></b>", b"<a/>x", b"<a>&nope;</a>", b"<a x='1' x='2'/>", b"", b"<a>&#8;</a>"])
def test_malformed(bad):
    with pytest.raises(xml_records.SourceError):
        list(xml_records.parse(bad))


def test_controls_and_marks_come_back():
    value = "".join(map(chr, C.CONTROLS)) + "x"
    got = list(xml_records.parse(f"<a v=\"{value}\">{value}</a>".encode()))
    assert got[0][4][0]["value"] == value and got[1][3] == value


def test_unicode_white_space_is_dropped_but_separators_stay():
    assert len(list(xml_records.parse("<a>　 \x85</a>".encode()))) == 2
    assert len(list(xml_records.parse("<a>\x1c</a>".encode()))) == 3


def _plain_digest(data):
    sha = hashlib.sha256(C.DIGEST_PREAMBLE.encode() + b"\0")
    u = lambda s: struct.pack(">Q", len(s.encode())) + s.encode()
    for kind, depth, name, text, attributes, *_ in xml_records.parse(data):
        sha.update(bytes([int(digest.TAGS[kind])]) + struct.pack(">Q", depth) + u(name if name is not None else text))
        if kind in ("start_element", "empty_element"):
            sha.update(struct.pack(">Q", len(attributes)) + b"".join(u(a["name"]) + u(a["value"]) for a in attributes))
    return sha.hexdigest()


def test_digests_agree(spark):
    records = xml_records.scan(files(spark, **{"krdict/1.xml": KR, "stdict/1.xml": ST}))
    want = {("krdict/1.xml", _plain_digest(KR)), ("stdict/1.xml", _plain_digest(ST))}
    for f in (digest.canonical_digest, digest.canonical_digest_collected):
        assert {(r.relative_path, r.record_sha256) for r in f(records).collect()} == want
    one = audit.summary(list(audit.source_records(KR)), [])
    assert one["record_sha256"] == _plain_digest(KR) and one["record_counts"]["control_characters"] == 1
    counts = digest.record_counts(records).where("relative_path = 'krdict/1.xml'").first().asDict()
    assert {k: counts[k] for k in one["record_counts"]} == one["record_counts"]


def test_permissive_scan_keeps_an_error_row(spark):
    got = xml_records.scan(files(spark, **{"a/1.xml": b"<a/>", "a/2.xml": b"<a>"}), strict=False).collect()
    assert sorted((r.relative_path, r.kind) for r in got) == [("a/1.xml", "empty_element"), ("a/2.xml", "error")]


def test_entities_and_relations(spark):
    inner = entities.with_entries(xml_records.scan(files(spark, **{"krdict/1.xml": KR, "stdict/1.xml": ST}))).cache()
    found = entities.entries(inner)
    assert {(r.dictionary, r.native_key, r.headword, r.homonym, r.entry_ordinal) for r in found.collect()} == {("krdict", "0001", "가나", "1", 1), ("krdict", "2", "다라", None, 2), ("stdict", "0010", "본", None, 1)}
    named = entities.identified(found, entities.entities(inner), "c").cache()
    got = {(r.dictionary, r.entity_kind, r.native_key) for r in named.collect()}
    assert ("stdict", "part_of_speech", "1") in got and ("stdict", "sense", "11") in got and ("krdict", "sense", "9") not in got
    assert named.where("canonical_id = 'kweb:v1/c/krdict/entry/0001/sense/1'").count() == 1
    assert named.where("entity_kind = 'sense' and dictionary = 'stdict'").first().locator == "stdict:stdict/1.xml#entry=1/pos=1/sense=1"
    rel = entities.relations(inner).join(named.where("entity_at = entry_at").select("relative_path", "entry_at", "canonical_id"), ["relative_path", "entry_at"]).withColumnRenamed("canonical_id", "source_entry_id")
    rel = rel.selectExpr("concat(relative_path, '#', relation_at) as relation_id", "dictionary", "source_entry_id", "types", "target_keys", "words", "homonyms", "units", "urls")
    out = {(r.dictionary, r.types[0]): (r.status, r.target_key, r.target_namespace) for r in relations.resolve(rel, named).collect()}
    assert out == {("krdict", "관련"): ("resolved", "2", "krdict:entry"), ("krdict", "역"): ("resolved", "0001", "krdict:entry"), ("stdict", "t"): ("self_reference", "11", "stdict:sense")}


@pytest.mark.parametrize("driver_edges", [0, 1000])
def test_strong_components(spark, driver_edges):
    pairs = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (5, 5), (6, 6), (7, 8), (8, 9), (9, 10), (10, 7), (2, 7), (2, 1)]
    edges = spark.createDataFrame(pairs, "a bigint, b bigint")
    got = graph.strong_components(edges, driver_edges)
    assert {(r.node, r.component, r.members) for r in got.collect()} == {(1, 1, 3), (2, 1, 3), (3, 1, 3), (4, 4, 2), (5, 4, 2), (7, 7, 4), (8, 7, 4), (9, 7, 4), (10, 7, 4)}
    assert {(r.component, r.relation_edges) for r in graph.cycle_groups(edges, got).collect()} == {(1, 4), (4, 2), (7, 4)}


def test_book_passes_its_audit_and_mutations_fail():
    data, info = book.build_book("krdict", "krdict/1.xml", 1, 2, KR, max_entries=1)
    assert book.build_book("krdict", "krdict/1.xml", 1, 2, KR, max_entries=1)[0] == data and info["entries"] == 3 and info["chapters"] == 3
    good = audit.compare("krdict", "krdict/1.xml", 1, 2, f"{C.FILE_PREFIXES['krdict']}-001-of-002.epub", KR, data)
    assert [c["name"] for c in good] == audit.CHECKS and all(c["passed"] for c in good), [c for c in good if not c["passed"]]

    def failing(change):
        """The checks that fail after change(member's name, text) on the first page that it alters."""
        out, altered = io.BytesIO(), False
        with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(out, "w") as w:
            for name in z.namelist():
                text = z.read(name).decode()
                new = text if altered else change(name, text)
                altered |= new != text
                w.writestr(name, new)
        assert altered
        return {c["name"] for c in audit.compare("krdict", "krdict/1.xml", 1, 2, f"{C.FILE_PREFIXES['krdict']}-001-of-002.epub", KR, out.getvalue()) if not c["passed"]}

    page = lambda old, new: lambda name, text: text.replace(old, new, 1) if "/chapter-" in name else text
    package = lambda old, new: lambda name, text: text.replace(old, new, 1) if name.endswith(".opf") else text
    assert failing(page("after", "afer")) == {"record_sha256"}
    assert failing(page("U+0008", "U+000B")) == {"record_sha256"}
    assert "record_counts" in failing(page("xml-tail-value", "xml-other-value")) | failing(page('data-kdep-kind="tail"', 'data-kdep-kind="text"'))
    assert {"headword_sha256", "last_headword"} <= failing(lambda name, text: text.replace("entry-heading", "other", 1) if "chapter-0003" in name else text)
    assert failing(package("<dc:language>ko", "<dc:language>en")) == {"metadata_language"}
    assert failing(package('"group-position">1', '"group-position">2')) == {"metadata_group_position"}
    for bad in (package('<itemref idref="part-2"/>', '<itemref idref="gone"/>'), lambda name, text: re.sub("<itemref[^>]*>", "", text) if name.endswith(".opf") else text):
        with pytest.raises(ValueError, match="spine"):
            failing(bad)
    other = book.build_book("krdict", "krdict/1.xml", 1, 2, KR, preamble="another/v2")[1]
    assert other["sha256"] != info["sha256"]


def test_book_documents_are_xml():
    z = zipfile.ZipFile(io.BytesIO(book.build_book("stdict", "stdict/a&b.xml", 1, 1, ST)[0]))
    for name in z.namelist()[1:]:
        if not name.endswith(".css"):
            list(xml_records.parse(z.read(name)))
    nav = z.read("EPUB/nav.xhtml").decode()
    assert 'epub:type="landmarks"' in nav and "<dc:creator>" in z.read("EPUB/package.opf").decode() and C.DIGEST_PREAMBLE in z.read("EPUB/text/title.xhtml").decode()


def test_scan_in_chunks(monkeypatch):
    body = "".join(f"<e n='{k}'>t{k}<f/>u<g></g></e>" for k in range(400))
    data = f"<r>{body}</r>".encode()
    whole = list(xml_records.parse(data))
    assert len(whole) == 2 + 400 * 7
    for size in (1, 7, 100):
        monkeypatch.setattr(xml_records, "CHUNK", size)
        assert list(xml_records.parse(data)) == whole


def test_restore_is_the_inverse(spark):
    values = ["", "x", "\uE000", "\uE000\uE000\uE018", "\U0010FFFF", "a\x08b\uE000\x0b", "\uE000\uE000"]
    d = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in d.select(C.restore(C.sanitize("v"))).collect()] == values
    for broken in ("\uE000", "a\uE000x", "\uE000\uE000\uE000"):
        with pytest.raises(Exception, match="invalid control escape"):
            spark.createDataFrame([(broken,)], "v string").select(C.restore("v")).collect()


GOOD = KR.replace(b"<LexicalEntry/>", b"")


def test_store_life_cycle(spark, tmp_path):
    some = files(spark, **{"krdict/1.xml": GOOD, "stdict/1.xml": ST})
    root, commit = f"file://{tmp_path}/store", "0" * 40
    s = store.Store.begin(spark, root, commit)
    assert s.add(some.where("relative_path LIKE 'krdict%'")).count() == 1
    with pytest.raises(store.StoreError, match="pending"):
        s.finalize(some)
    with pytest.raises(store.StoreError, match="exists"):
        store.Store.begin(spark, root, commit)
    with pytest.raises(store.StoreError, match="another commit"):
        store.Store.begin(spark, root, "1" * 40, "resume")
    with pytest.raises(store.StoreError, match="no store"):
        store.Store.begin(spark, f"file://{tmp_path}/none", commit, "rebuild")
    s = store.Store.begin(spark, root, commit, "resume")
    before = {r.relative_path: r.batch for r in s.table("source_file").collect()}
    held = os.listdir(f"{tmp_path}/store/source_record")
    assert s.add(some).count() == 2
    assert {r.relative_path: r.batch for r in s.table("source_file").collect()}.items() > before.items()
    assert set(os.listdir(f"{tmp_path}/store/source_record")) > set(held)
    written = os.listdir(f"{tmp_path}/store/source_record")
    assert s.add(some).count() == 2 and os.listdir(f"{tmp_path}/store/source_record") == written
    with pytest.raises(store.StoreError, match="aren't those that were imported"):
        s.add(files(spark, **{"krdict/1.xml": GOOD + b"\n"}))
    assert s.finalize(some) == {"commit": commit, "state": "ready", "source_files": 2, "entries": 3}
    assert s.descriptor()["state"] == "ready"
    for again in (lambda: s.add(some), lambda: store.Store.begin(spark, root, commit, "resume")):
        with pytest.raises(store.StoreError, match="ready already"):
            again()


def test_store_takes_whole_files_only(spark, tmp_path):
    """Faulty files are named and leave no row; the others of their batch are in."""
    entry = b"<LexicalEntry att='id' val='%d'><Lemma><feat att='writtenForm' val='w'/></Lemma></LexicalEntry>"
    bad = {
        "krdict/2.xml": (b"<r><LexicalEntry><Lemma/></LexicalEntry></r>", "no key"),
        "krdict/3.xml": (b"<r><LexicalEntry/></r>", "an empty entry"),
        "krdict/4.xml": (b"<r>" + entry.replace(b"<Lemma>", b"<Lemma><LexicalEntry></LexicalEntry>") % 1 + b"</r>", "within an entry"),
        "krdict/5.xml": (b"<r>" + entry % 1, "malformed"),
        "krdict/6.xml": (b"<r>" + entry % 1 + entry % 1 + b"</r>", "one key"),
    }
    s = store.Store.begin(spark, f"file://{tmp_path}/store", "a" * 40)
    with pytest.raises(store.StoreError) as e:
        s.add(files(spark, **{"krdict/1.xml": GOOD, **{k: v for k, (v, _) in bad.items()}}))
    told = dict(x.split(": ", 1) for x in str(e.value).split("; "))
    assert sorted(told) == sorted(bad)
    for name, (_, fault) in bad.items():
        assert fault in told[name]
    for name in store.TABLES:
        assert {r.relative_path for r in s.table(name).select("relative_path").distinct().collect()} == {"krdict/1.xml"}, name
    assert s.checks().where("violations > 0").isEmpty()
    # a run that is lost ahead of its last write leaves rows that nobody sees, and the next takes its files again
    whole = s.table("entity").count()
    os.rename(f"{tmp_path}/store/source_file", f"{tmp_path}/lost")
    assert s.table("entity").isEmpty() and s.add(files(spark, **{"krdict/1.xml": GOOD})).count() == 1
    assert s.table("entity").count() == whole


def test_store_checks_find_damage(spark, tmp_path):
    s = store.Store.begin(spark, f"file://{tmp_path}/store", "a" * 40)
    some = files(spark, **{"krdict/1.xml": GOOD, "stdict/1.xml": ST})
    s.add(some)
    batch = s.table("source_file").first().batch
    rows = spark.createDataFrame([("other/id", "krdict", "entry", "k", "krdict/1.xml", 99, "l", None), ("other/id", "krdict", "word", "k2", "krdict/1.xml", 99, "l", "x")], store.TABLES["entity"])
    rows.write.mode("append").parquet(f"{s.root}/entity/batch={batch}")
    spark.createDataFrame([("krdict/1.xml", 98, "", "1")], store.TABLES["entry_projection"]).write.mode("append").parquet(f"{s.root}/entry_projection/batch={batch}")
    got = {r.constraint: r.violations for r in s.checks(some).where("violations > 0").collect()}
    assert got == {"entity.id": 2, "entity.kind": 1, "entity.unique(canonical_id)": 1, "entity.unique(locator)": 1, "entry_projection.headword": 1, "projection_of_entry": 1, "source_file.sums": 1}
    with pytest.raises(store.StoreError, match="entity.id: 2"):
        s.finalize(some)


def test_store_rebuild_takes_the_old_place_when_ready(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    one, two = files(spark, **{"krdict/1.xml": GOOD}), files(spark, **{"stdict/1.xml": ST})
    s = store.Store.begin(spark, root, "a" * 40)
    s.add(one)
    s.finalize(one)
    left = store.Store.begin(spark, root, "b" * 40, "rebuild")
    left.add(two)
    assert store.Store(spark, root, "a" * 40).descriptor()["source_files"] == 1
    with pytest.raises(store.StoreError, match="another rebuild"):
        store.Store.begin(spark, root, "b" * 40, "rebuild")
    left.abandon()
    new = store.Store.begin(spark, root, "b" * 40, "rebuild")
    new.add(two)
    with pytest.raises(store.StoreError, match="pending"):
        new.finalize(one.union(two))
    new.finalize(two)
    assert os.listdir(tmp_path) == ["store"]
    assert [r.relative_path for r in store.Store(spark, root, "b" * 40).completed().collect()] == ["stdict/1.xml"]
    with pytest.raises(store.StoreError, match="another commit"):
        store.Store(spark, root, "a" * 40).descriptor()


def test_catalog(spark, tmp_path):
    for p in ("krdict/002.xml", "krdict/001.xml", "krdict/x.txt", "other/1.xml"):
        os.makedirs(tmp_path / os.path.dirname(p), exist_ok=True)
        (tmp_path / p).write_text("<a/>")
    os.symlink(tmp_path / "krdict/001.xml", tmp_path / "krdict/003.xml")
    got = catalog.discover(spark, str(tmp_path), ["krdict", "stdict"])
    assert [r.relative_path for r in got.collect()] == ["krdict/001.xml", "krdict/002.xml"]
    assert got.where(catalog.layout_ok("relative_path", ["krdict"])).count() == 2


def test_queries_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from recordloom.plans import queries

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages labels".split():
        c.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    for name, q in queries.QUERIES.items():
        got = q(spark, d)
        cols = sorted(got.columns)
        rows = sorted(repr(tuple(r[k] for k in cols)) for r in got.collect())
        if name in queries.SQL:
            want = c.sql(queries.SQL[name])
            assert cols == sorted(want.columns), name
            assert rows == sorted(map(repr, want.select(*[f'"{k}"' for k in cols]).fetchall())), name


def test_relations_dont_carry_their_candidates_through_a_shuffle(spark):
    """alike candidates of a key count as one group with its number, and nothing is grouped by relation."""
    five = [("1", "w", "1"), ("1", "w", "2"), ("2", "v", "1")]
    rows = [("stdict", kind, "7", f"k{n}", f"o{n}", *five[n % 3]) for n in range(9) for kind in (["entry"] if n else ["entry", "sense"])]
    rows += [rows[1], ("stdict", "entry", "8", "only", "o9", "1", "w", "1"), ("krdict", "entry", "7", "x", "ox", "1", "w", "1")]
    candidates = spark.createDataFrame(rows, "dictionary string, entity_kind string, native_key string, canonical_id string, owner_entry_id string, entry_key string, headword string, homonym string")
    url = "https://stdict.korean.go.kr/v?word_no="
    asked = [
        (1, "stdict", "s", ["t"], ["7"], [], [], ["어휘"], []),
        (2, "stdict", "s", ["t"], ["7"], [], [], ["의미"], []),
        (3, "stdict", "o9", ["t"], [" 8 "], ["w"], [], ["어휘"], [url + "1"]),
        (4, "stdict", "s", ["t"], ["7"], ["z"], [], ["어휘"], []),
        (5, "stdict", "s", ["t"], [" "], [], [], ["어휘"], []),
        (6, "krdict", "s", ["t"], ["7"], ["w"], ["1"], [], []),
        (7, "stdict", "s", ["t"], ["7"], [], [], [], []),
    ]
    asked = spark.createDataFrame(asked, "relation_id bigint, dictionary string, source_entry_id string, types array<string>, target_keys array<string>, words array<string>, homonyms array<string>, units array<string>, urls array<string>")
    got = relations.resolve(asked, candidates)
    found = {r.relation_id: (r.status, r.candidate_target_ids, r.target_id) for r in got.collect()}
    every = [f"k{n}" for n in range(9)]
    assert found == {1: ("ambiguous", every, None), 2: ("resolved", ["k0"], "k0"), 3: ("self_reference", ["only"], "only"), 4: ("ambiguous", every, None), 5: ("unresolved", [], None), 6: ("resolved", ["x"], "x"), 7: ("ambiguous", every, None)}
    assert not re.search(r"Aggregate \[relation_id", got._jdf.queryExecution().optimizedPlan().toString())


def test_volumes_from_a_thousand_on(spark):
    """a number of four digits stays whole in the name of the book, which its audit compares."""
    paths = spark.range(1001).selectExpr("'krdict' AS dictionary", "concat('krdict/', lpad(id, 6, '0'), '.xml') AS relative_path")
    last = catalog.volumes(paths).orderBy("relative_path").collect()[-1]
    assert (last.volume_number, last.output_filename) == (1001, "01-한국어기초사전-1001-of-1001.epub")
    made, _ = book.build_book("krdict", last.relative_path, 1001, 1001, KR)
    assert all(x["passed"] for x in audit.compare("krdict", last.relative_path, 1001, 1001, last.output_filename, KR, made))


def test_store_import_is_dealt_to_tasks_by_bytes(spark, tmp_path, monkeypatch):
    """F6, F8: shuffles have parts by the files' bytes, and the last table's single file doesn't make one task do it all."""
    monkeypatch.setattr(store, "TASK_BYTES", 400)
    monkeypatch.setattr(type(spark.range(1)), "coalesce", None)
    parts = []
    whole = store.rebuilt
    monkeypatch.setattr(store, "rebuilt", lambda records, attributes, n: parts.append((n, whole(records, attributes, n).rdd.getNumPartitions())) or whole(records, attributes, n))
    made = store.Store.begin(spark, f"file://{tmp_path}/s", "0" * 40)
    got = {r.relative_path: (r.record_sha256, r.entries) for r in made.add(files(spark, **{"stdict/1.xml": ST, "stdict/2.xml": ST.replace(b"0010", b"11")})).collect()}
    n = (2 * len(ST) - 2) // 400 + 1
    assert parts == [(n, n)] and n > 1
    assert got == {"stdict/1.xml": (_plain_digest(ST), 1), "stdict/2.xml": (_plain_digest(ST.replace(b"0010", b"11")), 1)}


def test_owner_checks_have_parts_by_rows(spark, monkeypatch):
    """joins get parts by the number of rows, and relations without a target don't all meet in one."""
    monkeypatch.setattr(store, "TASK_ROWS", 20)
    entity = spark.range(60).selectExpr("concat('e', id) AS canonical_id", "'k1' AS corpus_id", "'entry' AS entity_kind", "cast(NULL AS string) AS parent_entry_id")
    relation = spark.range(60).selectExpr("id AS relation_id", "concat('e', id) AS source_entity_id", "concat('e', id) AS source_entry_id", "if(id < 0, 'e0', NULL) AS resolved_target_id", "if(id < 0, 'e0', NULL) AS resolved_target_entry_id")
    got = store.owner_checks(entity, entity.selectExpr("canonical_id AS entry_id"), entity.selectExpr("canonical_id AS entry_id", "canonical_id AS entity_id"), relation, relation.selectExpr("relation_id", "source_entry_id AS candidate_target_id"))
    assert {r.check_name: r.violations for r in got.collect()} == dict.fromkeys(("entry_projection_owner", "text_projection_owner", "relation_owner", "candidate_corpus"), 0)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"RepartitionByExpression \[target_id#\d+, spot#\d+L?\], 4", plan)
