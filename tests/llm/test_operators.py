import datetime
import glob
import hashlib
import os
import random
import tempfile
import zlib

import numpy as np
import pytest
import xxhash

from recordloom.llm import arc_convert, catalog, chat_format, exact_dedup, line_dedup, mixing, packing, quality, simhash, substring_dedup
from recordloom.llm.common import fresh_path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EXTRA = ", keep_id string, score double, j int, digest string, kept int, tokens int"


def docs(spark, rows, extra=False):
    """rows: (doc_id, text) or the first columns of documents."""
    full = [(*r, *("en", "src0", 1)[len(r) - 2 :]) for r in rows]
    return spark.createDataFrame([(*r, "x", 0.5, 1, "d", 1, 1) for r in full] if extra else full, DOCS + (EXTRA if extra else ""))


WORDS = [a + b for a in ("ba", "do", "ki", "lu", "me", "no", "pa", "ri", "so", "tu") for b in ("ran", "ster", "lo", "mik", "dun", "fel", "gor", "hap", "jin", "wex")]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


EDGES = [(1, None), (2, ""), (3, " \n\t "), (None, "no id here"), (None, None), (4, "Tie tie"), (5, "tIE TIE"), (5, "tIE TIE"), (6, "x"), (7, prose(1, 30_000)), (8, "İç É"), (9, "iç é")]


# -- exact dedup


def brute_exact(rows):
    norm = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    return {(i, max((x for x in groups[norm(t)] if x is not None), default=None), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows}


@pytest.mark.parametrize("extra", [False, True])
def test_exact_dedup(spark, extra):
    d = docs(spark, EDGES, extra)
    got = exact_dedup.dedup_and_append(d, exact_dedup.DigestIndex(spark, fresh_path(spark, "i"), 4), "b").collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.digest.hex()) for r in got} == brute_exact(EDGES)
    assert len(got) == len(EDGES)
    kept = [r.digest for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len({r.digest for r in got})
    left = exact_dedup.keep_first(d, exact_dedup.DigestIndex(spark, fresh_path(spark, "i"), 4), "b")
    assert left.columns == d.columns and left.count() == len(kept)


@pytest.mark.parametrize("batches", [2, 5])
def test_exact_dedup_in_batches(spark, batches):
    rows = EDGES + [(100 + k, f"text {k % 7}") for k in range(40)] + [(60, "TEXT 3"), (60, "text 3")]
    d = docs(spark, rows, True)
    index = exact_dedup.DigestIndex(spark, fresh_path(spark, "i"), 4)
    got = exact_dedup.dedup_in_batches(d, index, "b", batches).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.digest.hex()) for r in got} == brute_exact(rows) and len(got) == len(rows)
    kept = [r.digest for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len({r.digest for r in got})
    assert index.rows().select("batch_id").distinct().count() > 1  # later batches met a filled index
    again = index.compacted(fresh_path(spark, "i"))
    assert again.rows().exceptAll(index.rows()).count() == 0 and again.rows().count() == index.rows().count()
    index.forget()


def test_names_of_other_columns_dont_clash(spark):
    names = ["__d", "__id", "__digest", "digest_own", "id_key", "nth_copy", "id_kept", "ID_KEPT_", "__form", "__source", "__weight", "__kept", "j"]
    d = spark.createDataFrame([(k, f"some text {k % 3} " * 9, "en", "src0", 1, *(["mine"] * len(names))) for k in range(6)], DOCS + "".join(f", `{n}` string" for n in names))
    for got in (exact_dedup.keep_first(d, exact_dedup.DigestIndex(spark, fresh_path(spark, "i"), 4), "b"), simhash.keep_representatives(d), mixing.keep_sample(d)):
        assert got.columns == d.columns
        assert all(r[n] == "mine" for r in got.collect() for n in names)
    assert exact_dedup.keep_first(d, exact_dedup.DigestIndex(spark, fresh_path(spark, "i"), 4), "b").count() == 3


def test_exact_dedup_index_persists(spark):
    path = fresh_path(spark, "i")
    index = exact_dedup.DigestIndex(spark, path, 4)
    first = exact_dedup.dedup_and_append(docs(spark, [(1, "a"), (2, "b")]), index, "one").collect()
    assert all(r.kept for r in first)
    again = exact_dedup.DigestIndex(spark, path, 4)
    second = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.dedup_and_append(docs(spark, [(3, "A"), (4, "c")]), again, "two").collect()}
    assert second == {3: (1, False), 4: (4, True)}
    rerun = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.dedup_and_append(docs(spark, [(3, "A"), (4, "c")]), again, "two").collect()}
    assert rerun == second and again.rows().count() == 3
    plan = again.rows().select("digest")._jdf.queryExecution().toString()
    assert "Bucketed: " in plan


# -- line dedup


def brute_lines(rows, min_docs=3, min_chars=20):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars and i is not None:
                held.setdefault(key(x), set()).add(i)
    common = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if key(x) not in common or common[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("extra", [False, True])
@pytest.mark.parametrize("broadcast", [0, 100])
def test_line_dedup(spark, monkeypatch, extra, broadcast):
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", broadcast)
    common, wide = "This line is in many documents.", "ÄÖÜ this one has letters beyond A-Z"
    rows = [*EDGES, (10, f"a\n {common.upper()}\t\nb"), (11, f"{common}\n{common}\n"), (12, f"\x0b{common}\x0c\n{wide}"), (12, f"{common}"), (13, f"{wide}\nshort"), (14, wide), (15, wide.lower()), (None, common), (16, "short\n" * 50)]
    got = line_dedup.drop_common_lines(docs(spark, rows, extra))
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=repr) == brute_lines(rows)


# -- chat


def test_chat_collapse(spark):
    a = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", None)]
    convs = {1: a[:2], 2: a, 3: a[:3], 4: a, 5: [("user", "hi"), ("assistant", "other")], 6: [(None, "hi")], 7: [("", "hi")], 8: [("user", "x" * 100_000)]}
    rows = [(c, t, *x, "clash") for c, xs in convs.items() for t, x in enumerate(xs)] + [(None, 0, "user", "lost", "clash"), (9, None, "user", "t", "clash"), (9, None, "user", "t", "clash")]
    got = {r.conv_id: r for r in chat_format.collapse_and_render(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, n_turns string")).collect()}
    assert all(r.part == 0 for r in got.values())
    assert {(k, r.n_turns, r.n_copies) for k, r in got.items()} == {(2, 4, 2), (5, 2, 1), (6, 1, 1), (7, 1, 1), (8, 1, 1), (9, 2, 1)}
    assert got[2].rendered == "<|user|>\nhi\n<|assistant|>\nhello\n<|user|>\nmore\n<|assistant|>\n\n"


@pytest.mark.parametrize("hot", [8192, 3])
def test_chat_blocks(spark, monkeypatch, hot):
    monkeypatch.setattr(chat_format, "BLOCK_BITS", 2)
    monkeypatch.setattr(chat_format, "HOT_BLOCK", hot)
    r = random.Random(5)
    long = [("user", prose(k, 3)) for k in range(40)]
    convs = {k: long[: r.choice([40, 40, 17, 5, 4, 1])] for k in range(30)}
    convs |= {100: long[:20] + long[21:], 101: long[1:], 102: long[:8] + long[7:]}
    numbers = {k: sorted([None] * (k % 3) + r.sample(range(-9, 99), len(x)), key=lambda n: (n is not None, n))[: len(x)] for k, x in convs.items()}
    texts = {k: [(n, *x) for n, x in zip(numbers[k], xs, strict=True)] for k, xs in convs.items()}
    texts |= {200: [(5, *x) for x in long], 201: [(None, *x) for x in long[:30]], 202: [(5, *x) for x in long[:9]] + [(6, *x) for x in long[9:]]}
    for k, xs in texts.items():  # turns of one number come in the order of their hash
        texts[k] = sorted(xs, key=lambda x: (x[0] is not None, x[0] or 0, hashlib.sha256(f"4:user{len(x[2])}:{x[2]}".encode()).hexdigest()))
    lists = {k: tuple(x[1:] for x in xs) for k, xs in texts.items()}
    prefixes = {x[:k] for x in lists.values() for k in range(1, len(x))}
    want = {}
    for x in set(lists.values()) - prefixes:
        same = [k for k in lists if lists[k] == x]
        want[min(same)] = (len(x), len(same), "".join(f"<|{a}|>\n{b}\n" for a, b in x))
    rows = [(k, *x) for k, xs in texts.items() for x in xs]
    r.shuffle(rows)
    got = {}
    for x in sorted(chat_format.collapse_and_render(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect(), key=lambda x: (x.conv_id, x.part)):
        got.setdefault(x.conv_id, []).append(x)
    assert {k: (xs[0].n_turns, xs[0].n_copies, "".join(x.rendered for x in xs)) for k, xs in got.items()} == want
    assert all([x.part for x in xs] == list(range(len(xs))) for xs in got.values()) and max(map(len, got.values())) > 5


# -- packing


def test_pack_is_whole_and_full():
    for seed in range(20):
        r = random.Random(seed)
        sizes = [r.choice([1, 5, r.randrange(1, 3000), 2048, 4096]) for _ in range(r.randrange(1, 200))]
        pieces, seen = packing.pack(sizes), {}
        for k, start, n, seq, offset in pieces:
            seen.setdefault(k, []).append((start, n))
        assert [sum(n for _, n in seen[k]) for k in range(len(sizes))] == sizes
        for parts in seen.values():
            at = 0
            for start, n in sorted(parts):
                assert start == at and n > 0
                at += n
        rows = {}
        for *_, n, seq, offset in pieces:
            rows.setdefault(seq, []).append((offset, n))
        for parts in rows.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= 2048 and at & (at - 1) == 0  # full, or a power of two


def test_long_runs_of_one_kind_are_tokenized():
    import public_tokenizers

    names = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    texts = [x * 1_000_000 for x in (" ", "\n", "a", ".", "\t ")] + ["a " + " " * 9_999 + "b", "x" * 10_000]
    for fast, slow in zip(packing.encode(texts, *names), packing.encode(texts, names[0]), strict=True):
        assert np.array_equal(fast, slow)


def test_fast_ids_are_the_tokenizers_ids():
    import public_tokenizers as P

    at = [chr(c) for c in (*range(0x250), *range(0x2000, 0x2070), *range(0x20A0, 0x20C0)) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b {c}{c} 1{c} '{c}ll  {c}\n{c} ." for c in at] + ["<|endoftext|> x", "日本語 text", "", prose(3, 500), "a" * 5000, " \n \t ", "ſ't"]
    one = packing.encode(texts, P.path("byte_bpe_50k.json"))
    two = packing.encode(texts, P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"))
    assert all(np.array_equal(a, b) for a, b in zip(one, two, strict=True))


@pytest.mark.parametrize("extra", [False, True])
def test_pack_documents(spark, extra):
    import public_tokenizers as P

    rows = [(k, t) for k, t in enumerate(x[1] for x in EDGES)]
    got = packing.pack_documents(docs(spark, rows, extra)).collect()
    ids = packing.encode([t or "" for _, t in rows], P.path("byte_bpe_50k.json"))
    for k, _ in rows:
        want = np.append(ids[k], 1).astype("<u4")
        mine = sorted((r for r in got if r.doc_id == k), key=lambda r: r.start)
        assert sum(r.length for r in mine) == len(want) and all(r.doc_tokens == len(want) for r in mine)
        assert all(zlib.crc32(want[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in mine)


# -- SimHash


def brute_fingerprint(text, words=4):
    w = [x for x in (text or "").encode().lower().split()]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + words]), 42) for k in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_rows():
    r = random.Random(5)
    rows = []
    for k in range(40):
        base = prose(k, r.randrange(1, 400)).split()
        for j in range(r.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(j % 3):
                copy[r.randrange(len(copy))] = r.choice(WORDS)
            rows.append((len(rows), " ".join(copy)))
    return rows + [(500, None), (501, ""), (502, "a"), (502, "a"), (503, "A"), (None, "a"), (None, prose(77, 50))]


@pytest.mark.parametrize("shard_size", [2, 1500])
def test_simhash(spark, shard_size):
    rows = near_rows()
    prints = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(find(k), []).append(i)
    want = sorted((repr(i), p, min((x for x in least[find(k)] if x is not None), default=None)) for k, ((i, _), p) in enumerate(zip(rows, prints, strict=True)))
    got = simhash.near_duplicates(docs(spark, rows, True), shard_size=shard_size).collect()
    assert sorted(((repr(r.doc_id), r.fp & 0xFFFFFFFFFFFFFFFF, r.component_id) for r in got), key=repr) == sorted(want, key=repr)
    kept = simhash.keep_representatives(docs(spark, rows, True), shard_size=shard_size)
    assert {r.doc_id for r in kept.collect()} == {w[2] for w in want}


def shingles(text, words=5):
    w = text.lower().split()
    return {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()


def test_similar_documents(spark):
    """Texts of a similarity well over 0.8 meet in one component, those well under stay apart; ids, nulls and copies as ever."""
    r, rows, pairs = random.Random(5), [], []
    for k in range(150):
        words = prose(5000 + k, 60 + k).split()
        other = list(words)
        for at in r.sample(range(len(words)), k % 5):
            other[at] = f"new{at}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        pairs.append((2 * k, len(a & b) / len(a | b)))
    hot = prose(1, 120).split()
    rows += [(1000 + k, " ".join(hot[:k] + ["odd"] + hot[k + 1 :])) for k in range(100)]
    d = docs(spark, rows + [(2000, None), (2001, ""), (None, "x y z"), (2002, "x y z"), (2003, "x y z"), (2003, "x y z")], True)
    found = {x.doc_id: x.component_id for x in simhash.similar_documents(d).collect()}
    sure = [(k, j) for k, j in pairs if abs(j - 0.8) > 0.1]
    assert len(sure) > 60 and all((found[k + 1] == k) == (j > 0.8) and found[k] == k for k, j in sure)
    assert {found[1000 + k] for k in range(100)} == {1000}
    assert found[2000] == found[2001] == 2000 and found[2002] == found[2003] == 2002
    left = simhash.keep_dissimilar(d)
    assert left.columns == d.columns and {x.doc_id for x in left.collect()} == {k for k, v in found.items() if k == v}


def test_sketch_is_the_least_hashes():
    text = prose(3, 9000)
    seeds = np.unique(substring_dedup.word_seeds(substring_dedup.split_words(text), 5))
    for j in (0, 7, 119):
        mixed = [(int(s) * int(simhash._FACTORS[j]) + int(simhash._OFFSETS[j])) % 2**64 for s in seeds]
        assert int(simhash.sketch(text)[j]) == min((x ^ x >> 32) * 0xD6E8FEB86659FD93 % 2**64 for x in mixed) >> 32


def test_fingerprint_is_sparks_hash(spark):
    got = spark.sql("select xxhash64('some four word shingle') as h").first().h & 0xFFFFFFFFFFFFFFFF
    assert simhash.fingerprint("Some four\tWORD shingle") == got


def test_bk_tree_follows_brute_force():
    r = random.Random(2)
    values = [r.getrandbits(64) for _ in range(60)]
    values += [v ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for v in values]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for v in values:
        assert {tree.values[k] for k in tree.near(v, 4)} == {x for x in values if (x ^ v).bit_count() <= 4}


def test_components_of_a_long_chain(spark):
    got = simhash.components(spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 200)], "a bigint, b bigint")).collect()
    assert {(r.v, r.label) for r in got} == {(k, 0) for k in range(61)} | {(100, 100), (200, 100)}


# -- substring dedup


def test_passages(spark):
    shared, fuzzy = prose(900, 60).split(), prose(901, 90).split()
    changed = [w if k % 11 else "changed" for k, w in enumerate(fuzzy)]
    texts = {
        1: prose(1, 80).split() + shared + prose(2, 40).split(), 2: prose(3, 10).split() + shared + prose(4, 150).split(), 3: shared,
        4: prose(5, 33).split() + fuzzy + prose(6, 70).split(), 5: prose(7, 120).split() + changed, 6: prose(8, 300).split(), 7: prose(9, 20).split() + shared[:30] + prose(10, 50).split(),
    }
    rows = [(k, " ".join(v)) for k, v in texts.items()] + [(8, None), (9, ""), (None, " ".join(shared)), (2, " ".join(texts[2])), (10, "a b " * 200), (11, "a b " * 200)]
    got = {(r.doc_id, r.other_id): r for r in substring_dedup.passages(docs(spark, rows, True)).collect()}
    assert set(got) == {(2, 1), (3, 1), (5, 4), (11, 10)}
    assert (got[2, 1].start_word, got[2, 1].n_words, got[2, 1].other_start) == (10, 60, 80)
    assert got[5, 4].identity >= 0.8 and got[5, 4].n_words >= 80
    assert all(r.identity >= 0.8 and r.n_words >= 50 for r in got.values())


def own_words(tag, n):
    return [f"{tag}{k}" for k in range(n)]


def test_passages_of_changed_words_are_found(spark):
    """Fifty words, of them 3 to 10 changed: all found, but for a few at exactly 0.8."""
    r, rows = random.Random(12), []
    for k in range(80):
        passage = own_words(f"p{k}x", 50)
        changed = list(passage)
        for at in r.sample(range(50), (3, 5, 8, 10)[k % 4]):
            changed[at] = f"other{k}x{at}"
        rows += [(2 * k, " ".join(own_words(f"a{k}x", 70) + passage + own_words(f"b{k}x", 70))), (2 * k + 1, " ".join(own_words(f"c{k}x", 90) + changed + own_words(f"d{k}x", 40)))]
    got = substring_dedup.passages(docs(spark, rows, True)).collect()
    assert all(x.other_id == x.doc_id - 1 and x.identity >= 0.8 and x.n_words >= 50 for x in got)
    found = {x.other_id // 2 for x in got}
    assert {k for k in range(80) if k % 4 < 3} <= found and len(found) >= 78


def test_passages_behind_holders_of_a_part(spark):
    """Smaller ids hold parts, too short for a passage at 0.8, of what two documents share; with two parts, no first or last holder has the whole."""
    rows = []
    for k, parts in enumerate([[(0, 38)], [(6, 44)], [(0, 30), (12, 50)], [(0, 38), (12, 50), (7, 45)]]):
        passage, base = own_words(f"p{k}x", 50), 100 * k
        pieces = [passage[a:b] for a, b in parts]
        for j, w in enumerate([*pieces, passage, *pieces, passage]):
            rows.append((base + j, " ".join(own_words(f"a{k}x{j}x", 60) + w + own_words(f"b{k}x{j}x", 60))))
    got = substring_dedup.passages(docs(spark, rows, True)).collect()
    want = {(100 * k + 2 * n + 1, 60, 50, 100 * k + n) for k, n in enumerate([1, 1, 2, 3])}
    assert want == {(x.doc_id, x.start_word, x.n_words, x.other_id) for x in got if x.n_words == x.equal_words}
    assert all(x.identity >= 0.8 and x.n_words >= 50 for x in got)


def test_passages_whose_seeds_others_hold_in_pieces(spark):
    """Two documents share fifty words, some changed; others, before and between them, hold both halves of the unchanged words, so that
    neither the first nor the last holder of any seed is the other one, and the two don't share the same seeds with all."""
    rows, want = [], set()
    for k, every in enumerate([0, 12, 9, 8, 7, 6]):
        passage, base = own_words(f"p{k}x", 50), 100 * k
        changed = [w if not every or j % every != every - 1 else f"other{k}x{j}" for j, w in enumerate(passage)]
        halves = [passage[:25], passage[25:], passage[13:38]]
        for j, w in enumerate([*halves, passage, *halves, changed, *halves]):
            rows.append((base + j, " ".join(own_words(f"a{k}x{j}x", 60) + w + own_words(f"b{k}x{j}x", 60))))
        want.add((base + 7, base + 3))
    got = substring_dedup.passages(docs(spark, rows, True)).collect()
    assert want == {(x.doc_id, x.other_id) for x in got}
    assert all(x.identity >= 0.8 and x.n_words >= 50 for x in got)


def test_every_pair_of_holders_is_compared():
    """A line that many documents hold, and passages around it that two of them share, found as by brute force."""
    r = random.Random(5)
    line, spots, texts = own_words("line", 9), [], []
    for k in range(120):
        texts.append(own_words(f"a{k}x", 60) + line + own_words(f"b{k}x", 60))
    for a, b in [(3, 70), (10, 110), (55, 56), (71, 119)]:
        for j in r.sample([j for j in range(40, 95) if not 60 <= j < 69], 38):
            texts[b][j] = texts[a][j]
    seeds = [substring_dedup.word_seeds([w.encode() for w in t]) for t in texts]
    held = [(int(h[x]), d, x) for d, h in enumerate(seeds) for x in range(60, 65)]
    context = np.stack([substring_dedup.contexts([w.encode() for w in texts[d]], np.array([x]))[0] for _, d, x in held])
    seed, doc, pos = (np.array(c, dtype=t) for c, t in zip(zip(*held, strict=True), ("u8", "i8", "i4"), strict=True))
    got = substring_dedup.compare(seed, doc, pos, np.ones(len(doc), dtype=bool), context)
    want = {(b, a) for a in range(120) for b in range(a + 1, 120) if max(sum(texts[a][j] == texts[b][j] for j in range(at, at + 50)) for at in range(15, 65)) >= 40}
    assert {(3, 70), (10, 110), (55, 56)} <= {(a, b) for b, a in want} and want == set(zip(got[0].tolist(), got[1].tolist(), strict=True))


def test_runs_of_one_word_are_compared_once_a_diagonal(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{rng.integers(10**6)}" for _ in range(60)) + " the" * 30 + "".join(f" w{rng.integers(10**6)}" for _ in range(60))) for i in range(20)]
    held = [(i, x) for i, t in rows for x in range(60, 86)]
    doc, pos = (np.array(c) for c in zip(*held, strict=True))
    words = {i: substring_dedup.split_words(t) for i, t in rows}
    context = np.concatenate([substring_dedup.contexts(words[i], pos[doc == i]) for i, _ in rows])
    sides = [np.concatenate(c) for c in zip(*(substring_dedup.run_sides(substring_dedup._word_hashes(words[i]), pos[doc == i]) for i, _ in rows), strict=True)]
    seen, share = [], substring_dedup._may_share
    monkeypatch.setattr(substring_dedup, "_may_share", lambda a, b, straight: seen.append(len(a)) or share(a, b, straight))
    substring_dedup.compare(np.full(len(doc), 7, dtype=np.uint64), doc, pos.astype(np.int32), np.ones(len(doc), dtype=bool), context, *sides)
    assert sum(seen) < 190 * 26 * 26 / 10  # of all pairs of places of two documents
    runs = docs(spark, [(1, "a b c d e f " + "the " * 69 + "g h i j k l"), (2, "m n o p q r " + "the " * 148 + "s t u v w x"), (3, "the " * 30 + "y z " * 30)])
    covered = {x for r in substring_dedup.passages(runs).collect() if r.doc_id == 2 for x in range(r.start_word, r.start_word + r.n_words)}
    assert set(range(6, 154)) <= covered


def places_around(texts, wanted):
    """Columns of compare() of the places of each text that wanted gives, all of one seed and asked."""
    words = [[w.encode() for w in t] for t in texts]
    pos = [np.array(wanted(t), dtype=np.int32) for t in texts]
    sides = [np.concatenate(c) for c in zip(*(substring_dedup.run_sides(substring_dedup._word_hashes(w), p) for w, p in zip(words, pos, strict=True)), strict=True)]
    doc = np.repeat(np.arange(len(texts)), [len(p) for p in pos])
    context = np.concatenate([substring_dedup.contexts(w, p) for w, p in zip(words, pos, strict=True)])
    return np.full(len(doc), 7, dtype=np.uint64), doc, np.concatenate(pos), np.ones(len(doc), dtype=bool), context, *sides


def test_a_line_of_many_documents_is_compared_where_rare_words_agree(monkeypatch):
    rng = np.random.default_rng(12)
    texts = [[f"v{x}" for x in np.where(rng.random(120) < 0.5, rng.integers(0, 30, 120), rng.integers(30, 9000, 120))] for _ in range(1500)]
    for t in texts:
        t[60:65] = own_words("line", 5)
    pairs = [(3, 70), (10, 1400), (600, 601), (71, 1119)]
    for a, b in pairs:
        for j in [j for j in range(38, 84) if not 60 <= j < 65 and j % 8]:
            texts[b][j] = texts[a][j]
    places = places_around(texts, lambda t: [60])
    seen, share = [], substring_dedup._may_share
    monkeypatch.setattr(substring_dedup, "_may_share", lambda a, b, straight: seen.append(len(a)) or share(a, b, straight))
    got = substring_dedup.compare(*places)
    assert sum(seen) < 25_000  # of 1.1 million
    assert {(b, a) for a, b in pairs} <= set(zip(got[0].tolist(), got[1].tolist(), strict=True))
    monkeypatch.setattr(substring_dedup, "WIDE", 10**9)
    assert matches_in(got) == matches_in(substring_dedup.compare(*places))


def test_pairs_by_rare_words_are_those_of_all_places(monkeypatch):
    """Runs of one word and near copies, in batches of several groups and in one."""
    r = random.Random(13)
    texts = []
    for k in range(60):
        t = own_words(f"a{k % 40}x", 50) + ["the"] * r.choice([9, 20, 33, 45, 70]) + own_words(f"b{k % 40}x", r.randrange(60))
        texts.append([w if r.random() < 0.95 else f"c{k}" for w in t] if k >= 40 else t)
    seed, doc, *rest = places_around(texts, lambda t: [x for x in range(len(t) - 4) if t[x : x + 5] == ["the"] * 5])
    for seeds in (seed, seed + np.arange(len(seed), dtype=np.uint64) % np.uint64(3)):
        got = []
        for wide, batch in ((10**9, 1), (4, 1), (4, 10**9)):
            monkeypatch.setattr(substring_dedup, "WIDE", wide)
            monkeypatch.setattr(substring_dedup, "BATCH", batch)
            got.append(matches_in(substring_dedup.compare(seeds, doc, *rest)))
        assert got[0] == got[1] == got[2] != []


def matches_in(columns):
    return sorted(zip(*(c.tolist() for c in columns), strict=True))


def test_passages_leave_no_shuffle_files(spark):
    def shuffled():
        files = glob.glob(f"{tempfile.gettempdir()}/blockmgr-*/**/shuffle_*.data", recursive=True)
        return {f for f in files if os.path.getsize(f) > 1000}  # without those of a sum

    rng = np.random.default_rng(9)
    line = " ".join(f"w{x}" for x in range(12))
    rows = [(i, " ".join(f"v{rng.integers(3000)}" for _ in range(100)) + f" {line} " + " ".join(f"v{rng.integers(3000)}" for _ in range(100))) for i in range(40)]
    rows += [(40 + i, f"{t} {i}") for i, (_, t) in enumerate(rows[:10])]
    d = docs(spark, rows)
    before = shuffled()
    found = substring_dedup.passages(d)
    assert not shuffled() - before
    got = {(r.doc_id, r.start_word, r.n_words) for r in found.collect()}
    assert {g[0] for g in got} == set(range(40, 50))
    one, many = (substring_dedup.all_compared(places_of(d), 4, n).collect() for n in (1, 3))
    assert matches_of(one) == matches_of(many) != set()


def places_of(d):
    texts = d.select("doc_id", "text")
    first = substring_dedup.chains(substring_dedup.match_parcels(substring_dedup.seed_parcels(texts, 4), 4), True, 5)
    return substring_dedup.worded(first.where("data IS NOT NULL").select("doc_id", "data"), texts)


def matches_of(parcels):
    return {m for r in parcels for m in zip(*(c.tolist() for c in substring_dedup.unpack_matches(r.data)), strict=True)}


def test_passage_held_twice_is_reported_twice(spark):
    passage, part = own_words("p", 60), own_words("p", 60)[:35]
    texts = [own_words("a", 80) + passage + own_words("b", 40), own_words("c", 30) + passage + own_words("d", 70) + passage + own_words("e", 10)]
    texts += [own_words("f", 20) + part + own_words("g", 90) + passage, own_words("h", 15) + passage]
    got = substring_dedup.passages(docs(spark, [(k, " ".join(x)) for k, x in enumerate(texts)], True)).collect()
    assert {(x.doc_id, x.start_word, x.n_words, x.other_id, x.other_start) for x in got} == {(1, 30, 60, 0, 80), (1, 160, 60, 0, 80), (2, 145, 60, 0, 80), (3, 15, 60, 0, 80)}


def test_chain_is_the_best_chain():
    r = random.Random(4)
    for _ in range(40):
        runs = sorted({(r.randrange(60), r.randrange(60), r.randrange(1, 9)) for _ in range(12)})
        best = [0.0] * len(runs)
        for i, (x, y, n) in enumerate(runs):
            best[i] = n + max([0.0, *(best[j] - 0.25 * (x + y - a - b - 2 * m) for j, (a, b, m) in enumerate(runs) if a < x and b < y)])
        got = substring_dedup.chain(runs)
        path = got[0]
        score = sum(n for *_, n in path) - sum(0.25 * (q[0] + q[1] - p[0] - p[1] - 2 * p[2]) for p, q in zip(path, path[1:], strict=False))
        assert score == pytest.approx(max(best))
        assert sorted(x for p in got for x in p) == runs


def test_common_words_follows_dynamic_programming():
    r = random.Random(6)
    for _ in range(50):
        a, b = ([r.choice([b"a", b"b", b"c"]) for _ in range(r.randrange(12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert substring_dedup.common_words(a, b) == t[-1][-1]


# -- ARC


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    records = [{"url": "http://a b.example/", "ip": "192.0.2.1", "date": "20010203040506", "type": "text/html", "body": b"HTTP/1.0 200 OK\r\n\r\nx\n\ny"}, {"url": "dns:x", "ip": "0.0.0.0", "date": "200102", "type": "text/dns", "body": b""}]
    got = list(arc_convert.read_arc(arc_convert.write_arc(records, version, "n.arc")))
    assert [g["body"] for g in got[1:]] == [r["body"] for r in records]
    warc = [arc_convert.to_warc(g) for g in got]
    assert [w["kind"] for w in warc] == ["warcinfo", "response", "resource"]
    assert warc[1]["date"] == "2001-02-03T04:05:06Z" and warc[1]["payload"] == b"x\n\ny" and warc[2]["date"] == "2001-02-01T00:00:00Z"
    data = b"".join(arc_convert.warc_record(w) + b"\r\n\r\n" for w in warc)
    assert [f["warc-record-id"] for f, _ in arc_convert.read_warc(data)] == [w["id"] for w in warc]
    with pytest.raises(ValueError):
        list(arc_convert.read_arc(arc_convert.write_arc(records, version, "n.arc")[:-30]))


def test_arc_archives_and_filedesc_urls(spark, monkeypatch):
    """Archives that are cut within a chunk begin with their own version block; urls like the version block's are pages."""
    monkeypatch.setattr(arc_convert, "ARCHIVE_BYTES", 3000)
    rows = [(k, "filedesc://x" if k % 3 else "u", "p" * (500 + k)) for k in range(40)]
    path = fresh_path(spark, "warc")
    d = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    got = arc_convert.convert(arc_convert.mark_revisits(d), path).collect()
    assert {(r.page_id, r.payload_bytes, r.target_uri) for r in got} == {(k, len(h), u) for k, u, h in rows} and len(got) == 40
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).collect()
    kinds = [[f["warc-type"] for f, _ in arc_convert.read_warc(bytes(x.content))] for x in files]
    assert len(kinds) > 5 and all(k[0] == "warcinfo" and k.count("warcinfo") == 1 for k in kinds)


def test_arc_convert(spark):
    long = "<p>" + "x" * 200
    rows = [(3, "u", long), (1, None, long), (2, "u v\n", long), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (None, "u", long), (None, "u", "y" * 150), (7, "é", "\r\n\r\nWARC/1.1\r\n" * 20), (1, "u", long), (8, "u", "é" * 1_000_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, digest string")
    got = arc_convert.convert(arc_convert.mark_revisits(pages), fresh_path(spark, "w")).collect()
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        same = [x for x, _, y in rows if (y or "") == (h or "") and x is not None]
        refers = min(same) if len(data) >= 100 and same and i != min(same) else None
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if refers is not None else "response", refers))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)
    assert all(datetime.datetime.fromisoformat(r.warc_date) for r in got)


# -- quality


def junk(seed):
    return " ".join(w + "$$$" for w in prose(seed, 60).split()) if seed % 2 else (WORDS[seed % 100] + " ") * 80


def test_quality(spark):
    rows = [(k, prose(k, 100) + ".") for k in range(300)] + [(k, junk(k)) for k in range(300, 420)] + [(None, "x"), (1000, None), (1001, ""), (5, prose(5, 100))]
    labels = spark.createDataFrame([(k, int(k < 300), 0) for k in range(0, 420)] + [(None, 1, 0), (7, None, 0), (8, 1, 1)], "doc_id bigint, quality int, toxic int")
    d = docs(spark, rows, True)
    forest = quality.train(d, labels)
    got = quality.score(d, forest).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    test = [r for r in got if r.held_out and r.doc_id < 420]
    assert np.mean([r.predicted == int(r.doc_id < 300) for r in test]) > 0.95
    left = quality.keep_good(d, forest)
    assert left.columns == d.columns and left.count() == sum(r.predicted for r in got)


def test_quality_takes_one_row_of_a_repeated_id(spark):
    once = [(k, prose(k, 60)) for k in range(60)] + [(k, junk(k)) for k in range(60, 120)]
    labels = spark.createDataFrame([(k, int(k < 60)) for k in range(120)], "doc_id bigint, quality int")
    forest = quality.train(docs(spark, once), labels, trees=5)
    again = quality.train(docs(spark, once + once[:1] * 500), labels, trees=5)
    assert all((getattr(forest, f) == getattr(again, f)).all() for f in ("feature", "threshold", "value"))


def test_quality_without_labels(spark):
    d = docs(spark, [(1, "a")])
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert [r.score for r in quality.score(d, quality.train(d, none)).collect()] == [0.5]
    ones = spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    assert quality.score(d, quality.train(d, ones)).count() == 1


def test_forest_walk_follows_single_rows():
    r = np.random.default_rng(3)
    x = r.normal(size=(500, 4))
    f = quality.fit(x, ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float), trees=20)
    s = f.score(x)

    def one(row):
        total = f.base
        for root in f.roots:
            at = root
            while f.left[at] != at:
                at = f.left[at] if row[f.feature[at]] <= f.threshold[at] else f.right[at]
            total += f.value[at]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(s[:50], [one(row) for row in x[:50]])
    assert np.mean((s >= 0.5) == ((x[:, 0] > 0) ^ (x[:, 1] > 0.5))) > 0.97


# -- mixing


def test_rake_meets_the_margins():
    r = np.random.default_rng(4)
    codes = np.array([(a, b, c) for a in range(4) for b in range(3) for c in range(2)])
    sums = r.uniform(1, 100, len(codes))
    targets = [np.array(t) for t in ([0.4, 0.3, 0.2, 0.1], [0.5, 0.3, 0.2], [0.7, 0.3])]
    w = mixing.rake(sums, codes, targets)
    for d, t in enumerate(targets):
        assert np.allclose(np.bincount(codes[:, d], weights=w), t, atol=1e-9)
    p = mixing.probabilities(sums, w, 0.5)
    assert (p <= 1).all() and (p * sums).sum() == pytest.approx(0.5 * sums.sum())


def test_bounded_rake_meets_what_the_tokens_allow():
    codes = np.array([(a, b) for a in range(3) for b in range(2)])
    sums = np.array([30.0, 2, 30, 28, 4, 6])
    targets = [np.array([0.4, 0.5, 0.1]), np.array([0.6, 0.4])]
    w = mixing.rake(sums, codes, targets)
    assert (w * 0.7 * sums.sum() > sums).any()
    got = mixing.bounded(sums, w, codes, targets, 0.7) * sums
    assert (got <= sums + 1e-9).all() and got.sum() == pytest.approx(70)
    for d, t in enumerate(targets):
        assert np.allclose(np.bincount(codes[:, d], weights=got) / 70, t, atol=1e-6)
    scarce = mixing.bounded(sums, w, codes, [np.array([0.3, 0.3, 0.4]), targets[1]], 0.7) * sums
    assert np.allclose(np.bincount(codes[:, 0], weights=scarce), [30, 30, 10], atol=1e-6)


def test_mix(spark):
    rows = [(k, prose(k, 40 + k % 60), ("en", "de")[k % 5 == 0], f"src{k % 3}") for k in range(900)] + [(None, None, None, None), (901, "", "xx", "other"), (902, "a|b|c", "en", "src0"), (5, prose(5, 45), "de", "src2")]
    d = docs(spark, rows, True)
    targets = {"source": {"src0": 0.5, "src1": 0.25, "src2": 0.25}, "lang": {"en": 0.5, "de": 0.5}, "topic": {"prose": 1.0}}
    got = mixing.mix(d, targets, 0.3).collect()
    assert len(got) == len(rows) and [r.doc_id for r in got if r.doc_id is None] == [None]
    kept = [r for r in got if r["__kept"]]
    size = lambda r: max(1, -(-len((r.text or "").encode()) // 4))
    total = sum(map(size, kept))
    assert sum(size(r) for r in kept if r.source == "src0") / total == pytest.approx(0.5, abs=0.08)
    assert sum(size(r) for r in kept if r.lang == "de") / total == pytest.approx(0.5, abs=0.08)
    assert total / sum(map(size, got)) == pytest.approx(0.3, abs=0.06)


def test_default_targets_are_flatter_and_met(spark):
    sizes = {("src0", "en"): 500, ("src1", "en"): 120, ("src2", "de"): 120, ("src1", "de"): 60}
    rows = [(1000 * n + k, prose(77 * n + k, 50), lang, src) for n, ((src, lang), m) in enumerate(sizes.items()) for k in range(m)]
    got = mixing.mix(docs(spark, rows), None, 0.2).collect()
    total, kept = sum(r["__tokens"] for r in got), sum(r["__tokens"] * r["__probability"] for r in got)
    assert kept == pytest.approx(0.2 * total, rel=1e-6)
    for name in ("source", "lang"):
        have = {v: sum(r["__tokens"] for r in got if r[name] == v) / total for v in {r[name] for r in got}}
        flat = {v: x**0.5 for v, x in have.items()}
        for v in have:
            assert sum(r["__tokens"] * r["__probability"] for r in got if r[name] == v) / kept == pytest.approx(flat[v] / sum(flat.values()), abs=1e-6)


def test_topics_are_the_subjects(spark):
    """Texts of three vocabularies fall into topics of one vocabulary each; every row has a topic, and the same one again."""
    r, rows = random.Random(2), []
    for k in range(300):
        words = [f"s{k % 3}w{r.randrange(60)}" for _ in range(50)] + [f"common{r.randrange(20)}" for _ in range(30)]
        r.shuffle(words)
        rows.append((k, " ".join(words)))
    d = docs(spark, rows + [(900, None), (901, " \n"), (902, "s1w5")], True)
    model = mixing.fit(d, sample=150, topics=3)
    got = {x.row: x.topic for x in mixing.labelled(d, model, mixing.F.col("doc_id"), 1).collect()}
    assert got[900] == got[901] == "none"
    kinds = [{got[k] for k in range(300) if k % 3 == s} for s in range(3)]
    assert all(len(x) == 1 for x in kinds) and len(set.union(*kinds)) == 3
    again = mixing.fit(d, sample=150, topics=3)
    assert np.array_equal(model.centres, again.centres) and 0.1 < model.ratio < 1


def test_model_and_tokens_are_of_all_rows(spark):
    """2,600 documents: each slot's weight counts all of them, centres are the means of all that are nearest, tokens are the tokenizer's."""
    r, rows = random.Random(8), []
    for k in range(2600):
        rows.append((k, " ".join([f"s{k % 3}w{r.randrange(40)}" for _ in range(12)] + ["x" * r.randrange(1, 60), "\u4f60\u597d" * (k % 4)])))
    d = docs(spark, rows + [(9000, None), (9001, " ")])
    model = mixing.fit(d, topics=3)
    counts = np.stack([mixing.word_counts(t) for _, t in rows])
    assert np.allclose(model.weight, np.log((1 + len(rows) + 2) / (1 + (counts > 0).sum(axis=0))), atol=1e-5)
    x = np.log1p(counts) * model.weight
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    at = (x @ model.centres.T).argmax(axis=1)
    for k in range(3):
        mean = x[at == k].sum(axis=0)
        assert np.allclose(model.centres[k], mean / np.linalg.norm(mean), atol=1e-4)
    got = {g.row: g for g in mixing.labelled(d, model, mixing.F.col("doc_id"), 1).collect()}
    ids = packing.encode([t for _, t in rows], packing.tokenizer_files()[0])
    assert all(got[k].tokens == len(e) and got[k].topic == f"topic{c}" for k, (e, c) in enumerate(zip(ids, at, strict=True)))
    assert got[9000].tokens == 1 and got[9000].topic == got[9001].topic == "none"


def test_words_are_hashed_at_once(monkeypatch):
    """The slots of XXH64, which is called for words of 32 bytes or more only."""
    r = random.Random(5)
    texts = [" ".join("q" * k for k in range(40)), None, "", " \t", "\x0b a\x0cB\x1cC\x85 \u00c9 \u2167", "\ud800 a"]
    texts += ["".join(r.choice("aZ \n\t\x0b\x1c\x00\u00e9\u4f60\U0001f600") for _ in range(r.randrange(400))) for _ in range(40)]
    words = [substring_dedup.split_words(t) for t in texts]
    want = [np.bincount([mixing.xxhash.xxh64_intdigest(w, 7) % mixing.DIMS for w in ws] or [0], minlength=mixing.DIMS) * bool(ws) for ws in words]
    seen, digest = [], mixing.xxhash.xxh64_intdigest
    monkeypatch.setattr(mixing.xxhash, "xxh64_intdigest", lambda data, seed=0: seen.append(len(data)) or digest(data, seed))
    assert all((mixing.word_counts(t) == w).all() for t, w in zip(texts, want, strict=True))
    assert seen == [n for ws in words for n in map(len, ws) if n >= 32]
    together = [np.frombuffer(c, dtype=mixing.COUNTS) for c in mixing.all_counts(texts)]
    assert all(dict(zip(c["slot"].tolist(), c["n"].tolist(), strict=True)) == {int(x): int(w[x]) for x in np.flatnonzero(w)} for c, w in zip(together, want, strict=True))


def test_counts_are_read_in_place():
    rng = np.random.default_rng(4)
    rows = [np.array([(x, rng.integers(1, 9)) for x in np.flatnonzero(rng.random(64) < 0.2)], dtype=mixing.COUNTS) for _ in range(40)]
    column = mixing.pa.array([r.tobytes() for r in rows], mixing.pa.binary()).slice(7, 20)
    counts, cuts = mixing.sparse(column)
    assert np.shares_memory(counts, np.frombuffer(column.buffers()[2], dtype=np.uint8))
    model = mixing.Model(rng.random(64).astype(np.float32), rng.random((3, 64)).astype(np.float32))
    for k, r in enumerate(rows[7:27]):
        assert (counts[cuts[k] : cuts[k + 1]] == r).all()
        v = np.zeros(64)
        v[r["slot"]] = np.log1p(r["n"]) * model.weight[r["slot"]]
        assert np.allclose(model.likeness(r, np.array([0, len(r)]))[0], model.centres @ (v / np.linalg.norm(v)), atol=1e-5)


def test_clusters_are_fixed_points():
    r = np.random.default_rng(3)
    x = r.normal(size=(200, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = mixing.cluster(x, 5, 500)
    at = np.array([max(range(5), key=lambda k: float(row @ c[k])) for row in x])
    for k in range(5):
        mean = x[at == k].sum(axis=0)
        assert np.allclose(c[k], mean / np.linalg.norm(mean), atol=1e-4)


# -- all


def test_empty_tables(spark, tmp_path):
    kinds = {
        "documents": DOCS, "labels": "doc_id bigint, quality int, toxic int", "pages": "page_id bigint, url string, html string",
        "conversations": "conv_id bigint, turn bigint, role string, text string", "embeddings": "vec_id bigint, embedding array<float>, label int", "benchmark": "item_id bigint, text string",
    }
    for name, schema in kinds.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, q in catalog.QUERIES.items():
        assert q(spark, str(tmp_path)).count() == 0, name


def test_queries_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    import os

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    for name, sql in catalog.ORACLE_SQL.items():
        got, want = catalog.QUERIES[name](spark, d), c.sql(sql)
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        assert sorted(repr(tuple(r[k] for k in cols)) for r in got.collect()) == sorted(map(repr, want.select(*cols).fetchall())), name


def test_pipeline_mixes_by_the_tokenizers_tokens(spark, monkeypatch):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(k, prose(k, 5 + k % 40) + "\u4f60\u597d" * (k % 4), ("en", "de")[k % 2], f"src{k % 3}") for k in range(60)]
    seen, calibrate = [], mixing.calibrate

    def watched(labelled, *rest):
        seen.extend((r.row.doc_id, r.tokens) for r in labelled.select("row", "tokens").collect())
        return calibrate(labelled, *rest)

    monkeypatch.setattr(mixing, "calibrate", watched)
    corpus_pipeline.mix(spark, docs(spark, rows), "")
    ids = packing.encode([x[1] for x in rows], packing.tokenizer_files()[0])
    assert sorted(seen) == [(x[0], len(e)) for x, e in zip(rows, ids, strict=True)]


def test_pipeline_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    good = [(k, prose(k, 80) + ".", "en", f"src{k % 20}") for k in range(300)]
    bad = [(k, junk(k), "en", "src1") for k in range(300, 400)]
    same = [(400 + k, prose(k, 80).upper() + ".", "en", "src2") for k in range(3)]
    d = docs(spark, good + bad + same)
    path = fresh_path(spark, "t")
    d.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, int(k < 300), 0) for k in range(400)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    now = spark.read.parquet(f"{path}/documents.parquet")
    seen = [{r.doc_id for r in now.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, path)
        assert now.columns == d.columns, name
        seen.append({r.doc_id for r in now.collect()})
    assert all(b <= a for a, b in zip(seen, seen[1:], strict=False))
    assert len(seen[1] & set(range(300))) == 300 and len(seen[1] & set(range(300, 400))) < 5
    texts, groups = {r[0]: r[1] for r in good + bad + same}, {}
    for k in seen[1]:
        groups.setdefault(texts[k].lower(), []).append(k)
    assert seen[2] == {max(g) for g in groups.values()} and {400, 401, 402} <= seen[2] and len(seen[2]) < len(seen[1])
    brute = {k: shingles(texts[k]) for k in seen[2]}
    near = {b for a in brute for b in brute if a < b and len(brute[a] & brute[b]) >= 0.8 * len(brute[a] | brute[b])}
    assert seen[3] == seen[2] - near
    assert seen[4] < seen[3] and len(seen[4]) > len(seen[3]) // 2
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, path).collect()
    assert {r.doc_id for r in pieces} == seen[4]


def test_arrow_column_of_long_texts_is_whole(spark):
    text = prose(8, 200_000)
    assert simhash.fingerprints(docs(spark, [(1, text)])).first().fp & 0xFFFFFFFFFFFFFFFF == brute_fingerprint(text)
