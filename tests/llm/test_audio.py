"""Audio fingerprints and their search, against plain loops."""

import io
import wave
from collections import Counter

import numpy as np
import pytest

from recordloom.llm import audio


def brute_align(a, b, run=audio.RUN, least=audio.LEAST):
    """(offset, overlap, hits, bit error), by loops over every pair of frames."""
    a, b = [int(x) & 0xFFFFFFFF for x in a], [int(x) & 0xFFFFFFFF for x in b]
    hits = Counter(i - j for i in range(len(a) - run + 1) for j in range(len(b) - run + 1) if a[i : i + run] == b[j : j + run])
    if not hits:
        return None
    offset = min(hits, key=lambda k: (-hits[k], k))
    pairs = [(i, i - offset) for i in range(len(a)) if 0 <= i - offset < len(b)]
    if len(pairs) < least or 2 * len(pairs) < min(len(a), len(b)):
        return None
    return offset, len(pairs), hits[offset], sum((a[i] ^ b[j]).bit_count() for i, j in pairs) / (32 * len(pairs))


def brute_matches(rows, asked):
    """(query, id): alignment, of rows (id, prints)."""
    out = {}
    for q, a in rows:
        for i, b in rows:
            if asked(q) and q != i and (x := brute_align(a, b)) and x[3] <= min(0.2, 0.346 - 6.35 * 0.244 / x[1] ** 0.5):
                out.setdefault((q, i), []).append(x)
    return out


def brute_classes(rows, found):
    root = {i: i for i, _ in rows}

    def find(k):
        return k if root[k] == k else find(root[k])

    same = {}
    for i, p in rows:
        if len(p):
            same.setdefault(tuple(p), []).append(i)
    for a, b in [*found, *((g[0], x) for g in same.values() for x in g)]:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


def song(seed, n=64):
    return audio.vector_audio(list(np.random.default_rng(seed).normal(size=n)))[0]


def prints_of(samples):
    return audio.pack_frames(audio.chroma(samples)).view(np.int32)


def group(r, base, n, noise=0.2):
    """n recordings that play base with small changes."""
    return [prints_of(audio.vector_audio(list(base + noise * r.normal(size=len(base))))[0]) for _ in range(n)]


def recordings():
    r = np.random.default_rng(3)
    rows = [(7 * k, prints_of(song(k))) for k in range(1, 40)]
    rows += [(k, p) for k, p in zip((100, 200, 201, 202, 203, 300, 350), group(r, r.normal(size=64), 7), strict=True)]
    rows += [(k, rows[4][1]) for k in (400, 500, 401, 2)]  # equal recordings, two of them queries
    return rows + [(600, rows[6][1][:70]), (3, rows[7][1][:30]), (5, np.zeros(0, dtype=np.int32))]


@pytest.mark.parametrize("cell", [None, 400])
def test_search_follows_brute_force(spark, monkeypatch, cell):
    if cell:
        monkeypatch.setattr(audio, "BLOCK_INTS", cell)
        monkeypatch.setattr(audio, "PART_INTS", 4 * cell)
    rows = recordings()
    want = brute_matches(rows, lambda i: i % 100 == 0)
    assert {(100, 201), (400, 2), (600, rows[6][0])} <= set(want)
    prints = spark.createDataFrame([(i, [int(x) for x in p]) for i, p in rows] + [(100, [int(x) for x in rows[39][1]])], "id bigint, prints array<int>")
    got = {(m.query_id, m.id): (m.offset, m.overlap, m.hits, m.bit_error) for m in audio.match_recordings(prints, prints.where("id % 100 = 0")).collect()}
    assert got == {k: x[0] for k, x in want.items()}
    told = {m.id: m for m in audio.link_recordings(prints, "id % 100 = 0").collect()}
    assert set(told) == {i for i, _ in rows}
    classes = brute_classes(rows, want)
    for i, m in told.items():
        mine = sorted((x[0][3], q, *x[0][:3]) for (q, k), x in want.items() if k == i)
        assert (m.class_id, m.links) == (classes[i], len(mine))
        assert (m.bit_error, m.query_id, m.offset, m.overlap) == (mine[0][:4] if mine else (None,) * 4)


def test_clips_are_found(spark):
    r = np.random.default_rng(1)
    base = [song(50 + k) for k in range(12)]
    clips = dict(enumerate(base)) | {100: base[3][audio.HOP * 10 :], 200: base[5] + r.normal(size=len(base[5])) * 0.02, 300: np.concatenate([np.zeros(audio.HOP * 7), base[7]]), 301: base[0][:500]}
    rows = [(k, audio.encode_wav(x * 0.9)) for k, x in clips.items()] + [(400, None), (500, b""), (501, b"junk"), (502, audio.encode_wav(base[0])[:60]), (None, audio.encode_wav(base[0])), (3, audio.encode_wav(base[3] * 0.9))]
    prints = audio.fingerprint_audio(spark.createDataFrame([(*x, "clash") for x in rows], "rec bigint, wav binary, prints string"), "rec", "wav").cache()
    assert {p.id for p in prints.collect() if not p.prints} == {301, 400, 500, 501, 502}
    got = {(m.query_id, m.id): m for m in audio.match_recordings(prints, prints.where("id % 100 = 0")).collect()}
    assert {(100, 3), (200, 5), (300, 7)} <= set(got)
    assert got[100, 3].offset == -10 and got[300, 7].offset == 7
    told = {m.id: m for m in audio.link_recordings(prints, "id % 100 = 0").collect()}
    assert told[3].class_id == told[100].class_id == 3 and told[3].links == 1 and told[500].links == 0


def test_recall_and_false_matches():
    """Changed copies are found by the offset histogram, strangers are not, whatever the offset."""
    r = np.random.default_rng(9)
    found = tried = 0
    for _ in range(20):
        a, *copies = group(r, r.normal(size=64), 5, 0.14)
        for b in copies:
            error = float(np.bitwise_count((a ^ b).view(np.uint32)).mean() / 32)
            if error <= audio.most_error(len(a)):
                tried += 1
                found += len(audio.QueryBlock([a]).matches(b)[0])
    assert tried >= 60 and found >= 0.9 * tried
    strangers = [prints_of(song(1000 + k)) for k in range(120)]
    index = audio.QueryBlock(strangers)
    assert sum(len(index.matches(b)[0]) for b in strangers) == len(strangers)  # each itself


def test_query_block_aligns_as_loops(monkeypatch):
    r = np.random.default_rng(2)
    some = [r.integers(0, 4, n).astype(np.int32) for n in (0, 1, 5, 17, 40, 40, 90, 120)] + [np.zeros(60, dtype=np.int32)]
    for at_once in (audio.AT_ONCE, 7):
        monkeypatch.setattr(audio, "AT_ONCE", at_once)
        index = audio.QueryBlock(some)
        for b in some:
            got = {int(q): tuple(x) for q, *x in zip(*index.align(b), strict=True)}
            assert got == {k: x for k, a in enumerate(some) if (x := brute_align(a, b))}
            for k, a in enumerate(some):
                assert audio.align(a, b) == got.get(k)


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_sample_widths(width):
    x = np.sin(np.arange(4000) / 9) * 0.8
    whole = np.round(x * ((1 << (8 * width - 1)) - 1)).astype(np.int64) + (128 if width == 1 else 0)
    raw = b"".join(int(v).to_bytes(width, "little", signed=width > 1) for v in whole for _ in range(2))
    with wave.open(out := io.BytesIO(), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(width)
        w.setframerate(8000)
        w.writeframes(raw)
    got, rate = audio.decode_wav(out.getvalue())
    assert rate == 8000 and np.abs(got - x).max() < 0.02


def test_odd_input(spark):
    assert len(audio.vector_audio(None)[0]) == len(audio.vector_audio([])[0]) == 0
    assert np.isfinite(audio.vector_audio([None, 0.0, float("nan")])[0]).all()
    none = spark.createDataFrame([], "id bigint, prints array<int>")
    assert audio.link_recordings(none, "true").count() == 0
