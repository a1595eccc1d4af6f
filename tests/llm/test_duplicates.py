"""Near and exact duplicates against plain versions."""

import hashlib
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from scanloom.llm import cover_tree_dedup as c
from scanloom.llm import minhash_dedup as m
from scanloom.llm import suffix_dedup as s
from scanloom.llm.graph import components
from tests.llm.conftest import HEAD, ROWS


def joined(nodes, pairs):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, y in pairs:
        x, y = root(x), root(y)
        up[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [tuple(map(int, p)) for p in rng.integers(0, 60, (45, 2))] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 260)]
    want = joined({n for p in pairs for n in p}, pairs)
    got = {r.node: r.component for r in components(spark.createDataFrame([*pairs, (None, 1), (5, 5)], "a long, b long")).collect()}
    assert got == {n: k for n, k in want.items() if any(x != y and n in (x, y) for x, y in pairs)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def near_copies(rng, n=90):
    vocabulary = [f"w{i}" for i in range(4000)]
    base = [[vocabulary[i] for i in rng.integers(0, 4000, 150)] for _ in range(4)]
    rows = []
    for i in range(n):
        own = list(base[i % 4])
        for k in rng.integers(0, 150, rng.integers(0, 9)):
            own[k] = "Edited" + str(rng.integers(0, 50))
        rows.append((i, " ".join(own), "en", "a", 1))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_near_duplicates(spark, seed, monkeypatch):
    monkeypatch.setattr(m, "PACK", 8)
    rows = near_copies(np.random.default_rng(seed)) + [(200 + i, t, "x", "y", 0) for i, t in enumerate(
        [None, "", "  \n", "short one", "SHORT  one", "short two", rows_text(9), rows_text(9)])]
    sets = {d: shingles(t) for d, t, *_ in rows}
    links = [(x, y) for x, y in combinations(sets, 2) if sets[x] and sets[y]
             and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y])]
    want = joined(sets, links)
    got = m.link(spark.createDataFrame(rows, HEAD)).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(d, len(v), want[d], want[d] == d) for d, v in sets.items()}


def rows_text(k):
    return " ".join(f"t{k}-{i}" for i in range(3000))


def test_near_duplicates_of_odd_rows(docs, clashing, none):
    for table in (docs, clashing):
        got = m.link(table).collect()
        assert len(got) == len(ROWS) and all(r.kept for r in got)
        kept = m.keep_one(table)
        assert kept.columns == table.columns and kept.count() == len(ROWS) - 1  # the repeated row
    assert m.link(none).count() == 0 and m.keep_one(none).count() == 0


def plain_repeats(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + 400] for d in data for i in range(len(d) - 399))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - 399):
            if seen[d[i:i + 400]] > 1:
                gone[i:i + 400] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def passages(rng, n=40):
    letters = np.array(list("abcdefgh é\n"))
    text = lambda k: "".join(rng.choice(letters, k))
    shared = [text(k) for k in (399, 400, 401, 700, 1500)]
    rows = [text(rng.integers(0, 900)) + shared[i % 5] + text(rng.integers(0, 500)) + (shared[(i + 1) % 5] if i % 3 else "") for i in range(n)]
    return [*rows, rows[0], rows[0], shared[3], "z" * 1000, "ab" * 350, text(399), "q" * 400, "r" * 401,
            shared[4][:700] + "#" + shared[4][701:], shared[4][:300] + "%" + shared[4][301:], None, ""]


@pytest.mark.parametrize("seed,pairs,block,part", [(0, 8, 512, 4 << 20), (1, 1, 3, 2000), (2, 3, 16, 9000)])
def test_repeated_strings(spark, seed, pairs, block, part, monkeypatch):
    for name, value in (("PAIRS", pairs), ("BLOCK", block), ("PART_BYTES", part), ("PIECE", 1 << 19 if seed else 1500)):
        monkeypatch.setattr(s, name, value)
    texts = passages(np.random.default_rng(seed))
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in s.dedup(spark.createDataFrame(rows, HEAD).repartition(5)).collect()}
    assert [got[i] for i in range(len(texts))] == plain_repeats(texts)


@pytest.mark.parametrize("large", [1, 20])
def test_large_groups_are_counted_on_tables(spark, large, monkeypatch):
    rng = np.random.default_rng(7)
    letters = np.array(list("abcdefgh é\n"))
    text = lambda k: "".join(rng.choice(letters, k))
    footer, short = text(450), text(330)
    texts = [text(rng.integers(100, 600)) + footer + text(rng.integers(0, 300)) for _ in range(30)]
    texts += [text(100) + short + text(100) for _ in range(30)] + passages(rng) + [texts[3], texts[3] + "x", "z" * 1500]
    monkeypatch.setattr(s, "LARGE", large)
    counted, count = [], s.repeats_in_large
    monkeypatch.setattr(s, "repeats_in_large", lambda keys: counted.append(keys.count()) or count(keys))
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in s.dedup(spark.createDataFrame(rows, HEAD).repartition(5)).collect()}
    assert counted and counted[0] > 30
    assert [got[i] for i in range(len(texts))] == plain_repeats(texts)


def test_repeats_of_odd_rows(docs, clashing, none, spark):
    for table in (docs, clashing):
        got = s.dedup(table).collect()
        want = sorted((str(r[0]), *p) for r, p in zip(ROWS, plain_repeats([r[1] for r in ROWS]), strict=True))
        assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert s.dedup(none).count() == 0
    twice = spark.createDataFrame([(1, "ab" * 300, "", "", 1)] * 2 + [(None, "cd" * 300, "", "", 1)] * 2, HEAD)
    assert [(r.n_removed, r.n_spans) for r in s.dedup(twice).collect()] == [(600, 1)] * 4


@pytest.mark.parametrize("n", [2, 8, 9, 60])
def test_ranges_around_an_anchor(n):
    """Against every string of the group; a suffix's ranges neither overlap nor touch."""
    rng = np.random.default_rng(n)
    letters = np.frombuffer(b"ab\0\xff", np.uint8)
    text = lambda k: rng.choice(letters, k).tobytes()
    gram, before, after = text(200), text(300), text(300)
    keys = Counter()
    for _ in range(n):
        left, right = (bytearray(x[:rng.integers(0, 301)] if rng.random() < 0.3 else x) for x in (before[::-1], after))
        for part in (left, right):
            if part and rng.random() < 0.8:
                part[rng.integers(0, len(part))] ^= 1
        doc = bytes(left)[::-1] + gram + bytes(right)
        if len(doc) >= 400:
            keys[s.suffix_at(doc, len(left))] += int(rng.integers(1, 3))
    group = sorted(keys.items())
    strings = [{k: left[len(left) - k:] + right[:400 - k] for k in range(201) if k <= len(left) and 400 - k <= len(right)}
               for left, right in (s.parts_of(key) for key, _ in group)]
    seen = Counter()
    for own, (_, count) in zip(strings, group, strict=True):
        for item in own.items():
            seen[item] += count
    got = s.covered(group)
    assert [[k for low, high in sorted(ranges) for k in range(low, high + 1)] for ranges in got] == [
        sorted(k for k, x in own.items() if seen[k, x] > 1) for own in strings]
    assert all(b > a + 1 for ranges in got for (_, a), (b, _) in zip(sorted(ranges), sorted(ranges)[1:], strict=False))


def test_merge_of_runs():
    rng = np.random.default_rng(0)
    for k in (1, 2, 3, 7):
        runs, everything = [], Counter()
        for _ in range(k):
            own = sorted({bytes(rng.integers(97, 99, rng.integers(0, 12)).astype(np.uint8)) for _ in range(30)})
            everything.update(own)
            blocks = [(*s.front_code(own[i:i + 4]), np.ones(len(own[i:i + 4]), "<u4").tobytes()) for i in range(0, len(own), 4)]
            runs.append(s.Run(blocks))
        got = list(s.merged(runs))
        assert [(key, n) for key, _, n in got] == sorted(everything.items())
        assert [n for _, n, _ in got][1:] == [s.shared(a[0], b[0]) for a, b in zip(got, got[1:], strict=False)]
    assert list(s.merged([])) == []


def vectors(rng):
    heads = rng.normal(size=(12, 6))
    rows = []
    for i in range(260):
        v = heads[i % 12] + rng.normal(size=6) * [0.01, 0.1, 0.3][i % 3]
        rows.append((i, [float(x) for x in v.astype(np.float32)], i % 2 if i % 11 else None))
    rows += [(300 + i, rows[5][1], 1) for i in range(40)] + [(400, None, 1), (401, [0.0] * 6, 1), (402, [float("nan")] + [1.0] * 5, 1),
             (403, [float("inf")] * 6, 1), (404, [None, 1.0, 1.0, 1.0, 1.0, 1.0], 1), (405, [], 1), (406, [1.0, 2.0], 1),
             (407, [2.0, 4.0], 1), (408, [1e30] * 6, 0), (409, [1e-30] * 6, 0), (None, rows[5][1], 1)]
    return rows


@pytest.mark.parametrize("block", [16, 1024])
def test_vectors(spark, block, monkeypatch):
    monkeypatch.setattr(c, "BLOCK", block)
    rows = vectors(np.random.default_rng(3))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    good = {i: (lab, np.array(v, np.float32).astype(float)) for i, v, lab in rows
            if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    unit = {i: (lab, v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max())) for i, (lab, v) in good.items()}
    links = [(x, y) for x, y in combinations(unit, 2) if unit[x][0] == unit[y][0] and len(unit[x][1]) == len(unit[y][1])
             and unit[x][1] @ unit[y][1] >= 0.98]
    want, count = joined([r[0] for r in rows if r[0] is not None], links), Counter(x for p in links for x in p)
    got = c.link(table).collect()
    assert len(got) == len(rows)
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None} == {
        (i, count[i], k, i == k) for i, k in want.items()}
    assert c.link(table.limit(0)).count() == 0
