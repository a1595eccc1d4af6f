"""Resampling against a plain computation, text by text."""

import hashlib
import math
import random
import re
import zlib

import pytest

from scanloom.llm import importance_resampling as r

WORDS = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def runs(text, n):
    w = words(text)
    return [" ".join(w[i:i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, n, buckets, percent, least):
    def bucket(x):
        return zlib.crc32(x.encode()) % buckets

    s, t = [0] * buckets, [0] * buckets
    for side, rows in ((s, docs), (t, target)):
        for _, text in rows:
            for x in runs(text, n):
                side[bucket(x)] += 1
    gains = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    out, able = [], []
    for doc, text in docs:
        weight = sum(gains[bucket(x)] for x in runs(text, n))
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((doc, len(runs(text, n)), weight, score))
        if len(words(text)) >= least:
            able.append((-score, doc is None, doc or 0))
    able.sort()
    drawn = able[:len(able) * percent // 100]
    return sorted(out, key=str), [(i + 1, d, -s) for i, (s, _, d) in enumerate(drawn)]


def check(found, expected):
    rows, drawn = expected
    got = found.collect()
    assert sorted(((x.doc_id, x.n_features, x.weight, x.score) for x in got), key=str) == rows
    assert sorted((x["rank"], x.doc_id or 0, x.score) for x in got if x["rank"] is not None) == drawn


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(12)
    vocabulary = ["the", "The", "of", "été", "straße", "漢字", "a1", "x", "42", "Ünder", "qq"]
    glue = [" ", "  ", "\n", "-", "_", "\x00", "\t", ".", ", "]

    def text():
        return "".join(rng.choice(vocabulary) + rng.choice(glue) for _ in range(rng.randrange(0, 60)))

    return [(i, text()) for i in range(300)] + [(300, None), (301, ""), (302, " \x00 . "), (None, "the of x " * 20), (5, "the of x " * 20),
                                                (5, "the of x " * 20), (303, "word " * 40_000)]


@pytest.mark.parametrize("n, buckets, percent", [(1, 10_000, 10), (2, 97, 50), (3, 1000, 100)])
def test_against_a_plain_computation(spark, texts, n, buckets, percent):
    target = [(None, "the of straße"), (None, "of the 漢字 the of"), (None, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    found = r.resample(docs, spark.createDataFrame(target, "item_id string, text string"), n=n, buckets=buckets, percent=percent)
    check(found, brute(texts, target, n, buckets, percent, 20))


def test_runs_do_not_cross_texts():
    batch = r.Batch([b"", b"A b", b"c", b"", b"d E f"])
    assert batch.words == [b"a", b"b", b"c", b"d", b"e", b"f"] and batch.owner.tolist() == [1, 1, 2, 4, 4, 4]
    seen = []
    owner, _ = batch.runs(2, lambda x: seen.append(x) or 0)
    assert seen == [b"a b", b"d e", b"e f"] and owner.tolist() == [1, 4, 4]
    assert len(r.Batch([]).runs(3, hash)[0]) == 0 and len(r.Batch([b"x"]).runs(2, hash)[0]) == 0


def test_odd_rows(spark, docs, clashing, none):
    from tests.llm.conftest import ROWS

    rows = [(x[0], x[1]) for x in ROWS]
    target = spark.createDataFrame([("fox or dog",)], "text string")
    for df in (docs, clashing):
        check(r.resample(df, target, percent=50, least_words=3), brute(rows, [(None, "fox or dog")], 1, 10_000, 50, 3))
    check(r.resample(docs, target.limit(0), percent=50, least_words=3), brute(rows, [], 1, 10_000, 50, 3))
    assert r.resample(none, target).count() == 0


def test_reruns_agree(spark, docs):
    target = spark.createDataFrame([("fox or dog",)], "text string")
    one, two = (sorted(map(tuple, r.resample(df, target, percent=60, least_words=1).collect()), key=str) for df in (docs, docs.repartition(3)))
    assert one == two
