"""Phrases against plain counting of all runs."""

import random
import re
from collections import Counter

import pytest

from scanloom.llm import phrase_collocations as p


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, least, longest=5, absorb=100, most=2000):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n-\r]", lower(text or "")):
            w = re.findall("[^ \t]+", piece)
            total[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                counts.update((lang or "und", tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    often = {key: n for key, n in counts.items() if len(key[1]) > 1 and n >= least}
    inside = Counter()  # the most frequent longer candidate around a phrase
    for (lang, w), n in often.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i:i + k]] = max(inside[lang, w[i:i + k]], n)
    found = {}
    for (lang, w), a in often.items():
        if 100 * inside[lang, w] >= absorb * a:
            continue
        cuts = []
        for k in range(1, len(w)):
            x, y = counts[lang, w[:k]], counts[lang, w[k:]]
            cuts.append((1000 * a * total[lang] // (x * y), k, x, y))
        s, _, x, y = min(cuts)
        found.setdefault(lang, []).append((-s, -a, " ".join(w).encode(), x, y))
    return sorted((lang, i + 1, w.decode(), -a, x, y, total[lang], -s)
                  for lang, own in found.items() for i, (s, a, w, x, y) in enumerate(sorted(own)[:most]))


def got(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(13)
    words = ["the", "The", "of", "a", "été", "漢字", "x\x00y", "c", "d", "e", "f", "g"]
    passage = "One two three four five six seven eight nine ten eleven twelve, a b"
    rows = []
    for i in range(500):
        parts = [rng.choice(words) for _ in range(rng.randrange(0, 40))]
        if i % 3 == 0:
            parts.append(passage)
        rows.append((rng.choice(["en", "en", "de", None, "und"]), "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", ";", "\x0b", "\x0c", "\r", "! "]) for w in parts)))
    return [*rows, ("en", None), ("en", ""), ("xx", " . "), (None, "the the the the the the the"), ("en", "z " * 30_000), ("fr", "only once here")]


@pytest.mark.parametrize("least, longest, absorb, bits", [(20, 5, 100, 1 << 26), (5, 4, 80, 1 << 26), (30, 2, 100, 1 << 18), (3, 5, 100, 1 << 18)])
def test_against_plain_counting(spark, texts, least, longest, absorb, bits):
    docs = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "doc_id long, lang string, text string").repartition(6)
    found = p.best(p.collocations(docs, least=least, longest=longest, absorb=absorb, bits=bits), 200)
    assert got(found) == brute(texts, least, longest, absorb, 200)


def test_a_full_map_changes_nothing(spark, texts, monkeypatch):
    """Pairs that share a bit with frequent ones are kept, not counted wrong."""
    docs = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")
    plain = p.longest_runs(docs.selectExpr("coalesce(lang, 'und') lang", "text"), None)
    assert plain.filter("k = 5").count() > 100
    assert plain.selectExpr("sum(n)").first()[0] == sum(len(re.findall("[^ \t.,;:!?\n-\r]+", t or "")) for _, t in texts)


def test_paths(spark):
    runs = [("en", "a b c d e", 7), ("en", "b c d e f", 7), ("en", "c d e f g", 7), ("en", "d e f g h", 5), ("de", "a b c d e", 3), ("en", "q q q q q", 9)]
    nodes = [("en", "b c d e", 7), ("en", "c d e f", 7), ("en", "d e f g", 7), ("en", "a b c d", 7), ("en", "e f g h", 5), ("en", "q q q q", 10), ("de", "b c d e", 3)]
    kind = "lang string, phrase string, f long"
    paths, inner = p.compact(spark.createDataFrame(runs, kind), spark.createDataFrame(nodes, kind))
    spelled = {(r.lang, r.phrase): (r.n_edges, r.f) for r in p.spell(paths).collect()}
    assert spelled == {("en", "a b c d e f g"): (3, 7), ("en", "d e f g h"): (1, 5), ("de", "a b c d e"): (1, 3), ("en", "q q q q q"): (1, 9)}
    assert {r.phrase for r in inner.collect()} == {"b c d e", "c d e f"}


def test_long_paths(spark):
    words = [f"w{i}" for i in range(300)]
    kind = "lang string, phrase string, f long"
    edges = spark.createDataFrame([("en", " ".join(words[i:i + 5]), 2) for i in range(296)], kind)
    nodes = spark.createDataFrame([("en", " ".join(words[i:i + 4]), 2) for i in range(297)], kind)
    assert [tuple(r) for r in p.spell(p.compact(edges, nodes)[0]).collect()] == [("en", " ".join(words), 296, 2)]


def test_scores_beyond_64_bits(spark):
    rows = [(9_007_199_254_740, 9_007_199_254_741, 9_007_199_254_743, 9_223_372_036_854_775_807), (3, 3, 3, 10), (7, 7, 11, 10**15), (5, 7, 11, 13)]
    df = spark.createDataFrame(rows, "a long, l long, r long, n long")
    assert [r[0] for r in df.select(p.score()).collect()] == [1000 * a * n // (x * y) for a, x, y, n in rows]


def test_odd_rows(spark, docs, clashing, none):
    from tests.llm.conftest import ROWS

    rows = [(r[2], r[1]) for r in ROWS]
    for df in (docs, clashing):
        assert got(p.best(p.collocations(df, least=2))) == brute(rows, 2)
    assert p.collocations(none).count() == 0
