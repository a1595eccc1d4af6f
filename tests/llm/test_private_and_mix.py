"""Personal data and source mixes against plain versions."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.llm import private_spans as s
from scanloom.llm import source_mix as m
from tests.llm.conftest import HEAD, ROWS

RULES = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    out = []
    for kind, rule in enumerate(RULES):
        own = []
        for x in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", x[0])
            if (kind == 0 or kind == 1 and all(int(p) <= 255 for p in x[0].split("."))
                    or kind == 2 and 13 <= len(digits) <= 19 and s.luhn(digits) or kind == 3 and 9 <= len(digits) <= 15):
                own.append(x.span())
        out.append(own)
    return out


def test_luhn():
    assert s.luhn("4111111111111111") and not s.luhn("4111111111111112") and s.luhn("79927398713")


@pytest.mark.parametrize("seed", range(8))
def test_base_spans(seed):
    rng = np.random.default_rng(seed)
    for letters in ("ab@.-+% ", "0123456789. -", "+(0123456789) .-a", "a@b.c@d.e..@"):
        for _ in range(150):
            text = "".join(rng.choice(list(letters), rng.integers(0, 60)))
            assert s.base_spans(text) == plain(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "+1" * 200_000, "@" * 400_000, "a@" * 200_000):
        s.candidates(text)


def test_written_out_and_run_together():
    kinds = lambda text: [(c[0], text[c[1]:c[2]]) for c in s.candidates(text) if not c[3]]
    assert kinds("write jo.doe (at) mail (dot) org today") == [(0, "jo.doe (at) mail (dot) org")]
    assert (3, "+1 (826) 555-4081") in kinds("call +1 (826) 555-4081 190.137.2.9 x")


def test_estimates_follow_the_labelers():
    sure, unsure = 0, 0
    for v in (2, 2, 2, 2, 2, 2, 1, 1, 1, 1):
        sure = 3 * sure + v
    for v in (0, 1, 1, 1, 1, 1, 1, 1, 1, 1):
        unsure = 3 * unsure + v
    found = s.decisions([(2, sure, 100), (2, unsure, 300)])
    assert found[2, sure] > 0.9 and found[2, unsure] < 0.1 and s.decisions([]) == {}


def test_report_and_redaction(docs, clashing, none):
    for table in (docs, clashing):
        found = s.find(table)
        model = s.learn(found)
        rows = s.report(found, model).collect()
        want = sorted((str(d), hashlib.sha256(",".join(
            f"{k}:{a}:{b}" for k, own in zip(s.KINDS, plain(t or ""), strict=True) for a, b in own).encode()).hexdigest()) for d, t, *_ in ROWS)
        assert sorted((str(r.doc_id), r.base_sha256) for r in rows) == want
        clean = s.redact(table, model)
        assert clean.columns == table.columns and clean.count() == len(ROWS)
        assert not any(any(plain(r.text or "")) for r in clean.collect())
    assert s.report(s.find(none), {}).count() == 0 and s.learn(s.find(none)) == {} and s.redact(none, {}).count() == 0


def test_targets():
    assert m.targets([]) == [] and m.targets([0, 0]) == [0.0, 0.0]
    got = m.targets([10, 100, 100])
    assert got[0] == 20 and sum(got) == pytest.approx(315) and got[1] == pytest.approx(2 * got[2], rel=1e-9) or got[1] == 200


@pytest.mark.parametrize("seed", range(40))
def test_fit_reaches_what_is_reachable(seed):
    rng = np.random.default_rng(seed)
    lengths = np.unique(rng.integers(1, 40, rng.integers(1, 8)))
    counts = rng.integers(1, 5, len(lengths))
    total = int(lengths @ counts)
    target = float(rng.uniform(0, 2 * total))
    rounds, more = m.fit_lengths(lengths, counts, target)
    assert (more >= 0).all() and (more <= counts).all()
    sums = {0}
    for n, c in zip(lengths.tolist(), counts.tolist(), strict=True):
        sums = {x + k * n for x in sums for k in range(c + 1)}
    got = int(rounds) * total + int(lengths @ more)
    assert abs(got - target) <= max(lengths)
    assert int(lengths @ more) in sums


def test_mix(spark, docs, clashing, none):
    rows = [(i, "w " * (i % 7 + 1), "en", f"s{i % 3}", 1) for i in range(900)] + [(1000 + i, "same text here", "en", "hot", 1) for i in range(500)]
    big = spark.createDataFrame(rows, HEAD)
    found = m.mix(big).collect()
    assert len(found) == len(rows) and all(r.copies in (0, 1, 2) for r in found)
    for source in {r.source for r in found}:
        own = [r for r in found if r.source == source]
        assert abs(sum(r.size * r.copies for r in own) - own[0].target) <= 3
    assert {(r.doc_id, r.copies) for r in found} == {(r.doc_id, r.copies) for r in m.mix(big).collect()}
    taken = m.take(big)
    assert taken.columns == big.columns and taken.count() == sum(r.copies for r in found)
    for table in (docs, clashing):
        assert m.mix(table).count() == len(ROWS)
        assert m.take(table).count() == sum(r.copies for r in m.mix(table).collect())
    assert m.mix(none).count() == 0 and m.take(none).count() == 0


def test_words(spark):
    for text in (None, "", " ", "a", " a\x0b b\r\n\tc\x1cd　e ", "a\n" * 50):


        n = spark.createDataFrame([(text,)], "t string").select(m.words(F.col("t"))).first()[0]
        assert n == len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
