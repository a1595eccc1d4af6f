"""Every built-in rule on a text it must catch and, for many, one it must not."""

import pytest

from scanloom import builtin_rules, scan, scan_scoped
from scanloom.functions.paths import K8S_SIGNATURE
from scanloom.operators.scopes import SCOPE_RULES
from scanloom.rules.literals import gate_pieces, gate_regex, needed_literals
from workload.samples import SAMPLES, SCOPE_SAMPLES


@pytest.fixture(scope="module")
def found(spark):
    rows = [(f"r/s{i}/{name}", text + "\n") for i, (_, name, text, _) in enumerate(SAMPLES)]
    files = spark.createDataFrame(rows, "path string, content string")
    counts = scan(files, builtin_rules()).groupBy("location.file", "code").count().collect()
    return {(r["file"], r["code"]): r["count"] for r in counts}


@pytest.mark.parametrize("i", range(len(SAMPLES)))
def test_sample(found, i):
    code, name, _, expected = SAMPLES[i]
    assert found.get((f"r/s{i}/{name}", code), 0) == expected


def test_every_code_has_a_sample():
    sampled = {code for code, _, _, n in SAMPLES if n}
    assert {r.code for r in builtin_rules()} == sampled
    assert len(sampled | {r.code for r in SCOPE_RULES}) == 127


def test_literals_are_necessary():
    import re

    for code, _, text, n in SAMPLES:
        for r in builtin_rules():
            if r.code == code and n and re.search(r.pattern.replace(r"\x{FEFF}", "﻿"), text):
                needles, fold = needed_literals(r.pattern)
                hay = text.lower() if fold else text
                assert not needles or any(x in hay for x in needles)


def test_literals_of_shapes():
    assert needed_literals(r"\bfoo\s*\(") == (("foo",), False)
    assert needed_literals(r"(?i)Hello\s+there") in ((("hello",), True), (("there",), True))
    assert needed_literals(r"a*b?") == ((), False)
    assert set(needed_literals("abc|defg")[0]) == {"abc", "defg"}
    assert needed_literals("(?:abc)?x")[0] == ()
    assert "apiVersion:" in needed_literals(K8S_SIGNATURE)[0]


def test_scope_samples(spark):
    rows = [(f"r/s{i}/{name}", text + "\n") for i, (_, name, text, _) in enumerate(SCOPE_SAMPLES)]
    found = scan_scoped(spark.createDataFrame(rows, "path string, content string")).collect()
    for i, (code, name, _, expected) in enumerate(SCOPE_SAMPLES):
        assert sum(r.location.file == f"r/s{i}/{name}" and r.code == code for r in found) == expected, (i, code)
    texts = dict(rows)
    tokens = {"PERF-001": "format", "PERF-101": "await", "PERF-102": "new Date(", "PERF-201": None, "PERF-202": "time.sleep(",
              "PERF-301": "defer", "PERF-302": "fmt.Sprintf("}
    for r in found:
        at = r.location
        token = texts[at.file].encode()[at.byte_offset:at.byte_offset + at.byte_length].decode()
        assert tokens[r.code] in (None, token)
        assert texts[at.file].split("\n")[at.line - 1][at.column - 1:].startswith(token)


def test_gate_finds_a_piece_of_every_match():
    import re

    rules = builtin_rules()
    pieces = gate_pieces(tuple(r.pattern for r in rules))
    gate = re.compile(gate_regex({p for ps in pieces for p in ps}).replace("(?i)", ""), re.I)
    for code, _, text, n in SAMPLES:
        for r, asked in zip(rules, pieces):
            if r.code == code and n and asked and re.search(r.pattern.replace(r"\x{FEFF}", "\ufeff"), text):
                assert {m.lower() for m in gate.findall(text)} & set(asked), (code, asked)


def test_no_piece_starts_another():
    every = sorted({p for ps in gate_pieces(tuple(r.pattern for r in builtin_rules())) for p in ps})
    assert not [(a, b) for a in every for b in every if a != b and b.startswith(a)]
    assert needed_literals(r"\([^()]*[+*]\)[+*]")[0] == ("+)+", "+)*", "*)+", "*)*")
