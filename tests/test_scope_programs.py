"""Scope checks on random nested programs whose loops and functions are known from how they were made."""

import random

import pytest

import scanloom as sl

# language: (loop header, function header, asynchronous function header, lines as (text, token, code, needs))
LANGUAGES = {
    "py": ("for x in xs:", "def f():", "async def g():",
           [('text += "a"', 'text', "PERF-201", "loop"), ("time.sleep(1)", "time.sleep(", "PERF-202", "async"), ("y = 1", None, None, None)]),
    "js": ("for (const x of xs) {", "function f() {", "async function g() {",
           [("await f(x);", "await", "PERF-101", "loop"), ("const d = new Date();", "new Date(", "PERF-102", "loop"), ("g(x);", None, None, None)]),
    "rs": ("for x in xs {", "fn f() {", "fn g() {",
           [('s += &format!("{}", x);', "format", "PERF-001", "loop"), ("let y = 1;", None, None, None)]),
    "go": ("for _, x := range xs {", "go func() {", "func() {",
           [("defer f.Close()", "defer", "PERF-301", "loop"), ('s := fmt.Sprintf("%d", x)', "fmt.Sprintf(", "PERF-302", "loop"), ("g(x)", None, None, None)]),
}


def program(language: str, seed: int) -> tuple[str, list[tuple[str, int, int, str]]]:
    """(text, (code, line, column, token) of every hit)."""
    r, (loop, plain, asynchronous, statements) = random.Random(seed), LANGUAGES[language]
    lines, hits = [], []

    def block(depth: int, top: str | None, inner: str | None) -> None:
        for k in range(r.randrange(1, 4)):
            pad = "    " * depth
            kind = r.choice(["loop", "def", "async"]) if k and depth < 5 and r.random() < 0.7 else None
            if kind:
                lines.append(pad + {"loop": loop, "def": plain, "async": asynchronous}[kind])
                block(depth + 1, kind, inner if kind == "loop" else kind)
                if language != "py":
                    lines.append(pad + "}")
            if r.random() < 0.2:
                lines.append(r.choice(["", "# ", "    # "]) + "größe ✓" if language == "py" else r.choice(["", pad + "// größe ✓"]))
                lines[-1] = lines[-1] if language != "py" or "#" in lines[-1] else ""
            text, token, code, needs = r.choice(statements)
            lines.append(pad + text)
            if code and (top == "loop" if needs == "loop" else inner == "async"):
                hits.append((code, len(lines), len(pad) + text.index(token) + 1, token))

    for _ in range(4):
        block(0, None, None)
    return "\n".join(lines) + "\n", hits


@pytest.fixture(scope="module")
def programs():
    return {f"app/p{seed}.{language}": program(language, seed) for language in LANGUAGES for seed in range(40)}


def places(findings, texts):
    """(file, code, line, column, text at the finding's bytes)."""
    out = []
    for f in findings:
        at = f.location
        data = texts[at.file][0].encode()
        out.append((at.file, f.code, at.line, at.column, data[at.byte_offset:at.byte_offset + at.byte_length].decode()))
    return sorted(out)


def expected(texts):
    return sorted((file, code, line, column) for file, (_, hits) in texts.items() for code, line, column, _ in hits)


def test_programs_hold_all_codes(programs):
    assert {code for _, code, _, _ in expected(programs)} == {
        "PERF-001", "PERF-101", "PERF-102", "PERF-201", "PERF-202", "PERF-301", "PERF-302"}


def test_scopes_of_nested_programs(spark, programs):
    files = spark.createDataFrame([(p, t) for p, (t, _) in programs.items()], "path string, content string")
    got = places(sl.scan_scoped(files).collect(), programs)
    assert [g[:4] for g in got] == expected(programs)
    tokens = {(file, code, line): token for file, (_, hits) in programs.items() for code, line, _, token in hits}
    assert all(text.startswith(tokens[file, code, line]) for file, code, line, _, text in got)


def test_a_whole_audit_holds_every_scope_finding(spark, programs):
    files = spark.createDataFrame([(p, t, len(t.encode())) for p, (t, _) in programs.items()], "path string, content string, size long")
    codes = {code for _, code, _, _ in expected(programs)}
    found = sl.audit(files, sl.AuditConfig(include_minified=True)).findings
    got = places([f for f in found.collect() if f.code in codes], programs)
    assert [g[:4] for g in got] == expected(programs)
