"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Base spans (email, ip, card, phone) follow fixed rules and always stay. Candidates are the base
spans and looser ones: written-out addresses (`jo (at) mail (dot) org`), digit groups shaped like
phone numbers or cards that the rules turn down, dotted numbers out of range; and kinds that no base
rule knows (`private_kinds`): names, streets, birth dates, account numbers, handles, secrets. On each
candidate six labelers vote yes, no or not at all: strict shape, validity (checksum, ranges),
gazetteers (top-level domains, card issuers, reserved networks; name words learned from all texts by
`name_words`), words before it, isolation and grouping or surroundings.

Expectation-maximisation over the counts of vote patterns estimates, per kind, how often private
data are among the candidates and how reliable each labeler is. Its posteriors are the soft labels
of a logistic classifier over votes and shape; candidates that it gives at least `least` are
added. What reaches the driver is a row per vote pattern, of which there are a fixed number.

Offsets are code points, ends exclusive. Null and empty texts have no spans. Repeated rows give
repeated results; null keys stay null; an empty table gives no rows (and no added spans). Texts of any length
are searched whole; of candidates of one kind that overlap the first stays, then the longest.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm import private_kinds
from scanloom.llm.common import lean, save, slices

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = KINDS + private_kinds.ADDED
#: Probability from which a candidate that no base rule covers is added.
LEAST = 0.9
LABELERS = 6
SHAPES = 4  # binned shape features, three values each
#: Rates of no opinion, no and yes that EM starts from, where there is no private data and where there is; and their weight as a prior.
START, PRIOR = np.array([[0.34, 0.46, 0.2], [0.34, 0.13, 0.53]]), 10

SPANS = "array<struct<kind:int,first:int,last:int,base:boolean,pattern:int>>"

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
# A match of the address pattern that starts within a run of digits also starts at its head, so
# looking behind changes nothing but the time that long runs take.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WRITTEN = re.compile(r"[\[(] ?at ?[\])]", re.I)
_WRITTEN_HOST = re.compile(r" ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[A-Za-z0-9-]{1,63}){1,8}", re.I)
_LOOSE_PHONE = re.compile(r"(?<![0-9+)])(?:\+[0-9]{1,3} ?)?\([0-9]{2,4}\)[ -]?[0-9]{3,4}[ -]?[0-9]{3,4}(?![0-9])")
_WORD = re.compile(r"[^\W\d_]+")

# Common top-level domains, words that announce a kind, words that speak against one.
DOMAINS = frozenset("com org net edu gov int info biz io de fr es uk us it nl ch at be eu ca au jp cn in br mx ar".split())
CUES = (
    frozenset("mail email e contact write schreib courriel correo contacto kontakt".split()),
    frozenset("ip address addr host server login adresse servidor from".split()),
    frozenset("card visa mastercard credit debit kredit karte carte tarjeta pay payment".split()),
    frozenset("phone tel telephone call mobile cell fax telefon appelez anruf llame".split()),
)
AGAINST = frozenset("version build release isbn issn order invoice section chapter serial part no nr id".split())


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(int(d) for d in digits[-1::-2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses. Every match has one @; the part before it is a whole run, cut at the match before."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        low = max(done, text.rfind("@", 0, at) + 1)
        run = _LOCAL.match(text[low:at][::-1]).end()
        host = _DOMAIN.match(text, at + 1)
        if run and host:
            out.append((at - run, host.end()))
            done = host.end()
        at = text.find("@", max(at + 1, done))
    return out


def _octets(value: str) -> list[str]:
    return [p.lstrip("0") or "0" for p in value.split(".")]


def _in_range(value: str) -> bool:
    return all(len(p) <= 3 and int(p) <= 255 for p in _octets(value))


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of the four kinds, in their order."""
    out: list[list[tuple[int, int]]] = [emails(text) if "@" in text else [], [], [], []]
    if _DIGIT.search(text):
        out[1] = [m.span() for m in _IP.finditer(text) if _in_range(m[0])]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out[2].append(m.span())
        if "+" in text:
            out[3] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


def loose_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of candidates beyond the base rules."""
    out = []
    if ("(" in text or "[" in text) and _WRITTEN.search(text):
        done = 0
        for m in _WRITTEN.finditer(text):
            before = text[done:m.start()].rstrip(" ")[::-1]
            run, host = _LOCAL.match(before).end(), _WRITTEN_HOST.match(text, m.end())
            if run and host:
                out.append((0, done + len(before) - run, host.end()))
                done = host.end()
    if _DIGIT.search(text):
        out += [(1, *m.span()) for m in _IP.finditer(text) if not _in_range(m[0])]
        for m in _CARD.finditer(text):
            n = len(m[0]) - m[0].count(" ") - m[0].count("-")
            if 13 <= n <= 19:
                out.append((2, *m.span()))
        if "(" in text:
            out += [(3, *m.span()) for m in _LOOSE_PHONE.finditer(text)]
    return out


def votes(text: str, kind: int, start: int, end: int, base: bool, names: bytes = b"") -> int:
    """The labelers' votes (0 none, 1 no, 2 yes) and binned shape of a span as one number."""
    value = text[start:end]
    digits = "".join(_DIGIT.findall(value))
    if kind >= len(KINDS):
        return _coded(private_kinds.votes(text, kind - len(KINDS), start, end, names), value, digits)
    words = [w.lower() for w in _WORD.findall(text[max(0, start - 40):start])][-5:]
    shape = 2 if base else 0
    if kind == 0:
        tail = re.split(r"[.\])]", value.rstrip(")]"))[-1].strip().lower()
        valid = 2 if tail.isalpha() and len(tail) > 1 else 1
        listed = 2 if tail in DOMAINS else 1
        grouped = 0
    elif kind == 1:
        octets = _octets(value)
        valid = 2 if _in_range(value) else 1
        listed = 1 if octets[0] in ("0", "127", "255") else 0
        grouped = 2 if all(p == o for p, o in zip(value.split("."), octets, strict=True)) else 1
    elif kind == 2:
        valid = 2 if luhn(digits) else 1
        listed = 2 if digits[0] in "3456" else 1
        sizes = {len(p) for p in re.split("[ -]", value)[:-1]}
        grouped = 2 if sizes <= {4} else 1
    else:
        valid = 2 if 10 <= len(digits) <= 15 else 1
        listed = 0 if value[0] != "+" else 1 if value[1] == "0" else 2
        grouped = 2 if ")" in value or "-" in value or " " in value else 0
    context = 2 if not CUES[kind].isdisjoint(words) else 1 if not AGAINST.isdisjoint(words[-2:]) else 0
    sides = text[start - 1:start] + text[end:end + 1]
    apart = 1 if any(c.isalnum() for c in sides) else 2
    return _coded((shape, valid, listed, context, apart, grouped), value, digits)


def _coded(labels: tuple[int, ...], value: str, digits: str) -> int:
    share = len(digits) / max(1, len(value))
    bins = (min(2, len(value) // 14), int(share * 2.99), min(2, sum(value.count(c) for c in " -.()") // 2),
            min(2, len(digits) // 8))
    code = 0
    for v in (*labels, *bins):
        code = 3 * code + v
    return code


def candidates(text: str, names: bytes = b"") -> list[tuple[int, int, int, bool, int]]:
    """(kind, start, end, base, pattern) by kind, then start; loose spans that meet a base span are left out."""
    base = [(k, a, b) for k, own in enumerate(base_spans(text)) for a, b in own]
    taken = sorted((a, b) for _, a, b in base)
    loose, done, ends = [], 0, [0] * len(ALL_KINDS)
    more = [(k + len(KINDS), a, b) for k, a, b in private_kinds.find(text)]
    for a, b, k in sorted(((a, b, k) for k, a, b in [*loose_spans(text), *more]), key=lambda c: (c[0], -c[1], c[2])):
        if k >= len(KINDS):
            if a < ends[k]:
                continue
            ends[k] = b
        while done < len(taken) and taken[done][1] <= a:
            done += 1
        if not any(x < b and a < y for x, y in taken[done:done + 4]):
            loose.append((k, a, b))
    rows = [(k, a, b, True) for k, a, b in base] + [(k, a, b, False) for k, a, b in loose]
    return [(k, a, b, s, votes(text, k, a, b, s, names)) for k, a, b, s in sorted(rows)]


# --- reliabilities and classifier ------------------------------------------------------------

def unpacked(patterns: np.ndarray) -> np.ndarray:
    """Rows of votes and shape bins."""
    return np.stack([patterns // 3 ** (LABELERS + SHAPES - 1 - k) % 3 for k in range(LABELERS + SHAPES)], 1)


def estimate(votes_: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of each pattern, rates by truth, labeler and vote, share of private data). Labelers are independent given the truth; their tables of vote rates are estimated by EM.

    It starts from labelers that are right four times in five, which also settles which class is which.
    """
    n, start = votes_.shape[1], START
    rates = np.repeat(start[:, None, :], n, 1)  # truth, labeler, vote
    share = 0.5
    for _ in range(rounds):
        like = [np.log(rates[t, np.arange(n), votes_]).sum(1) for t in (0, 1)]
        odds = like[1] - like[0] + np.log(share / (1 - share))
        post = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        share = float((counts @ post + 1) / (counts.sum() + 2))
        for t, weight in enumerate((counts * (1 - post), counts * post)):
            for v in range(3):
                # A prior worth ten candidates holds a labeler near its start where data are few.
                rates[t, :, v] = (weight @ (votes_ == v) + PRIOR * start[t, v]) / (weight.sum() + PRIOR)
    return post, rates, share


def evidence(votes_: np.ndarray, counts: np.ndarray, rates: np.ndarray, share: float) -> float:
    """What the rounds of `estimate` raise: log likelihood of the votes plus the log priors."""
    n = votes_.shape[1]
    like = [rates[t, np.arange(n), votes_].prod(1) for t in (0, 1)]
    prior = PRIOR * (START[:, None, :] * np.log(rates)).sum() + np.log(share) + np.log(1 - share)
    return float(counts @ np.log((1 - share) * like[0] + share * like[1]) + prior)


def fit_classifier(x: np.ndarray, soft: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - soft)) + ridge * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def decisions(rows: list[tuple[int, int, int]]) -> dict[tuple[int, int], float]:
    """Probability of every (kind, pattern) from their counts."""
    out: dict[tuple[int, int], float] = {}
    for kind in range(len(ALL_KINDS)):
        own = sorted((p, n) for k, p, n in rows if k == kind)
        if not own:
            continue
        patterns, counts = np.array([p for p, _ in own]), np.array([n for _, n in own], float)
        full = unpacked(patterns)
        soft = estimate(full[:, :LABELERS], counts)[0]
        x = np.concatenate([np.ones((len(full), 1)), *[(full == v).astype(float) for v in (1, 2)]], 1)
        w = fit_classifier(x, soft, counts)
        out |= {(kind, int(p)): float(s) for p, s in zip(patterns, 1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), strict=True)}
    return out


# --- on tables -------------------------------------------------------------------------------

def name_words(docs: DataFrame, text: str = "text") -> bytes:
    """The learned gazetteer of name words, a bit per bucket, from all texts. Tasks count by bucket first, so at most
    `private_kinds.BUCKETS` rows come from a task and reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, every = np.zeros(private_kinds.BUCKETS, np.int64), np.zeros(private_kinds.BUCKETS, np.int64)
        for batch in slices(batches, 0):
            private_kinds.tally([t for t in batch.column(0).to_pylist() if t], told, every)
        seen = np.flatnonzero(told)  # a word that nothing announces is not listed, whatever its count
        told_all = pa.RecordBatch.from_arrays([pa.array(seen), pa.array(told[seen]), pa.array(every[seen])], ["bucket", "told", "every"])
        rest = np.flatnonzero((every > 0) & (told == 0))
        yield told_all
        yield pa.RecordBatch.from_arrays([pa.array(rest), pa.array(told[rest]), pa.array(every[rest])], ["bucket", "told", "every"])

    sums = (docs.select(F.col(text).cast("string")).mapInArrow(lean(run), "bucket long, told long, every long")
            .groupBy("bucket").agg(F.sum("told").alias("told"), F.sum("every").alias("every")).filter("told > 0"))
    return private_kinds.listed_bits([(r.bucket, r.told, r.every) for r in sums.collect()])


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", names: bytes = b"") -> DataFrame:
    """(doc_id, spans) with all candidates of whole texts; no shuffle. `names` is the gazetteer of `name_words`."""
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("first", pa.int32()), ("last", pa.int32()),
                               ("base", pa.bool_()), ("pattern", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ("kind", "first", "last", "base", "pattern")
        for batch in slices(batches, 1):
            rows = [[dict(zip(fields, c, strict=True)) for c in candidates(t, names)] if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(lean(run), f"doc_id long, spans {SPANS}")


def learn(found: DataFrame) -> dict[tuple[int, int], float]:
    """Patterns are counted over all documents; at most 10 * 3**10 rows can come back, some hundreds do."""
    counts = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.pattern").agg(F.count("*").alias("n"))
    return decisions([(r.kind, r.pattern, r.n) for r in counts.collect()])


def kept(spans: list, model: dict[tuple[int, int], float], least: float = LEAST) -> list[tuple[int, int, int, bool]]:
    return [(s[0], s[1], s[2], s[3]) for s in spans if s[3] or model.get((s[0], s[4]), 0.0) >= least]


def spelled_out(spans: list[tuple[int, int, int, bool]]) -> str:
    return ",".join(f"{ALL_KINDS[k]}:{a}:{b}" for k, a, b, _ in spans)


def report(found: DataFrame, model: dict[tuple[int, int], float], least: float = LEAST) -> DataFrame:
    """Counts and digests of the kept spans per row of `find`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [kept([tuple(s.values()) for s in row], model, least) for row in batch.column(1).to_pylist()]
            base = [[s for s in row if s[3]] for row in own]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), *[pa.array([sum(s[0] == k for s in row) for row in base], pa.int64()) for k in range(len(KINDS))],
                pa.array([hashlib.sha256(spelled_out(row).encode()).hexdigest() for row in base]),
                pa.array([spelled_out(row) for row in own], pa.string()),
                pa.array([len(a) - len(b) for a, b in zip(own, base, strict=True)], pa.int64()),
            ], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])

    return found.mapInArrow(lean(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
                                 "n_added long")


def redact(docs: DataFrame, model: dict[tuple[int, int], float], text: str = "text", least: float = LEAST, names: bytes = b"") -> DataFrame:
    """The rows with every kept span of their texts replaced by its kind in brackets; all else unchanged."""
    place, schema = docs.columns.index(text), docs.schema

    def clean(value: str | None) -> str | None:
        if not value:
            return value
        spans = sorted((a, b, k) for k, a, b, _ in kept(candidates(value, names), model, least))
        out, done = [], 0
        for a, b, k in spans:
            if a >= done:
                out += [value[done:a], f"[{ALL_KINDS[k].upper()}]"]
            done = max(done, b)
        return "".join([*out, value[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, place):
            new = pa.array([clean(t) for t in batch.column(place).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if k == place else c for k, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(lean(run), schema)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = save(find(docs, names=name_words(docs)), "spans")
    return report(found, learn(found))
