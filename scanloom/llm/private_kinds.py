"""Candidates and labelers for personal data that no fixed rule finds: names, streets, birth dates, account numbers, handles, secrets.

A finder returns every span of a loose form; most are harmless. Six labelers vote on each (0 no opinion, 1 no, 2 yes): form,
validity, a list (learned or fixed), words before, isolation, what follows or surrounds. A labeler that only ever speaks
against a span abstains where it has nothing against it, so that being well-formed alone is no evidence.

Name words are learned from the corpus: a word that titles and salutations announce often, measured against all its capitalised
occurrences, is listed. Counts are kept by hash bucket, so their size is fixed (`BUCKETS`) and all texts count; words that share
a bucket share its verdict, which is one vote of six.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np

ADDED = ("name", "street", "birth", "account", "handle", "secret")
BUCKETS = 1 << 18
#: A word is listed if it was announced so often, and in so large a part of its capitalised occurrences.
ANNOUNCED, PART = 3, 0.05

_CAP = "[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ'’]{1,24}"
_CAPITAL = re.compile(rf"\b{_CAP}\b")
_FULL = re.compile(rf"\b{_CAP}(?:[ -]{_CAP}){{1,3}}\b")
# Titles and salutations, words that announce a kind, words that speak against one.
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Monsieur Madame Señor Señora Sir Dear Liebe Lieber Cher Chère Regards Sincerely Signed".split()
_TITLED = re.compile(rf"\b(?:{'|'.join(TITLES)})\b[.,]?\s{{1,2}}({_CAP}(?:[ -]{_CAP}){{0,2}})\b")
NAME_CUES = frozenset("name named called patient customer client author contact by from signed met told asked heißt nombre nom".split())
NAME_AFTER = frozenset("wrote said says told asked lives born called signed schrieb sagte wohnt dit écrit habite dijo vive".split())
NO_NAME_BEFORE = frozenset("the in at near of of to through across visit".split())
NO_NAME_AFTER = frozenset("inc ltd llc gmbh corp company street road avenue university river city county bridge museum".split())

STREET_TYPES = "Street St Road Rd Avenue Ave Lane Ln Drive Boulevard Blvd Way Court Ct Place Square Terrace".split()
_STREET = re.compile(
    rf"(?<![0-9A-Za-z])[0-9]{{1,5}}[a-z]? {_CAP}(?: {_CAP}){{0,2}}\b"
    rf"|(?<![0-9A-Za-z])[0-9]{{1,4}},? (?:rue|avenue|boulevard|place|chemin)(?: de la| de| du| des)? {_CAP}\b"
    rf"|\b[A-ZÄÖÜ][a-zäöüß]{{1,24}}(?:straße|strasse|weg|platz|allee|gasse) [0-9]{{1,4}}[a-z]?\b")
_TYPED = re.compile(rf" (?:{'|'.join(STREET_TYPES)})$|^[0-9]+,? (?:rue|avenue|boulevard|place|chemin)\b|(?:straße|strasse|weg|platz|allee|gasse) [0-9]+[a-z]?$")
STREET_CUES = frozenset("address live lives living resides home ship deliver sent moved wohnt adresse wohnhaft habite domicilio".split())
NO_STREET = frozenset("chapter section page see version in of since until about article room".split())

MONTHS = "January February March April May June July August September October November December".split()
_MONTH = "|".join(MONTHS)
_DATE = re.compile(
    r"(?<![0-9./-])(?:(?P<d>[0-9]{1,2})[./-](?P<m>[0-9]{1,2})[./-](?P<y>[0-9]{4})|(?P<y2>[0-9]{4})-(?P<m2>[0-9]{2})-(?P<d2>[0-9]{2})"
    rf"|(?P<d3>[0-9]{{1,2}}) (?:{_MONTH}) (?P<y3>[0-9]{{4}})|(?:{_MONTH}) (?P<d4>[0-9]{{1,2}}),? (?P<y4>[0-9]{{4}}))(?![0-9])")
BIRTH_CUES = frozenset("born birth birthday birthdate dob geboren geburtsdatum geb né née naissance nacido nacida nacimiento".split())

_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SOCIAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NUMBERED = re.compile(r"(?<![A-Za-z0-9.,-])(?:[A-Z]{1,2})?[0-9]{6,12}(?![A-Za-z0-9.,-]*[0-9])")
ACCOUNT_CUES = frozenset("account acct passport licence license policy insurance ssn social iban konto kontonummer ausweis reisepass compte "
                         "passeport cuenta pasaporte".split())
NO_ACCOUNT = frozenset("order invoice isbn issn part serial version build page year population number total ticket".split())
# Lengths of account numbers per country.
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27,
                "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}

_HANDLE = re.compile(r"(?<![A-Za-z0-9_@./+-])@[A-Za-z_][A-Za-z0-9_]{2,29}(?![A-Za-z0-9_@])")
HANDLE_CUES = frozenset("follow by via cc thanks thank dm hi hey ping tweet tweeted user from rt with and".split())
CODE_WORDS = frozenset("override media import param return returns property staticmethod classmethod test throws author since see "
                       "deprecated charset keyframes supports component injectable autowired".split())

_ASSIGNED = re.compile(r"""(?i)(?:key|token|secret|passwd|password|pwd)["']?\s{0,4}(?:[:=]|=>|is)\s{0,4}["']?(?P<value>[^\s"'`,;<>(){}]{6,})""")
SECRET_HEADS = ("AKIA", "AIza", "ghp_", "github_pat_", "npm_", "sk_live_", "xoxb-", "xoxp-", "eyJ")
PLACEHOLDERS = ("example", "changeme", "placeholder", "your", "xxxx", "****", "....", "dummy", "sample", "redacted", "none", "null", "true", "false")

_WORD = re.compile(r"[^\W\d_]+")


def bucket(word: str) -> int:
    return zlib.crc32(word.lower().encode()) % BUCKETS


def tally(texts: list[str], announced: np.ndarray, capital: np.ndarray) -> None:
    """Add the capitalised words of texts to the counts by bucket, and those that a title announces."""
    every, told = Counter(), Counter()
    for text in texts:
        every.update(_CAPITAL.findall(text))
        for m in _TITLED.finditer(text):
            told.update(w for w in re.split("[ -]", m[1]))
    for counts, into in ((every, capital), (told, announced)):
        for word, n in counts.items():
            into[bucket(word)] += n


def listed_bits(rows: list[tuple[int, int, int]]) -> bytes:
    """A bit per bucket whose words are names, from (bucket, announced, capital)."""
    bits = np.zeros(BUCKETS, bool)
    for place, told, every in rows:
        bits[place] = told >= ANNOUNCED and told >= PART * every
    return np.packbits(bits).tobytes() if bits.any() else b""


def is_listed(word: str, names: bytes) -> bool:
    at = bucket(word)
    return bool(names) and bool(names[at >> 3] >> (7 - (at & 7)) & 1)


def find(text: str) -> list[tuple[int, int, int]]:
    """(number within ADDED, start, end) of every loose span."""
    out = []
    titled = [m.span(1) for m in _TITLED.finditer(text)]
    out += [(0, *s) for s in titled]
    done = 0
    for m in _FULL.finditer(text):
        start, end = m.span()
        head = re.match(r"[^ -]+", m[0])[0]
        if head in TITLES:
            start += len(head) + 1
        while done < len(titled) and titled[done][1] <= start:
            done += 1
        if " " in text[start:end] and not (done < len(titled) and titled[done][0] < end):
            out.append((0, start, end))
    digits = re.search("[0-9]", text)
    if digits:
        out += [(1, *m.span()) for m in _STREET.finditer(text)]
        out += [(2, *m.span()) for m in _DATE.finditer(text)]
        wide = [m.span() for m in _IBAN.finditer(text)] + [m.span() for m in _SOCIAL.finditer(text)]
        out += [(3, *s) for s in sorted(wide)]
        out += [(3, *m.span()) for m in _NUMBERED.finditer(text)]
    if "@" in text:
        out += [(4, *m.span()) for m in _HANDLE.finditer(text)]
    out += [(5, *m.span("value")) for m in _ASSIGNED.finditer(text)]
    return out


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def mod97(value: str) -> bool:
    """The check digits of international account numbers."""
    moved = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _against_only(bad: bool) -> int:
    return 1 if bad else 0


def votes(text: str, kind: int, start: int, end: int, names: bytes) -> tuple[int, int, int, int, int, int]:
    """Form, validity, list, words before, isolation, surroundings."""
    value, head, tail = text[start:end], text[max(0, start - 48):start], text[end:end + 32]
    before = [w.lower() for w in _WORD.findall(head)][-4:]
    after = [w.lower() for w in _WORD.findall(tail)][:1]
    sides = text[start - 1:start] + tail[:1]
    apart = _against_only(any(c.isalnum() or c == "_" for c in sides))
    if kind == 0:
        words = re.split("[ -]", value)
        known = sum(is_listed(w, names) for w in words)
        titled = re.search(rf"\b(?:{'|'.join(TITLES)})\b[.,]?\s{{1,2}}$", head) is not None
        first = not head.strip() or head.rstrip()[-1] in ".!?:" or head[-1] == "\n"
        context = 2 if titled or not NAME_CUES.isdisjoint(before[-2:]) else 1 if not NO_NAME_BEFORE.isdisjoint(before[-1:]) else 0
        around = 2 if not NAME_AFTER.isdisjoint(after) else 1 if not NO_NAME_AFTER.isdisjoint(after) or words[-1].lower() in NO_NAME_AFTER else 0
        return (2 if titled else 1 if first else 0, _against_only(len(words) > 3), 2 if known == len(words) else 1 if not known else 0,
                context, apart, around)
    if kind == 1:
        number = int(re.search("[0-9]+", value)[0])
        typed = _TYPED.search(value) is not None
        place = re.match(rf"(?:, ?|\n| )(?:[0-9]{{4,6}}\b|{_CAP}\b)", tail) is not None
        context = 2 if not STREET_CUES.isdisjoint(before) else 1 if not NO_STREET.isdisjoint(before[-1:]) else 0
        return (2 if typed else 1, _against_only(number == 0 or 1800 <= number <= 2100 and not typed), 2 if place and typed else 0, context, apart,
                1 if not typed and not place else 0)
    if kind == 2:
        m = _DATE.fullmatch(value)
        day, month, year = (int(next(x for x in (*(m[g] for g in own), "1") if x)) for own in (("d", "d2", "d3", "d4"), ("m", "m2"), ("y", "y2", "y3", "y4")))
        told = not BIRTH_CUES.isdisjoint(before)
        near = not BIRTH_CUES.isdisjoint(before[-2:])
        return (0, _against_only(not (1 <= day <= 31 and 1 <= month <= 31 and min(day, month) <= 12)), _against_only(not 1905 <= year <= 2020),
                2 if told else 1, apart, 2 if near else 1)
    if kind == 3:
        packed = value.replace(" ", "")
        if value[:2].isalpha() and _IBAN.fullmatch(value):
            size = IBAN_LENGTHS.get(packed[:2])
            form, valid, known = 2, 2 if mod97(packed) else 1, 0 if size is None else 2 if size == len(packed) else 1
        elif _SOCIAL.fullmatch(value):
            area, group, serial = value.split("-")
            form, valid, known = 2, _against_only(area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000"), 0
        else:
            form, valid, known = 1, 0, 0
        told = not ACCOUNT_CUES.isdisjoint(before[-3:])
        return (form, valid, known, 2 if told else 1 if not NO_ACCOUNT.isdisjoint(before[-2:]) else 0, apart,
                2 if not ACCOUNT_CUES.isdisjoint(before[-2:]) else 1 if form == 1 and not told else 0)
    if kind == 4:
        own = value[1:].lower()
        opens = tail[:1] in ("(", "/", ":", "{") or not head.strip(" \t") or head.rstrip(" \t")[-1:] == "\n"
        personal = any(c.isdigit() or c == "_" for c in own)
        return (1 if opens else 2 if personal else 0, _against_only(own in CODE_WORDS), 2 if text.count(value, max(0, start - 4096), end + 4096) > 1 else 0,
                2 if not HANDLE_CUES.isdisjoint(before[-1:]) else 0, apart, 1 if opens else 2)
    low = value.lower()
    classes = sum(any(t(c) for c in value) for t in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in value)
    bits = entropy(value[:256])
    mixed = any(c.isdigit() for c in value) or any(c.isupper() for c in value[1:]) and any(c.islower() for c in value)
    words = not mixed and all(w.isalpha() for w in re.split("[-_.]", value) if w)
    return (1 if any(p in low for p in PLACEHOLDERS) else 2 if len(value) >= 12 else 0, 2 if bits >= 3.0 and mixed else 1 if bits < 2.3 else 0,
            2 if value.startswith(SECRET_HEADS) else 0, 0 if ":" in head[-4:] or "=" in head[-4:] else 1, apart,
            1 if words else 2 if classes >= 2 else 0)
