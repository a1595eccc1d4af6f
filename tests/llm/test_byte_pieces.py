"""Byte-level pieces of windows against the library on whole texts."""

import hashlib
import random

import pytest

from scanloom.llm import byte_pieces as b

public = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
RANKS = public.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=b.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return b.Coder(RANKS, public.PATTERN, b.strangers(public.PATTERN))


def expected(rows, library):
    out = []
    for doc, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        out.append((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                    hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in df.collect()), key=str)


ALPHABET = ["a", "B", "é", "漢", "1", "½", " ", " ", "  ", "\n", "\t", "　", "'", "'r", "'re", "'s", "'l", "'ll", "e", "l", ".", "_", "—",
            "՘", "࢏", "\U00011de0", "\U0001f600", "́", "‍", "\x00", "<|endoftext|>", "▁", "the", "of"]


def test_pieces_are_those_of_the_library(coder, library):
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choices(ALPHABET, k=rng.randrange(0, 14)))
        pieces = coder.pieces(text)
        assert "".join(pieces) == text
        found = memoryview(coder.encode(pieces)).cast("i").tolist()
        assert found == library.encode_ordinary(text), ascii(text)
        assert coder.decode(b.np.array(found, b.np.int32)) == text.encode()


def test_classes_of_all_characters(coder, library):
    """A character between letters, digits and marks: every class shows in the pieces."""
    step = 7
    text = "".join(f"a{chr(c)}a 1{chr(c)}1 .{chr(c)}." for c in range(0x80, 0x110000, step) if not 0xD800 <= c < 0xE000)
    assert memoryview(coder.encode(coder.pieces(text))).cast("i").tolist() == library.encode_ordinary(text)


def test_windows_are_stitched(spark, library):
    rng, rows = random.Random(4), []
    for i in range(400):
        rows.append((i % 300, "".join(rng.choices(ALPHABET, k=rng.randrange(0, 90)))))
    rows += [(1000, "x" * 500), (1001, " " * 300 + "a"), (1002, "'re" * 90), (1003, "a" * 15 + " " * 40 + "b"), (1004, "漢" * 100 + "1" * 100), (1005, None),
             (None, "it's we'll " * 30), (None, "it's we'll " * 30), (1006, "a" * 16), (1007, "a" * 17), (1008, "word " * 12 + "y" * 60 + " word" * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for window, overlap in ((16, 5), (16, 16), (9, 3), (40, 12)):
        found = b.digests(docs, RANKS, public.PATTERN, window=window, overlap=overlap)
        assert got(found) == expected(rows, library)
    # Some texts share no boundary in an overlap, most do: both ways are met.
    most = b.digests(docs, RANKS, public.PATTERN, window=16, overlap=5).selectExpr("max(n_parts)", "min(n_parts)").first()
    assert most[0] > 5 and most[1] == 1


def test_parts_decode_to_the_text(spark):
    text = "Größe 漢字 😀 we're " * 40
    docs = spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")
    parts = b.decode(b.encode(docs, RANKS, public.PATTERN, window=33, overlap=20), RANKS).collect()
    assert len(parts) > 10
    assert b"".join(p.bytes for p in sorted((p for p in parts if p.doc_id == 1), key=lambda p: p.part)) == text.encode()
    assert [p.bytes for p in parts if p.doc_id == 2] == [b""]


def test_odd_rows(spark, docs, clashing, none, library):
    from tests.llm.conftest import ROWS

    for df in (docs, clashing):
        assert got(b.digests(df, RANKS, public.PATTERN)) == expected(ROWS, library)
    assert b.digests(none, RANKS, public.PATTERN).count() == 0
    assert b.encode(none, RANKS, public.PATTERN).count() == 0


def test_very_long_texts(spark, library):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghié", k=rng.randrange(1, 9))) for _ in range(3000)]
    rows = [(1, " ".join(rng.choices(words, k=300_000))), (2, "y" * 90_000 + " end"), (3, "".join(rng.choices("ab \n", k=200_000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(b.digests(df, RANKS, public.PATTERN)) == expected(rows, library)


def test_too_short_an_overlap(docs):
    with pytest.raises(ValueError):
        b.encode(docs, RANKS, public.PATTERN, window=10, overlap=2)
