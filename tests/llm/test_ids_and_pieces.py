"""Huffman-coded ids and piece spans against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from scanloom.llm import huffman_ids as h
from scanloom.llm import piece_spans as p
from scanloom.llm.common import chunks, spelled

public = pytest.importorskip("public_tokenizers")
BPE, PIECES = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")


@pytest.mark.parametrize("text", ["a b", " a", "a ", "a  b\n\nc", "x,y. z ,q\n.r", "\n", "a\tb 　c d", "...a,b", "\r x"])
@pytest.mark.parametrize("marks", [False, True])
def test_chunks_give_the_text(text, marks):
    assert "".join(spelled(c, marks) for c in chunks(text, marks)) == text


@pytest.mark.parametrize("text", ["foo_.bar", "_.map", "__.a", "a_,b c_. d", "x _.y, z.", "é_.é, 7_,8", "a.b_.c\nd_,e", "plain, words. here"])
def test_chunks_give_the_ids_of_the_text(text):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(BPE)
    parts = [model.encode(spelled(c, True), add_special_tokens=False).ids for c in chunks(text, True)]
    assert sum(parts, []) == model.encode(text, add_special_tokens=False).ids


def test_batches_of_texts_give_the_ids_of_each_text(monkeypatch):
    """Borders of texts, marks, line ends, wide spaces, strings of special tokens, and blocks of few chunks."""
    from tokenizers import Tokenizer

    r, model, encoder = random.Random(11), Tokenizer.from_file(BPE), h.Encoder(BPE, False)
    signs = ["a", "Z", "é", "я", "漢", "1", "²", "_", ".", ",", "'s", "'", " ", " ", "\n", "\t", "\r", "\u2581", "\u00a0", "\x85", "-", "<|endoftext|>", "word"]
    texts = ["".join(r.choices(signs, k=r.randrange(12))) for _ in range(6000)] + ["", " ", " a", "a ", "word " * 3000]
    monkeypatch.setattr(h, "CHUNKS", 50)
    for k in range(0, len(texts), 400):
        for text, got in zip(texts[k:k + 400], encoder.texts(texts[k:k + 400]), strict=True):
            assert np.frombuffer(got, encoder.kind).tolist() == model.encode(text, add_special_tokens=False).ids, text


def test_codes_are_optimal_and_limited():
    counts = {i: 2**i for i in range(20)}
    for limit in (5, 8, 19):
        lengths = h.code_lengths(counts, limit)
        assert max(lengths.values()) <= limit and sum(2.0**-n for n in lengths.values()) == 1
    assert h.code_lengths({7: 3}) == {7: 1} and h.code_lengths({}) == {}
    with pytest.raises(ValueError):
        h.code_lengths(dict.fromkeys(range(9), 1), 3)


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 40_000])
def test_blocks_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.4, n) % 900).astype("<u2")
    lengths = h.code_lengths(dict(zip(*(x.tolist() for x in np.unique(ids, return_counts=True)), strict=True)))
    codes = h.Codes(list(lengths), list(lengths.values()))
    offsets, bits = h.pack(ids, *codes.writer())
    assert (h.unpack(bits, offsets, n, codes) == ids).all()


def expected(rows, model):
    ids = {}
    for doc, text, *_ in rows:
        ids.setdefault(doc, []).append(model.encode(text or "", add_special_tokens=False).ids + [2])
    return ids


def test_ids_of_all_documents(spark, docs, clashing):
    from tokenizers import Tokenizer

    from tests.llm.conftest import ROWS

    model = Tokenizer.from_file(BPE)
    model.encode_special_tokens = True
    want = expected(ROWS, model)
    for table in (docs, clashing):
        path = h.encode_documents(table, BPE, 50_257, 2)
        got = h.digests(h.read_ids(spark, path)).join(h.segment_starts(spark, path), ["shard", "seq"]).collect()
        rows = sorted(((r.segment_start + r.start_in_segment, r.n, r.doc_id, r.ids_crc32) for r in got))
        assert len(rows) == len(ROWS)
        start = 0
        for at, n, doc, crc in rows:
            assert at == start
            assert (n, crc) in [(len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for i in want[doc]]
            start += n
        assert [r[2] for r in rows][1:] == sorted(r[0] for r in ROWS if r[0] is not None)
    flat = np.concatenate([np.frombuffer(bytes(r.ids), "<u4") for r in sorted(
        h.read_ids(spark, path).join(h.segment_starts(spark, path), ["shard", "seq"]).collect(),
        key=lambda r: r.segment_start + r.start_in_segment)])
    for a, n in ((0, 5), (700, 1500), (len(flat) - 3, 3), (100, 0)):
        assert (h.read_range(spark, path, a, n) == flat[a:a + n]).all()


def test_op1_keeps_special_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "a, b.<|endoftext|>\nc <|endoftext|>, d_.e", "<|endoftext|>", "a \n<|endoftext|>  b", "plain"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    model, start = Tokenizer.from_file(BPE), 0
    for r in sorted(h.op1(spark, str(tmp_path)).collect(), key=lambda r: r.doc_id):
        ids = model.encode(texts[r.doc_id], add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_no_documents(spark, none):
    path = h.encode_documents(none, BPE, 50_257, 2)
    assert h.read_ids(spark, path).count() == 0 and h.segment_starts(spark, path).count() == 0
    assert p.encode_digests(none, PIECES).count() == 0


def test_pieces_are_those_of_the_library(docs, clashing):
    import sentencepiece

    from tests.llm.conftest import ROWS

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = sorted((str(d), len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(),
                   hashlib.sha256(lib.decode(i).encode()).hexdigest()) for d, t, *_ in ROWS for i in [lib.encode(t or "")])
    for table in (docs, clashing):
        got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in p.encode_digests(table, PIECES).collect())
        assert got == want


def test_texts_that_hold_the_space_mark():
    encoder, rng = p.Encoder(PIECES), random.Random(5)
    texts = ["a\u2581 \u2581b", "\u2581", "\u2581a", "a\u2581", " \u2581 ", "a \u2581\nb", "a\u2581\nb c", "a \u2581\u2581 b",
             "the \u2581 " * 9, "word\u2581 " * 30_000]
    texts += ["".join(rng.choices(["\u2581", " ", "\n", "a", "the", "Bad", "1", ".", ",", "é", "漢", "\t"], k=rng.randrange(1, 14)))
              for _ in range(20_000)]
    want = encoder.lib.encode(texts, num_threads=4)
    for text, ids, own in zip(texts, want, encoder.ids(texts), strict=True):
        assert own.tolist() == ids, text
    for text in texts[:300]:
        (ids, starts, ends), size = encoder([text])[0], len(text.encode())
        assert starts[0] == 0 and ends[-1] == size and (starts[1:] == ends[:-1]).all()


def test_spans_cover_the_source(docs):
    for r, text in ((r, {**{x.doc_id: x.text for x in docs.collect()}}[r.doc_id] or "") for r in p.encode(docs, PIECES).collect()):
        assert [*r.starts[1:]] == [*r.ends[:-1]]
        if text:
            assert r.starts[0] == 0 and r.ends[-1] == len(text.encode())


def test_normaliser_with_a_character_map():
    """The library's own compiled maps, with every switch of the specification."""
    import sentencepiece as sp
    from sentencepiece import sentencepiece_model_pb2 as pb

    maps = {}
    for rule in ("nfkc", "nmt_nfkc_cf"):
        proto = pb.ModelProto()
        proto.ParseFromString(sp.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
        maps[rule] = proto.normalizer_spec.precompiled_charsmap
    rng = random.Random(4)
    letters = "aB ①ﬁ  é　Ⅷｶﾞ½ ﷺẞ😀\t\n"
    texts = ["", " ", "  a  b ", "ﬁne ①② Ⅷ", *("".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(60))]
    for blob in (b"", *maps.values()):
        for dummy in (True, False):
            for merge in (True, False):
                proto = pb.ModelProto()
                with open(PIECES, "rb") as f:
                    proto.ParseFromString(f.read())
                proto.normalizer_spec.precompiled_charsmap = blob
                proto.normalizer_spec.add_dummy_prefix, proto.normalizer_spec.remove_extra_whitespaces = dummy, merge
                lib = sp.SentencePieceProcessor(model_proto=proto.SerializeToString())
                own = p.Normalizer(proto.normalizer_spec)
                for text in texts:
                    data, align = own(text)
                    assert data.decode() == lib.normalize(text), (text, dummy, merge)
                    assert len(align) == len(data) + 1 and (np.diff(align) >= 0).all()
