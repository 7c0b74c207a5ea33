"""Encoding, decoding and packing against the public libraries."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from public_tokenizers import path
from tokenizers import Tokenizer

from helpers import DOCS, odd_rows, prose
from vulnlake.llm import packing, pieces

MODEL, WORDS = path("piece_bpe_32k.model"), path("word_bpe_49k.json")


def texts(letters: str, n: int = 400) -> list[str]:
    rng = random.Random(3)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(n)]


ODD = ["", " ", "  a", " a  b ", "▁", "▁▁ x", "a\n\nb\tc", "\0x", "<s> <0x0A> <unk>", "x" * 300, "日" * 100, " " * 100, "ab" * 3000, "a\x01b"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_encoding_equals_the_library(library):
    model = pieces.PieceModel.load(MODEL)
    rows = ODD + texts("abcthe n \n\t日é🎉.,<>0x1 ▁") + texts("thenraio ,.\n") + [prose(random.Random(1))]
    got = model.digests(pa.array([*rows, None]))
    for i, t in enumerate([*rows, ""]):
        ids = library.encode(t, add_bos=True, add_eos=True)
        spans = model.encode(t)
        assert [s[0] for s in spans] == ids
        assert model.decode(ids) == library.decode(ids)
        assert got["ids_sha256"][i] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got["decoded_sha256"][i] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert got["spans_crc32"][i] == zlib.crc32(np.array([s[2] for s in spans[1:-1]], "<u4").tobytes())
        raw = t.encode()
        assert b"".join(raw[a:b] for _, a, b in spans) == raw


@pytest.mark.parametrize("size", [257, 40_000, 1_000_000])
def test_unbroken_texts_equal_the_libraries(library, size):
    rng = random.Random(size)
    model, own, words = pieces.PieceModel.load(MODEL), packing.WordTokenizer(WORDS), Tokenizer.from_file(WORDS)
    rows = ["".join(rng.choices("etaoinshrdlu", k=size)), "".join(rng.choices("的是不了人我在有他这日本語のは", k=size))]
    got, coded = model.digests(pa.array(rows)), own.encode_batch(pa.array(rows))
    for i, t in enumerate(rows):
        ids = library.encode(t, add_bos=True, add_eos=True)
        assert got["ids_sha256"][i] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got["decoded_sha256"][i] == hashlib.sha256(t.encode()).hexdigest()
        assert coded.data[coded.starts[i] : coded.starts[i] + coded.lengths[i]].tolist() == words.encode(t, add_special_tokens=False).ids


def test_any_ids_decode_like_the_library(library):
    model, rng = pieces.PieceModel.load(MODEL), random.Random(4)
    for _ in range(300):
        ids = [rng.choice([rng.randint(3, 258), rng.randint(0, 31999)]) for _ in range(12)]
        assert model.decode(ids) == library.decode(ids)


def test_compiled_map_equals_the_library():
    from sentencepiece import sentencepiece_model_pb2 as pb

    plain = {"add_dummy_prefix": False, "remove_extra_whitespaces": False, "escape_whitespaces": False}
    norm = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", **plain)
    spec = pb.NormalizerSpec()
    spec.ParseFromString(norm.serialized_normalizer_spec())
    model = pieces.PieceModel.load(MODEL)
    model.characters, model.dummy_prefix = pieces.CharacterMap(spec.precompiled_charsmap), False
    for t in ["①ﬁＡ㌔½ é", *texts("aé①ｱﾞ㌔ﬁ½ \t́e​Ａ가각")]:
        got, align = model.normalise(t)
        assert got.replace("▁", " ") == norm.normalize(t)
        assert len(align) == len(got.encode()) + 1 and align[-1] == len(t.encode()) and (np.diff(align) >= 0).all()
        spans = model.encode(t)
        assert all(a <= b <= c for (_, a, b), c in zip(spans, [s[2] for s in spans[1:]], strict=False))
        assert model.digests(pa.array([t]))["n_tokens"][0] == len(spans)


def test_encoding_odd_rows(spark, library):
    docs = spark.createDataFrame(odd_rows(), DOCS)
    got = pieces.encoded_digests(docs, MODEL).collect()
    want = sorted(len(library.encode(r[1] or "")) + 2 for r in odd_rows())
    assert sorted(r.n_tokens for r in got) == want
    spans = docs.where("doc_id = 9004").select(pieces.encode_column(MODEL, "text").alias("s")).first().s
    assert spans[-1].end == len("one two")
    assert pieces.encoded_digests(docs.limit(0), MODEL).count() == 0


def test_word_tokens_equal_the_library():
    own, library = packing.WordTokenizer(WORDS), Tokenizer.from_file(WORDS)
    rows = ["", "<|endoftext|> x", "a<|startoftext|>b", "it's I'LL we've", "x" * 200, *texts("abcthe n's'LLİΣ½²ªß \n\t日é🎉.,<>0x1 ́ÀÉ|\x1c\x85\xa0'"), *texts("the n's½ß \n.,0ÀÉ|\xa0")]
    got = own.encode_batch(pa.array([*rows, None]))
    for i, t in enumerate([*rows, ""]):
        assert got.data[got.starts[i] : got.starts[i] + got.lengths[i]].tolist() == library.encode(t, add_special_tokens=False).ids


def plain_first_fit(lengths, capacity):
    free, out = [], np.zeros(len(lengths), int)
    for i in np.argsort(-np.array(lengths), kind="stable"):
        b = next((b for b, f in enumerate(free) if f >= lengths[i]), None)
        if b is None:
            free.append(capacity)
            b = len(free) - 1
        free[b] -= lengths[i]
        out[i] = b
    return out


@pytest.mark.parametrize("n", [0, 1, 2, 37, 500])
def test_tree_packs_like_plain_first_fit(n):
    lengths = np.random.default_rng(n).integers(1, 101, n)
    bins, offsets = packing.first_fit_decreasing(lengths, 100)
    assert bins.tolist() == plain_first_fit(lengths, 100).tolist()
    assert all(offsets[i] + lengths[i] <= 100 for i in range(n))


def test_packing(spark):
    rng, library = random.Random(8), Tokenizer.from_file(WORDS)
    rows = [(i, prose(rng, "en", rng.randint(1, 900)), None, None, None, None, None) for i in range(120)] + odd_rows()
    docs = spark.createDataFrame(rows, DOCS)
    got = packing.pack(packing.token_pieces(docs, WORDS, keep_ids=True), group=40).collect()
    by_doc = {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length <= 4096 and zlib.crc32(r.ids) == r.ids_crc32
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, t in [(r[0], r[1]) for r in rows if r[0] is not None and r[0] != 9005]:
        parts = sorted(by_doc[i], key=lambda r: r.start)
        want = library.encode(t or "", add_special_tokens=False).ids + [2]
        assert np.concatenate([np.frombuffer(p.ids, "<u4") for p in parts]).tolist() == want
        assert [p.start for p in parts] == list(range(0, len(want), 4096)) and {p.doc_tokens for p in parts} == {len(want)}
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(packing.token_pieces(docs.limit(0), WORDS)).count() == 0


def test_rows_without_an_id_spread_over_groups(spark):
    rows = [(None if i % 2 else 7, 0, 10, i, 10) for i in range(4000)]
    got = packing.pack(spark.createDataFrame(rows, packing.PIECE), group=100).collect()
    assert sorted(r.ids_crc32 for r in got) == list(range(4000))
    sizes = {}
    for r in got:
        sizes[r.sequence_id >> 32] = sizes.get(r.sequence_id >> 32, 0) + 1
    assert len(sizes) == 40 and max(sizes.values()) <= 200
