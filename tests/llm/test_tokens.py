"""Tokenising operators against the public libraries, and exact round trips."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as tok
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cutlake.llm import byte_bpe, rans, token_counts, token_files

from .conftest import DATA

RANKS, PIECES, WORDS = (tok.path(name) for name in ("byte_bpe_50k.tiktoken", "piece_bpe_32k.model", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def codec():
    with open(RANKS, "rb") as file:
        return byte_bpe.TreeCodec(file.read(), tok.PATTERN)


@pytest.fixture(scope="module")
def tiktoken_like():
    import tiktoken

    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=tok.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def words():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def table():
    with open(PIECES, "rb") as file:
        return token_counts.MergeTable(file.read())


TEXT = st.one_of(st.text(max_size=60), st.text("abetionrs  \n'.,!x1é日　▁\x1c\x85", max_size=120))


@settings(max_examples=300, deadline=None)
@given(text=TEXT)
def test_tree_encoding_is_the_library_s(codec, tiktoken_like, text):
    ids = np.frombuffer(codec.encode(text), np.uint32)
    assert ids.tolist() == tiktoken_like.encode_ordinary(text)
    assert codec.decode(ids.astype(np.int64)) == text.encode()


def test_windows_that_grow(codec, tiktoken_like):
    for text in ("a" * 4001, "ab" * 999, "é" * 700, "=" * 333 + "!", "aaab" * 301):
        assert np.frombuffer(codec.encode(text), np.uint32).tolist() == tiktoken_like.encode_ordinary(text)


def test_unknown_ids_are_an_error(codec):
    with pytest.raises((ValueError, IndexError)):
        codec.decode(np.array([10**6]))


@settings(max_examples=300, deadline=None)
@given(text=TEXT)
def test_merged_arrays_count_as_the_library(table, pieces, text):
    found = token_counts._PRE_TOKEN.findall(" " + text.replace("▁", " ")) if text else []
    assert int(table.counts([x.replace(" ", "▁") for x in found]).sum()) == len(pieces.encode(text))


def test_merged_arrays_on_long_runs(table, pieces):
    rng = random.Random(5)
    every = [pieces.id_to_piece(i) for i in range(3, 32_000)]
    for _ in range(200):
        text = "".join(rng.choice(every) for _ in range(rng.randint(1, 60))).replace("▁", " ")
        found = token_counts._PRE_TOKEN.findall(" " + text)
        assert int(table.counts([x.replace(" ", "▁") for x in found]).sum()) == len(pieces.encode(text))


@settings(max_examples=60, deadline=None)
@given(seed=st.integers(0, 10**6), n=st.integers(0, 70_000))
def test_range_coder_round_trip(seed, n):
    rng = np.random.default_rng(seed)
    ids = np.minimum(rng.zipf(1.0 + rng.random() + 0.05, n), 49_407).astype(np.uint32)
    coder = rans.Table(rans.scaled(np.bincount(ids, minlength=49_408)))
    block = rans.encode(ids, coder)
    assert (rans.decode(block, coder) == ids).all()
    lanes, segments = (int(np.frombuffer(block, "<u4", 5)[k]) for k in (2, 3))
    parts = [rans.decode(block, coder, k) for k in range(segments)]
    assert all((part == ids[k * rans.STRIDE * lanes : (k + 1) * rans.STRIDE * lanes]).all() for k, part in enumerate(parts))


def test_range_coder_notices_damage():
    ids = np.arange(5_000, dtype=np.uint32) % 300
    coder = rans.Table(rans.scaled(np.bincount(ids)))
    block = bytearray(rans.encode(ids, coder))
    block[-100] ^= 4
    with pytest.raises(ValueError):
        rans.decode(bytes(block), coder)
    with pytest.raises(ValueError):
        rans.decode(b"\0" * 40, coder)


@settings(max_examples=200, deadline=None)
@given(text=st.one_of(TEXT, st.text("aB'.<|>()-! \n9é́", max_size=40)))
def test_word_cuts_are_the_library_s(words, text):
    encoder = test_word_cuts_are_the_library_s.__dict__.setdefault("encoder", None)
    if encoder is None:
        with open(WORDS, "rb") as file:
            encoder = test_word_cuts_are_the_library_s.encoder = token_files.WordEncoder(file.read())
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == words.encode(text, add_special_tokens=False).ids


def test_letters_are_asked_for_together(words):
    """One call of the library for many words, one look-up for words that differ in case and punctuation only."""
    with open(WORDS, "rb") as file:
        encoder = token_files.WordEncoder(file.read())
    asked = []

    class Counting:
        normalizer = words.normalizer

        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return words.encode_batch_fast(texts, **options)

    encoder.library = Counting()
    letters = "abcdefghijklmnopqrstuvwxyzéñ"
    made = [f"{a}{b}{c}" for a in letters for b in letters for c in "xyz"]
    texts = [" ".join(made), "  ".join(f"{w.title()}, " for w in made[:2000:7]), "", " \n ", "x\u0660y z\u0301 fi\ufb01 \u0958\u0958 it's ..."]
    for _ in range(2):
        for ids, text in zip(encoder.encode(texts), texts, strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == words.encode(text, add_special_tokens=False).ids
    assert len(asked) < 200


def test_every_character_before_punctuation(words):
    """Letters that the normaliser takes apart end in a mark, which joins the punctuation behind it."""
    with open(WORDS, "rb") as file:
        encoder = token_files.WordEncoder(file.read())
    points = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    texts = [f"x{c},," for c in points]
    texts += [f"{c}{sign}" for c in points if words.normalizer.normalize_str(c) != c for sign in token_files._TAIL]
    for ids, encoded in zip(encoder.encode(texts), words.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encoded.ids


def _expected(docs, words, pieces, tiktoken_like):
    start, out = 0, []
    for doc_id, text in docs:
        ids = [*words.encode(text, add_special_tokens=False).ids, 1]
        ranks = tiktoken_like.encode_ordinary(text)
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        shas = [hashlib.sha256(x).hexdigest() for x in (" ".join(map(str, ranks)).encode(), text.encode())]
        out.append(((doc_id, start, len(ids), crc), (doc_id, len(ranks), *shas), (doc_id, len(text.encode()), len(pieces.encode(text)))))
        start += len(ids)
    return out


def test_queries_on_a_table(spark, words, pieces, tiktoken_like):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    expected = _expected([(r[0], r[1] or "") for r in rows], words, pieces, tiktoken_like)
    got6 = sorted(tuple(r) for r in token_files.op6_token_files(spark, DATA).collect())
    got3 = sorted(tuple(r) for r in byte_bpe.op3_byte_bpe(spark, DATA).collect())
    got10 = sorted(tuple(r)[:3] for r in token_counts.op10_token_counts(spark, DATA).collect())
    assert [got6, got3, got10] == [[x[k] for x in expected] for k in range(3)]


def test_odd_rows(spark, odd, words, pieces, tiktoken_like, tmp_path):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    docs = [(r[0], r[1] or "") for r in sorted(odd.select("doc_id", "text").collect(), key=key)]
    expected = _expected(docs, words, pieces, tiktoken_like)
    plain = lambda rows: sorted(map(repr, rows))
    folder = f"file://{tmp_path}/files"
    token_files.write(odd, WORDS, folder, block_ids=500)
    back = token_files.read_back(spark, folder).collect()
    assert plain((r["doc_id"], r["start"], len(r["ids"]) // 4, zlib.crc32(r["ids"])) for r in back) == plain(x[0] for x in expected)
    ids = byte_bpe.encode(odd, RANKS, tok.PATTERN)
    both = byte_bpe.decode(ids, RANKS, tok.PATTERN).collect()
    assert plain((r["doc_id"], bytes(r["decoded"])) for r in both) == plain((i, t.encode()) for i, t in docs)
    assert plain((r["doc_id"], len(r["ids"])) for r in both) == plain(x[1][:2] for x in expected)
    assert plain(map(tuple, token_counts.token_counts(odd, PIECES).collect())) == plain(x[2] for x in expected)


def test_empty_tables(spark, empty, tmp_path):
    folder = f"file://{tmp_path}/none"
    token_files.write(empty, WORDS, folder)
    assert token_files.read_back(spark, folder).count() == 0
    assert byte_bpe.decode(byte_bpe.encode(empty, RANKS, tok.PATTERN), RANKS, tok.PATTERN).count() == 0
    assert token_counts.token_counts(empty, PIECES).count() == 0
