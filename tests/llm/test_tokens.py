"""Directly addressable codes, token files and the piece encoder against plain library calls."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tidemark.llm.dac import Codes, pack
from tidemark.llm.files import shared_folder
from tidemark.llm.token_files import TokenFile, byte_level_encoder, token_documents, tokenizer_json, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["plain words, and more.", "", None, "two  spaces", " leads", "ends ", "tab\tand\nline\n\nbreaks", "don't... stop!!., x_.y", "é日本 🙂, naïve.",
         "<|endoftext|> is text", "a b  c", "1,234.5 and 3.", "word " * 20_000, "é. x", " . , .", "\x1f.a"]


@pytest.fixture(scope="module")
def library():
    out = Tokenizer.from_file(PATH)
    out.encode_special_tokens = True
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2 ** 32 - 1)), max_size=1500), st.data())
def test_codes_give_back_values_and_slices(values, data):
    codes = Codes(pack(np.array(values, np.uint32)))
    assert len(codes) == len(values)
    a = data.draw(st.integers(0, len(values)))
    b = data.draw(st.integers(a, len(values)))
    assert codes.slice(a, b).tolist() == values[a:b]
    assert [codes[i] for i in range(a, min(b, a + 20))] == values[a:min(b, a + 20)]


def test_pieces_agree_with_the_library(library):
    encoder = byte_level_encoder(tokenizer_json(PATH))
    for _ in range(2):
        for text, got in zip(TEXTS, encoder.encode(TEXTS)):
            assert np.frombuffer(got, "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids, text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab1.,!_'é日́ \n\t A-"), max_size=25), max_size=8))
def test_pieces_agree_on_any_text(library, texts):
    encoder = byte_level_encoder(tokenizer_json(PATH))
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_full_store_starts_anew(library):
    encoder = byte_level_encoder(tokenizer_json(PATH))
    kept, encoder.kept = encoder.kept, 3
    try:
        for text in ("one two three four five", "six seven eight one two"):
            assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == library.encode(text).ids
    finally:
        encoder.kept = kept


def test_documents_come_back_in_order(spark, library):
    rows = [(i * 7 % 31 if i else None, t, "clash") for i, t in enumerate(TEXTS)] + [(5, "same", "x"), (5, "same", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = token_documents(spark, docs, tokenizer_json(PATH)).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start, want = 0, []
    for doc, text, _ in order:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted((tuple(r)[:4] for r in got), key=lambda r: r[1]) == want


def test_token_files_are_addressable(spark, library):
    docs = spark.createDataFrame([(i, f"document number {i} has words") for i in range(50)], "doc_id long, text string").coalesce(1)
    manifest = write_tokens(docs, shared_folder(spark, "tokens-test"), tokenizer_json(PATH), end_id=7).collect()
    assert sum(r.n_docs for r in manifest) == 50
    for r in manifest:
        file = TokenFile(r.path)
        flat = [int(t) for _, ids in file.documents() for t in ids]
        assert len(flat) == r.n_tokens == file.n_tokens
        assert [file.token(i) for i in range(0, len(flat), 5)] == flat[::5]
        with pytest.raises(IndexError):
            file.token(len(flat))
        file.close()


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_documents(spark, docs, tokenizer_json(PATH)).count() == 0


def test_a_store_stays_within_its_bytes(library):
    encoder = byte_level_encoder(tokenizer_json(PATH))
    kept, encoder.kept = encoder.kept, 200_000
    try:
        for at in range(0, 60_000, 3000):
            text = " ".join(f"w{i}x" for i in range(at, at + 3000))
            assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == library.encode(text).ids
            assert encoder.held < 200_000 + 3000 * 300
    finally:
        encoder.kept = kept
        encoder.clear()
    assert not encoder.places and not encoder.held


def test_white_space_costs_little_more():
    import time

    encoder = byte_level_encoder(tokenizer_json(PATH))
    rng = np.random.default_rng(5)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(3000)]
    plain = [" ".join(words[i] for i in rng.integers(0, 3000, 400)) for _ in range(300)]
    loose = [t.replace(" ", "\n\n", 3).replace(" ", "  ", 3) for t in plain]

    def cost(texts):
        encoder.clear()
        encoder.encode(texts)
        begun = time.process_time()
        for _ in range(3):
            encoder.encode(texts)
        return time.process_time() - begun

    assert cost(loose) < 1.5 * cost(plain) + 0.1


def test_which_pieces_go_in_a_row():
    import re

    from tidemark.llm.pieces import _LONG_PATTERN, SPACES, PieceEncoder

    pieces = [b" a", b"a", b" ", b"  a", b"a b", b"\n", b"a\n", b"\ta", " \u00e9".encode(), "\u2003x".encode(), "x\u3000".encode(), "\u20ac".encode(), b".", b" \n"]
    for white in (SPACES, b"\t", b""):
        encoder = PieceEncoder(None, np.zeros(0, np.int64), white=white)
        simple = re.compile(b" ?[^" + re.escape(white + b"\n") + b"]+").fullmatch
        got = encoder._plain(np.frombuffer(b"".join(pieces), np.uint8), np.cumsum([0, *map(len, pieces)]))
        assert got.tolist() == [simple(p) is not None and _LONG_PATTERN.search(p) is None for p in pieces]
