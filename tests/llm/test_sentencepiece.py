"""The rebuilt tokenizer against the sentencepiece library, for the given BPE model and small unigram models."""

import pathlib
import resource
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from tidemark.llm.sentencepiece_codec import MARK, Codec, decode_documents, encode_documents, model_bytes, parse

RAW = model_bytes(public_tokenizers.path("piece_bpe_32k.model"))
ODD = ["", " ", "a", "  two  spaces ", "\n", "a\nb\n\nc", "é日本語🙂", "tab\tx", "▁a ▁b", "<s> <0x0A> </s>", "1,234.5", "ends ", "x" * 3000, "word " * 4000]


def varint(n):
    out = b""
    while True:
        out += bytes([n & 0x7F | (0x80 if n > 0x7F else 0)])
        n >>= 7
        if not n:
            return out


def message(number, raw):
    return varint(number << 3 | 2) + varint(len(raw)) + raw


def unigram(prefix=True, trim=False):
    """A small unigram model with byte pieces."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    words = {"▁": -3.0, "▁a": -2.5, "ab": -3.2, "a": -4.0, "b": -4.1, "c": -4.3, "abc": -5.0, "▁ab": -3.9, "bc": -4.4, "▁c": -3.7, "é": -6.0}
    pieces += [(p, s, 1) for p, s in words.items()]
    out = b""
    for piece, score, kind in pieces:
        out += message(1, message(1, piece.encode()) + b"\x15" + struct.pack("<f", score) + b"\x18" + bytes([kind]))
    trainer = b"\x18\x01" + varint(35 << 3) + b"\x01" + varint(40 << 3) + b"\x00" + varint(41 << 3) + b"\x01" + varint(42 << 3) + b"\x02"
    normalizer = message(1, b"identity") + b"\x18" + bytes([prefix]) + b"\x20" + bytes([trim])
    return out + message(2, trainer) + message(3, normalizer)


def both(raw, texts):
    judge, codec = sentencepiece.SentencePieceProcessor(model_proto=raw), Codec(raw)
    got = [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)]
    return got, [judge.encode(t) for t in texts], codec, judge


def test_parsed_parts():
    model = parse(RAW)
    assert len(model.pieces) == 32_000 and model.kind == 2 and model.bytes_known and model.dummy_prefix and not model.trims_spaces
    assert parse(unigram(False, True)).trims_spaces and not parse(unigram(False)).dummy_prefix


def test_given_model_agrees_and_decodes():
    got, want, codec, judge = both(RAW, ODD)
    assert got == want
    for ids in want:
        raw = np.array(ids, "<u4").tobytes()
        assert codec.decode(raw) == judge.decode(ids) == codec.tokenizer.decode(ids, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab .,\n\té🙂日<0x>" + MARK), max_size=25), max_size=6))
def test_any_text_agrees(texts):
    judge, codec = sentencepiece.SentencePieceProcessor(model_proto=RAW), Codec.of(RAW)
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)] == [judge.encode(t) for t in texts]


@pytest.mark.parametrize("prefix", [True, False])
@pytest.mark.parametrize("trim", [True, False])
def test_unigram_scores(prefix, trim):
    texts = ["abc", "a b c", "aab cab", "é x", "ab  abc", "", "b", " abc "]
    got, want, codec, _ = both(unigram(prefix, trim), texts)
    assert codec.model.kind == 1 and got == want


def test_documents_round_trip(spark):
    rows = [(i if i else None, t, 1) for i, t in enumerate([*ODD, None, "a", "a"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    coded = encode_documents(docs, RAW)
    got = coded.collect()
    texts = {i: t or "" for i, t, _ in rows}
    assert len(got) == len(rows) and all(r.parity for r in got)
    # A marker that stands in the text itself reads as a space: the model cannot tell them apart.
    assert all(r.round_trip == (MARK not in texts[r.doc_id]) for r in got)
    assert {r.doc_id: r.text for r in decode_documents(coded, RAW).collect()} == {i: t.replace(MARK, " ") for i, t in texts.items()}
    assert encode_documents(docs.limit(0), RAW).count() == 0


def test_many_different_words_are_encoded_once(monkeypatch):
    codec, sent = Codec(RAW), []
    plain = codec.encoder.whole
    monkeypatch.setattr(codec.encoder, "whole", lambda texts: sent.append(sum(map(len, texts))) or plain(texts))
    batches = [" ".join(f"w{i}" for i in range(at, at + 50_000)) for at in range(0, 250_000, 50_000)]
    first = [codec.encode([t]) for t in batches]
    assert sum(sent) >= sum(map(len, batches))
    sent.clear()
    assert [codec.encode([t]) for t in batches] == first and not sum(sent)


def test_parity_tells_a_wrong_id():
    texts, codec = ["a b", None, "", "é c", "a b"], Codec(RAW)
    ids, ends = codec.encode_array(pa.array(texts))
    assert codec.parity(texts, ids, ends) == [True] * 5
    wrong = ids.copy()
    wrong[0] += 1
    assert codec.parity(texts, wrong, ends) == [False, True, True, True, True]
    assert codec.parity(["a b c"], ids[:ends[0]], ends[:1]) == [False]


def test_a_task_gives_its_memory_back():
    def mb():
        return int(pathlib.Path("/proc/self/statm").read_text().split()[1]) * resource.getpagesize() / 1e6

    codec = Codec(model_bytes(public_tokenizers.path("piece_bpe_32k.model")))
    # Once a large array has gone, the allocator keeps what smaller ones leave.
    large = np.ones(30 << 17)
    del large
    some = [np.ones(1 << 17) for _ in range(50)]
    full = mb()
    some.clear()
    codec.rest()
    assert mb() < full - 40
