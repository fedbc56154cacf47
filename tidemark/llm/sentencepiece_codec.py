"""SentencePiece models on the tokenizers library: parse the model file, rebuild its parts, encode, decode, check parity.

The model's protobuf is read field by field. Its normaliser becomes a normalizer of the library, the white-space marker a
replacement, unigram scores a Unigram model or BPE scores a list of merges, byte pieces the byte fallback.
"""

from __future__ import annotations

import ctypes
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.pieces import PieceEncoder, flat
from tidemark.llm.text import runs

MARK = "▁"
MAX_MODEL_BYTES = 64 << 20
RUN_BYTES = 4 << 20  # text that is encoded at a time: more of it shares more pieces
# Field numbers and piece kinds of the model format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of every field of a protobuf message; messages and strings are bytes."""
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(raw, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = raw[at:at + size], at + size
        elif kind == 2:
            size, at = _varint(raw, at)
            value, at = raw[at:at + size], at + size
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


@dataclass
class Model:
    """What encoding needs of a model file."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    kind: int = UNIGRAM
    unknown: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    trims_spaces: bool = True
    marks_spaces: bool = True

    @property
    def bytes_known(self) -> bool:
        return BYTE in self.kinds


def parse(raw: bytes) -> Model:
    model = Model()
    for number, value in fields(raw):
        if number == PIECES:
            own = dict(fields(value))
            model.pieces.append(own.get(1, b"").decode())
            model.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
            model.kinds.append(own.get(3, NORMAL))
        elif number == TRAINER:
            model.kind = dict(fields(value)).get(3, UNIGRAM)
        elif number == NORMALIZER:
            own = dict(fields(value))
            model.charsmap = own.get(2, b"")
            model.dummy_prefix, model.trims_spaces, model.marks_spaces = (bool(own.get(k, 1)) for k in (3, 4, 5))
    if UNKNOWN in model.kinds:
        model.unknown = model.kinds.index(UNKNOWN)
    return model


def merges(model: Model) -> list[tuple[str, str]]:
    """Pairs to merge, best first: each piece from any two pieces that make it up."""
    rank = {p: i for i, p in enumerate(model.pieces) if model.kinds[i] in (NORMAL, USER_DEFINED, UNUSED)}
    found = []
    for piece, i in rank.items():
        for cut in range(1, len(piece)):
            left, right = rank.get(piece[:cut]), rank.get(piece[cut:])
            if left is not None and right is not None:
                found.append((-model.scores[i], i, left, right))
    return [(model.pieces[a], model.pieces[b]) for _, _, a, b in sorted(found)]


def tokenizer(model: Model):
    """A tokenizers.Tokenizer that behaves like the model."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.kind == UNIGRAM:
        core = models.Unigram(list(zip(model.pieces, model.scores)), unk_id=model.unknown, byte_fallback=model.bytes_known)
    elif model.kind == BPE:
        core = models.BPE(vocab={p: i for i, p in enumerate(model.pieces)}, merges=merges(model), unk_token=model.pieces[model.unknown],
                          fuse_unk=True, byte_fallback=model.bytes_known)
    else:
        raise ValueError(f"model type {model.kind}")
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.trims_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if model.marks_spaces else " "))
    if model.marks_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    if steps:
        out.normalizer = normalizers.Sequence(steps)
    if cuts_at_marks(model):
        # Cutting before runs of markers changes no ids and lets the library reuse words.
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
    strip = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
    return out


def cuts_at_marks(model: Model) -> bool:
    """Whether no piece has a marker behind another character."""
    return model.marks_spaces and not any(MARK in p.lstrip(MARK) for p, k in zip(model.pieces, model.kinds) if k == NORMAL)


class Codec:
    """Encodes and decodes with a parsed model; kept for the life of a worker."""

    _kept: dict[int, Codec] = {}

    def __init__(self, raw: bytes):
        self.raw, self.judge = raw, None
        self.model = parse(raw)
        self.tokenizer = tokenizer(self.model)
        plain = [struct.pack("B", int(p[3:5], 16)) if k == BYTE else b"" if k in (CONTROL, UNKNOWN) else p.replace(MARK, " ").encode()
                 for p, k in zip(self.model.pieces, self.model.kinds)]
        self.plain = plain
        self.special = frozenset(i for i, k in enumerate(self.model.kinds) if k in (CONTROL, UNKNOWN))
        m = self.model
        # Pieces may be encoded apart only where the normaliser keeps every character and none is unknown.
        self.apart = (m.bytes_known and m.dummy_prefix and not m.trims_spaces and not m.charsmap and cuts_at_marks(m)
                      and not any("\n" in p for p, k in zip(m.pieces, m.kinds) if k == NORMAL))
        self.encoder = PieceEncoder(self.tokenizer, np.array([len(p) for p in plain], np.int64), lead=" ", stops=False, odd=MARK, white=b" ", lines=True)
        sizes = np.array([len(p) for p in plain], np.int64)
        self.pool, self.pool_ends = np.frombuffer(b"".join(plain), np.uint8), np.concatenate([[0], np.cumsum(sizes)])

    @classmethod
    def of(cls, raw: bytes) -> Codec:
        key = zlib.crc32(raw)
        if key not in cls._kept:
            cls._kept[key] = cls(raw)
        return cls._kept[key]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        ids, ends = self.encode_array(pa.array(texts, pa.string()))
        return [p.astype("<u4").tobytes() for p in np.split(ids, ends[:-1])] if texts else []

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each ends)."""
        if self.apart:
            return self.encoder.encode_array(texts)
        parts = [np.frombuffer(x, "<u4") for x in self.encoder.whole([t or "" for t in texts.to_pylist()])]
        return np.concatenate([np.zeros(0, np.uint32), *parts]), np.cumsum([len(p) for p in parts], dtype=np.int64)

    def parity(self, texts: list[str | None], ids: np.ndarray, ends: np.ndarray) -> list[bool]:
        """Whether the sentencepiece library encodes each text alike."""
        if self.judge is None:
            from sentencepiece import SentencePieceProcessor

            self.judge = SentencePieceProcessor(model_proto=self.raw)
        own = np.split(ids.astype(np.int32), ends[:-1])
        return [np.array_equal(self.judge.encode_as_numpy(t or ""), mine) for t, mine in zip(texts, own)]

    def rest(self) -> None:
        """Lets go what only a running task needs: known pieces and the judge. Their memory goes back to the system: the worker lives on for other stages."""
        self.encoder.clear()
        self.judge = None
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    def decoded(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts, where each ends), without the space put in front."""
        begin = self.pool_ends[ids]
        size = self.pool_ends[ids.astype(np.int64) + 1] - begin
        upto = np.concatenate([[0], np.cumsum(size)])
        data = self.pool[np.arange(upto[-1]) + np.repeat(begin - upto[:-1], size)]
        edge = np.concatenate([[0], upto[ends]])
        if self.model.dummy_prefix:
            first = edge[:-1][np.diff(edge) > 0]
            lead = first[data[first] == 32]
            keep = np.ones(len(data), bool)
            keep[lead] = False
            edge = edge - np.searchsorted(lead, edge)
            data = data[keep]
        return data, edge[1:]

    def round_trips(self, texts: pa.Array, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether the ids of each text give its bytes again."""
        data, upto = self.decoded(ids, ends)
        own, offsets = flat(texts)
        same = np.diff(upto, prepend=0) == np.diff(offsets)
        if len(data) == len(own) and same.all():
            wrong = np.flatnonzero(data != own)
            same[np.searchsorted(offsets, wrong, "right") - 1] = False
            return same
        start = np.concatenate([[0], upto])
        for i in np.flatnonzero(same):
            same[i] = np.array_equal(data[start[i]:start[i + 1]], own[offsets[i]:offsets[i + 1]])
        return same

    def decode(self, ids: bytes) -> str:
        """Text of ids, as the tokenizer's decoder gives it: bytes that are no UTF-8 become replacement characters."""
        plain = self.plain
        raw = b"".join([plain[i] for i in np.frombuffer(ids, "<u4").tolist()])
        text = raw.decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


def model_bytes(path: str) -> bytes:
    raw = open(path, "rb").read()
    if len(raw) > MAX_MODEL_BYTES:
        raise ValueError(f"model file of more than {MAX_MODEL_BYTES} bytes")
    return raw


def encode_documents(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", verify: bool = True) -> DataFrame:
    """Per row: id, ids (array of int), n_tokens, ids_crc32 (of the ids as little-endian 32-bit), n_bytes (byte pieces),
    round_trip (the decoded ids give the text again) and, with ``verify``, parity (the sentencepiece library gives the
    same ids for the whole text; null otherwise).

    Null texts count as empty: no ids, round_trip true. Ids may repeat or be null. Other columns are ignored.
    """
    shape = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()),
                       ("n_bytes", pa.int64()), ("round_trip", pa.bool_()), ("parity", pa.bool_())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(model)
        yield from encoded(codec, batches)
        codec.rest()

    def encoded(codec: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_byte = np.array([k == BYTE for k in codec.model.kinds])
        for run in runs(batches, "text", RUN_BYTES):
            texts = run.column(1)
            ids, ends = codec.encode_array(texts)
            edge = np.concatenate([[0], ends]).astype(np.int32)
            held = np.concatenate([[0], np.cumsum(is_byte[ids])])
            raw = ids.astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays([
                run.column(0), pa.ListArray.from_arrays(pa.array(edge), pa.array(ids.astype(np.int32))), pa.array(np.diff(edge).astype(np.int64)),
                pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())], pa.int64()),
                pa.array(held[edge[1:]] - held[edge[:-1]]), pa.array(codec.round_trips(texts, ids, ends)),
                pa.array(codec.parity(texts.to_pylist(), ids, ends) if verify else [None] * len(texts), pa.bool_())], schema=shape)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(encode, "doc_id long, ids array<int>, n_tokens long, ids_crc32 long, n_bytes long, round_trip boolean, parity boolean")


def decode_documents(coded: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from arrays of ids; null arrays give an empty text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [codec.decode(np.asarray(ids or [], "<u4").tobytes()) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(decode, "doc_id long, text string")
