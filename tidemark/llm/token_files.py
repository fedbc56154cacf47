"""Token files: documents encoded with a tokenizers file, stored as directly addressable codes.

A file is a sequence of sections, each with the ids of whole documents, and ends with a directory of its sections:

    section   documents n, flags of documents without an id, document ids, end offsets (in tokens), coded ids
    directory for each section: byte offset, bytes, documents, tokens
    trailer   bytes of the directory, b"TOKDAC01"

Documents are dealt over files by ranges of doc_id and sorted inside; the manifest, a written table, names the files
that count with their places in that order. Files of lost or repeated tasks stay unnamed.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.llm.dac import Codes, pack
from tidemark.llm.files import new_file, resolve, shared_folder, written
from tidemark.llm.pieces import PieceEncoder
from tidemark.llm.text import runs

MAGIC = b"TOKDAC01"
SECTION_TOKENS = 1 << 20
RUN_BYTES = 4 << 20  # text that is encoded at a time: more of it shares more pieces
#: A tokenizer file travels to the executors inside the job; larger ones are refused.
MAX_TOKENIZER_BYTES = 64 << 20
_ENTRY = struct.Struct("<QQQQ")

_ENCODERS: dict[int, PieceEncoder] = {}


def tokenizer_json(path: str) -> str:
    raw = open(path, encoding="utf-8").read()
    if len(raw) > MAX_TOKENIZER_BYTES:
        raise ValueError(f"tokenizer file of more than {MAX_TOKENIZER_BYTES} bytes")
    return raw


def byte_level_encoder(source: str) -> PieceEncoder:
    """The encoder of a byte-level BPE tokenizer, kept for the life of a worker. Its special strings are plain text."""
    key = zlib.crc32(source.encode())
    if key not in _ENCODERS:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(source)
        tokenizer.encode_special_tokens = True
        # In a byte-level vocabulary every character of a token stands for one byte.
        lengths = np.zeros(tokenizer.get_vocab_size(), np.int64)
        for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
            lengths[i] = len(token)
        _ENCODERS[key] = PieceEncoder(tokenizer, lengths)
    return _ENCODERS[key]


class _Writer:
    def __init__(self, folder: str):
        self.path, self.stream = new_file(folder, ".tok")
        self.entries: list[tuple[int, int, int, int]] = []
        self.at = 0
        self.clear()

    def clear(self) -> None:
        self.docs: list[np.ndarray] = []
        self.missing: list[np.ndarray] = []
        self.ids: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.tokens = 0

    def add(self, docs: pa.Array, ids: np.ndarray, ends: np.ndarray) -> None:
        """Documents of a batch with all their ids, end ids among them."""
        self.docs.append(docs.fill_null(0).to_numpy(zero_copy_only=False))
        self.missing.append(docs.is_null().to_numpy(zero_copy_only=False))
        self.ids.append(ids)
        self.sizes.append(np.diff(ends, prepend=0))
        self.tokens += len(ids)
        if self.tokens >= SECTION_TOKENS:
            self.flush()

    def flush(self) -> None:
        if not self.docs:
            return
        docs, ends = np.concatenate(self.docs), np.cumsum(np.concatenate(self.sizes))
        raw = b"".join([struct.pack("<Q", len(docs)), np.concatenate(self.missing).astype(np.uint8).tobytes(), docs.astype("<i8").tobytes(),
                        ends.astype("<u8").tobytes(), pack(np.concatenate(self.ids))])
        self.stream.write(raw)
        self.entries.append((self.at, len(raw), len(docs), self.tokens))
        self.at += len(raw)
        self.clear()

    def close(self) -> tuple[int, int, int]:
        self.flush()
        directory = b"".join(_ENTRY.pack(*e) for e in self.entries)
        self.stream.write(directory + struct.pack("<Q", len(directory)) + MAGIC)
        self.stream.close()
        return sum(e[2] for e in self.entries), sum(e[3] for e in self.entries), self.at + len(directory) + 16


class TokenFile:
    """Random access to a token file: a token or a document is read without decoding others."""

    def __init__(self, path: str):
        system, name = resolve(path)
        self.file = system.open_input_file(name)
        size = self.file.size()
        length, magic = struct.unpack("<Q8s", self.file.read_at(16, size - 16))
        if magic != MAGIC:
            raise ValueError(f"{path}: not a token file")
        raw = self.file.read_at(length, size - 16 - length)
        self.entries = [_ENTRY.unpack_from(raw, i) for i in range(0, length, _ENTRY.size)]
        self.n_docs, self.n_tokens = sum(e[2] for e in self.entries), sum(e[3] for e in self.entries)

    def section(self, k: int) -> tuple[list[int | None], np.ndarray, Codes]:
        """(document ids, end offsets, codes) of a section."""
        at, size, docs, _ = self.entries[k]
        raw = self.file.read_at(size, at)
        missing = np.frombuffer(raw, np.uint8, docs, 8)
        ids = np.frombuffer(raw, "<i8", docs, 8 + docs).tolist()
        ends = np.frombuffer(raw, "<u8", docs, 8 + 9 * docs).astype(np.int64)
        return [None if m else i for m, i in zip(missing.tolist(), ids)], ends, Codes(raw, 8 + 17 * docs)

    def token(self, i: int) -> int:
        """Token ``i`` of the file."""
        for k, e in enumerate(self.entries):
            if i < e[3]:
                return self.section(k)[2][i]
            i -= e[3]
        raise IndexError(i)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.entries)):
            docs, ends, codes = self.section(k)
            at = 0
            for doc, end in zip(docs, ends.tolist()):
                yield doc, codes.slice(at, end)
                at = end

    def close(self) -> None:
        self.file.close()


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Encode every whole text, append ``end_id``, write token files to ``folder`` and return their manifest.

    Documents lie in ascending ``id_col`` order (nulls first, equal ids by text). A null text counts as empty and
    keeps its end id. Other columns are ignored. The manifest has path, order (first id, then path), n_docs, n_tokens
    and bytes; an empty table gives an empty manifest.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out, first = byte_level_encoder(tokenizer), None, None
        for run in runs(batches, "text", RUN_BYTES):
            if out is None:
                out, first = _Writer(folder), run.column(0)[0].as_py()
            ids, ends = encoder.encode_array(run.column(1))
            out.add(run.column(0), np.insert(ids, ends, np.uint32(end_id)), ends + np.arange(1, len(ends) + 1))
        encoder.clear()
        if out is not None:
            n_docs, n_tokens, size = out.close()
            yield pa.RecordBatch.from_pylist([{"path": out.path, "first_id": first, "n_docs": n_docs,
                                               "n_tokens": n_tokens, "bytes": size}])

    rows = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
            .mapInArrow(encode, "path string, first_id long, n_docs long, n_tokens long, bytes long"))
    return written(rows, f"{folder}/manifest")


def read_documents(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and its file.

    Files are read section by section; the running start over files comes from the manifest, one row per file.
    """
    before = Window.orderBy(F.col("first_id").asc_nulls_first(), "path").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file, rows = TokenFile(path), {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                for doc, ids in file.documents():
                    rows["doc_id"].append(doc)
                    rows["start"].append(base)
                    rows["n_tokens"].append(len(ids))
                    rows["ids_crc32"].append(zlib.crc32(ids.astype("<u4").tobytes()))
                    base += len(ids)
                file.close()
                rows["file"] = [path.rsplit("/", 1)[-1]] * len(rows["doc_id"])
                yield pa.RecordBatch.from_pydict(rows, schema=pa.schema(
                    [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()),
                     ("file", pa.string())]))

    # One task per file: without a number, so few rows would end in one task.
    spread = files.select("path", "base").repartition(max(1, manifest.count()))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, file string")


def token_documents(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and read them back."""
    return read_documents(write_tokens(docs, shared_folder(spark, "tokens"), tokenizer))
