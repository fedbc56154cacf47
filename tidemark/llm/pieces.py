"""Encoding with the tokenizers library where recurring pieces of text are encoded once.

A text is cut where no token of the tokenizer crosses: before a stretch of white space, around a line end between other
characters and, where the tokenizer allows it, before a full stop or comma that follows a letter or digit. The ids of a text
are then the ids of its pieces in order. All texts of a batch are cut at once over their bytes, Arrow lists the different pieces and
looks them up among the known ones, only the others go to the library, and the ids are gathered with numpy. Pieces with several white space characters in a
row go to the library by themselves, so texts of any layout cost about the same.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Bytes of known pieces a worker keeps, an entry taken for its text, its ids and ENTRY (where its text and ids lie, and
#: part of the table that a look-up builds); a fuller store starts anew.
KEPT = 32 << 20
ENTRY = 48
_DIGIT_OR_LETTER = np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123)])
_STOP = np.isin(np.arange(256), [*b".,"])
#: All white space of one byte, and where longer characters that are white space begin (fixed values).
SPACES = b" \t\n\r\x0b\x0c"
_LONG_LEADS = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
_LONG = tuple(chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
_LONG_PATTERN = re.compile(b"|".join(_LONG))


def as_bytes(ids) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets) of a string array; nulls are empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


class PieceEncoder:
    """Encodes texts to ids.

    ``token_bytes[id]`` is the number of text bytes a token stands for; ``lead`` is what the tokenizer itself puts in
    front of a text, so that the first piece is treated like the others; ``stops`` says that it never joins a letter or
    digit with a full stop or comma behind it; ``white`` are the bytes that it treats as white space; ``lines`` says that
    a line end is a token of its own also beside white space; texts with the string ``odd`` are never cut.
    """

    def __init__(self, tokenizer: Tokenizer, token_bytes: np.ndarray, lead: str = "", stops: bool = True, kept: int = KEPT,
                 odd: str | None = None, white: bytes = SPACES, lines: bool = False):
        self.tokenizer, self.token_bytes, self.lead, self.stops, self.kept, self.odd, self.lines = tokenizer, token_bytes, lead, stops, kept, odd, lines
        self.white = np.isin(np.arange(256), [*white])
        self.clear()

    def clear(self) -> None:
        """Forgets all pieces."""
        # A piece's place among the known ones says where its ids lie.
        self.places = pa.array([], pa.large_binary())
        self.ids, self.begin, self.end = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.held = 0

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, from the library."""
        return [as_bytes(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Which pieces may be encoded in a row with others: a space at most, in front of other characters."""
        stop = self.white.copy()
        stop[10] = True
        stops = np.concatenate([[0], np.cumsum(stop[data], dtype=np.int64)])[edges]
        space = (data[edges[:-1]] == 32) & stop[32]
        plain = (np.diff(stops) == space) & (np.diff(edges) > space)
        # Longer white space characters are looked for where their first bytes are.
        leads = np.flatnonzero(_LONG_LEADS[data])
        for i in np.unique(np.searchsorted(edges, leads, "right") - 1).tolist():
            plain[i] = plain[i] and _LONG_PATTERN.search(data[edges[i]:edges[i + 1]].tobytes()) is None
        return plain

    def _learn(self, pieces: pa.Array) -> np.ndarray:
        """Encode new pieces, plain ones many in a row; a piece that does not start with white space goes behind a line end. Gives their places."""
        offsets = np.frombuffer(pieces.buffers()[1], np.int64)[:len(pieces) + 1]
        plain = self._plain(np.frombuffer(pieces.buffers()[2], np.uint8)[:offsets[-1]], offsets)
        order, many = np.argsort(~plain, kind="stable"), int(plain.sum())
        pieces = pieces.take(pa.array(order))
        parts = [p if p[0] == 32 or i >= many and (self.white[p[0]] or p.startswith(_LONG)) else b"\n" + p for i, p in enumerate(pieces.to_pylist())]
        edges = [*range(0, many, 500), *range(many, len(parts) + 1)]
        ids = np.frombuffer(b"".join(self.whole([(b"a" + b"".join(parts[a:b])).decode() for a, b in zip(edges, edges[1:])])), "<u4")
        ends = np.cumsum(self.token_bytes[ids])
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        heads = np.repeat(np.arange(1, len(edges)), np.diff(edges)) * (len(self.lead.encode()) + 1)
        upto = heads + np.cumsum(size)
        first, last = np.searchsorted(ends, upto - size), np.searchsorted(ends, upto)
        if last[-1] >= len(ends) or not ((ends[first] == upto - size) & (ends[last] == upto)).all():
            raise ValueError("a token crosses the end of a piece")
        # The line end put in front of a piece is a token that does not count.
        first = first + 1 + (size - np.diff(offsets)[order])
        places = np.empty(len(parts), np.int64)
        places[order] = np.arange(len(self.places), len(self.places) + len(parts))
        self.places = pa.concat_arrays([self.places, pieces])
        self.begin, self.end = np.concatenate([self.begin, first + len(self.ids)]), np.concatenate([self.end, last + 1 + len(self.ids)])
        self.ids = np.concatenate([self.ids, ids])
        self.held += int(size.sum()) + 4 * len(ids) + ENTRY * len(parts)
        return places

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces begin in the bytes of texts."""
        n = len(data)
        white = self.white[data]
        begin = np.zeros(n, bool)
        begin[offsets[:-1][offsets[:-1] < n]] = True
        # Before a stretch of white space, unless what precedes it is a longer white space character.
        open_ = white.copy()
        open_[1:] &= ~white[:-1]
        after_long = np.flatnonzero(open_[1:] & (data[:-1] >= 128)) + 1
        if len(after_long):
            a, b, c = (data[np.maximum(after_long - k, 0)].astype(np.int64) for k in (3, 2, 1))
            ends_white = np.isin((b << 8) | c, [int.from_bytes(w) for w in _LONG if len(w) == 2]) | np.isin(
                (a << 16) | (b << 8) | c, [int.from_bytes(w) for w in _LONG if len(w) == 3])
            open_[after_long[ends_white]] = False
        begin |= open_
        line = data == 10
        if self.lines:
            alone = np.flatnonzero(line)
            begin[alone] = True
        else:
            # A line end by itself is a piece; what follows it begins another.
            near = white | _LONG_LEADS[data]
            single = line & begin
            single[:-1] &= ~near[1:]
            alone = np.flatnonzero(single)
        begin[alone[alone + 1 < n] + 1] = True
        if self.stops:
            begin[1:] |= _STOP[data[1:]] & _DIGIT_OR_LETTER[data[:-1]]
        return np.flatnonzero(begin)

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each ends). A null text counts as empty."""
        if self.lead:
            texts = pc.fill_null(texts, "")
            lead = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", self.lead)
            texts = pc.binary_join_element_wise(lead, texts, "")
        data, offsets = flat(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        starts = self.cuts(data, offsets)
        edges = np.concatenate([starts, [len(data)]])
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        if self.held > self.kept:
            self.clear()
        place = np.array(pc.fill_null(pc.index_in(pieces.dictionary, value_set=self.places), -1), np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new] = self._learn(pieces.dictionary.take(pa.array(new)))
        slot = place[pieces.indices.to_numpy()]
        begin = self.begin[slot]
        size = self.end[slot] - begin
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.arange(upto[-1]) + np.repeat(begin - upto[:-1], size)]
        return ids, upto[np.searchsorted(starts, offsets[1:])]

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode_flat``; texts with ``odd`` go to the library whole."""
        if self.odd is not None:
            whole = pc.fill_null(pc.match_substring(texts, self.odd), False).to_numpy(zero_copy_only=False)
            if whole.any():
                ids, ends = self.encode_flat(pc.if_else(pa.array(whole), "", texts))
                parts = np.split(ids, ends[:-1])
                places = np.flatnonzero(whole)
                for i, raw in zip(places, self.whole([texts[int(i)].as_py() for i in places])):
                    parts[i] = np.frombuffer(raw, "<u4")
                return np.concatenate(parts), np.cumsum([len(p) for p in parts])
        return self.encode_flat(texts)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers, in order."""
        if not texts:
            return []
        ids, ends = self.encode_array(pa.array(texts, pa.string()))
        return [p.astype("<u4").tobytes() for p in np.split(ids, ends[:-1])]
