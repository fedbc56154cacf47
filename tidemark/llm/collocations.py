"""Phrase collocations from exact n-gram counts, gathered in HAT-tries.

A task counts the word triples of its texts in a trie: a table of first words, each with a hash container of the two words
behind it; a container that grows past BURST bursts into one container for each second word. What a path has in common is
counted once: the count of a pair is the sum below it. When a trie holds more than ENTRIES, its largest subtrees leave it
whole, as one sorted run, until half is left; the rest leaves at the end of the task. A run is cut by the prefix (its first two words), so that all runs of a
prefix meet in one task, which merges them and keeps what is frequent. Words travel as text, so counts are exact.

Runs go out through the shuffle and are never kept on an executor. Where the prefixes need more parts than a run can be cut into,
runs are merged in stretches and cut further in rounds, so a task holds a bounded number of entries at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.files import shared_folder, written
from tidemark.llm.text import _hashes, mix, runs

LEAST, REPORTED = 10, 2000
ENTRIES, BURST = 3 << 18, 1 << 11
BYTES = 2 << 20          # text that is cut into words at a time
PART_BYTES = 4 << 20     # prefixes are dealt over so many parts that each stands for about so much text
CUT = 4096               # parts a run is cut into at most; more come about in several rounds
MERGED = 1 << 20         # entries merged at a time in all rounds but the last
_BITS = 21               # of a word's number; three fill an integer
_MANY = (1 << _BITS) - 1

_BYTE = np.arange(256)
_LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
_SPACE = np.isin(_BYTE, [0x20, 0x09])
_BREAK = np.isin(_BYTE, [*b".,;:!?", *range(0x0A, 0x0E)])
BLOCKS = "lang string, kind int, part long, entries long, total long, block binary"
COUNTS = "lang string, w1 string, w2 string, w3 string, f long"
WORDS, PHRASES = 1, 2


def triples(data: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, number of each word, whether the next one stands behind it in its piece) of a text's bytes."""
    inside = ~(_SPACE | _BREAK)[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    values = _LOWER[data[inside]]
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(values)]).dictionary_encode()
    piece = np.cumsum(_BREAK[data], dtype=np.int32)[start]
    return words.dictionary, words.indices.to_numpy(), piece[1:] == piece[:-1]


class HatTrie:
    """Counts of word triples; a missing second or third word has the number 0."""

    def __init__(self, entries: int = ENTRIES, burst: int = BURST):
        self.entries, self.burst = entries, burst
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.root: dict[int, dict] = {}
        self.bursts: set[int] = set()
        self.sizes: dict[int, int] = {}
        self.held = 0

    def add(self, data: np.ndarray) -> None:
        """Counts the triples that begin at the words of ``data``, bytes of text."""
        words, own, joined = triples(data)
        if not len(own):
            return
        numbers = self.numbers
        known = np.array([numbers.setdefault(w, len(numbers) + 1) for w in words.to_pylist()], np.int64)[own]
        second, third = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
        second[:-1] = np.where(joined, known[1:], 0)
        third[:-1] = np.where(joined, second[1:], 0)
        keys, counts = np.unique((known << 2 * _BITS) | (second << _BITS) | third, return_counts=True)
        firsts = keys >> 2 * _BITS
        edges = np.flatnonzero(np.diff(firsts, prepend=-1, append=-1)).tolist()
        heads, rests, counts = firsts[edges[:-1]].tolist(), (keys & ((1 << 2 * _BITS) - 1)).tolist(), counts.tolist()
        for head, a, b in zip(heads, edges, edges[1:]):
            self._insert(head, rests[a:b], counts[a:b])

    def _insert(self, head: int, rests: list[int], counts: list[int]) -> None:
        box = self.root.setdefault(head, {})
        before = self.sizes.get(head, 0)
        if head in self.bursts:
            fresh = 0
            for rest, n in zip(rests, counts):
                leaf = box.setdefault(rest >> _BITS, {})
                fresh -= len(leaf)
                leaf[rest & _MANY] = leaf.get(rest & _MANY, 0) + n
                fresh += len(leaf)
            after = before + fresh
        else:
            for rest, n in zip(rests, counts):
                box[rest] = box.get(rest, 0) + n
            after = len(box)
            if after > self.burst:
                self.root[head] = parts = {}
                for rest, n in box.items():
                    parts.setdefault(rest >> _BITS, {})[rest & _MANY] = n
                self.bursts.add(head)
        self.sizes[head] = after
        self.held += after - before

    @property
    def weight(self) -> int:
        """Entries, with a subtree taken for two more and a word for one."""
        return self.held + 2 * len(self.root) + len(self.numbers)

    def full(self) -> bool:
        return self.weight > self.entries

    def spill(self, everything: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(distinct words in ascending order, sorted keys, counts) of whole subtrees, the largest first, until half is left.

        Where the words alone take up much of the room, all goes.
        """
        everything |= 4 * len(self.numbers) > self.entries
        gone, left = [], self.weight
        for head in sorted(self.root, key=self.sizes.__getitem__, reverse=True):
            if not everything and left <= self.entries // 2:
                break
            gone.append(head)
            left -= self.sizes[head] + 2
        # Plain lists first: most containers are small.
        rests, counts, lengths, tops = [], [], [], []
        for head in gone:
            box = self.root.pop(head)
            parts = [(s << _BITS, leaf) for s, leaf in box.items()] if head in self.bursts else [(0, box)]
            for second, leaf in parts:
                rests += leaf
                counts += leaf.values()
                lengths.append(len(leaf))
                tops.append(head << 2 * _BITS | second)
            self.bursts.discard(head)
            self.held -= self.sizes.pop(head)
        keys = np.array(rests, np.int64) | np.repeat(np.array(tops, np.int64), lengths)
        counts = np.array(counts, np.int64)
        del rests
        names = pa.array(list(self.numbers), pa.binary())
        words, keys = _renumbered(names, keys)
        order = np.argsort(keys, kind="stable")
        if everything:
            self.clear()
        return words, keys[order], counts[order]


def _joined(texts: pa.Array, between: bytes) -> pa.Buffer:
    lists = pa.LargeListArray.from_arrays(pa.array([0, len(texts)], pa.int64()), texts.cast(pa.large_binary()))
    return pc.binary_join(lists, pa.scalar(between, pa.large_binary()))[0].as_buffer()


def _split(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return keys >> 2 * _BITS, (keys >> _BITS) & _MANY, keys & _MANY


def _selected(words: pa.Array, keys: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The ones of ``words``, in ascending order, that a few of their keys use, and the keys with numbers among them."""
    parts = _split(keys)
    used = np.unique(np.concatenate([np.zeros(1, np.int64), *parts]))
    a, b, c = (np.searchsorted(used, p) for p in parts)
    return words.take(pa.array(used[1:] - 1)), (a << 2 * _BITS) | (b << _BITS) | c


def _renumbered(names: pa.Array, keys: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words that ``keys`` use, in ascending order, and the keys with numbers that follow that order."""
    used = np.zeros(len(names) + 1, bool)
    for part in _split(keys):
        used[part] = True
    used[0] = False
    at = np.flatnonzero(used)
    words = names.take(pa.array(at - 1))
    order = pc.sort_indices(words).to_numpy()
    new = np.zeros(len(names) + 1, np.int64)
    new[at[order]] = np.arange(1, len(at) + 1)
    a, b, c = _split(keys)
    return words.take(pa.array(order)), (new[a] << 2 * _BITS) | (new[b] << _BITS) | new[c]


def _word_hashes(words: pa.Array) -> np.ndarray:
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64) if len(words) else np.zeros(1, np.int64)
    raw = words.buffers()[2] if len(words) else None
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return _hashes(data, offsets[:-1], offsets[1:])


def _blocks(lang: str, kind: int, words: pa.Array, keys: np.ndarray, counts: np.ndarray, parts: int) -> Iterator[dict]:
    """The run as blocks, one for each part of the prefixes, each with the words it uses."""
    if not len(keys):
        return
    own = np.concatenate([np.zeros(1, np.uint64), _word_hashes(words)])
    first, second, _ = _split(keys)
    with np.errstate(over="ignore"):
        part = (mix(own[first] * np.uint64(3) + own[second]) % np.uint64(parts)).astype(np.int64)
    # Sorting 16-bit numbers stably is linear.
    order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
    edges = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1))
    for a, b in zip(edges, edges[1:]):
        rows = order[a:b]
        table, short = _selected(words, keys[rows])
        # Words hold no space. The numbers of first, second and third words lie apart, since neighbours are alike.
        raw = _joined(table, b" ")
        block = b"".join([np.array([len(raw), len(table)], "<u4").tobytes(), raw, *(x.astype("<u4").tobytes() for x in _split(short)),
                          counts[rows].astype("<u8").tobytes()])
        yield {"lang": lang, "kind": kind, "part": int(part[rows[0]]), "entries": len(rows), "total": int(counts[rows].sum()), "block": block}


def _run(lang: str, words: pa.Array, keys: np.ndarray, counts: np.ndarray, parts: int) -> Iterator[dict]:
    """Blocks of a trie's run: words with their sums, and triples that have a second word."""
    if len(keys):
        heads = np.flatnonzero(np.diff(keys >> 2 * _BITS, prepend=-1))
        yield from _blocks(lang, WORDS, words, keys[heads] >> 2 * _BITS << 2 * _BITS, np.add.reduceat(counts, heads), parts)
        joined = (keys >> _BITS) & _MANY > 0
        yield from _blocks(lang, PHRASES, words, keys[joined], counts[joined], parts)


def _read(block: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    size, n = np.frombuffer(block, "<u4", 2).tolist()
    words = pc.split_pattern(pa.array([block[8:8 + size]], pa.binary()), b" ").values
    rest = (len(block) - 8 - size) // 20
    a, b, c = np.frombuffer(block, "<u4", 3 * rest, 8 + size).astype(np.int64).reshape(3, rest)
    return words, (a << 2 * _BITS) | (b << _BITS) | c, np.frombuffer(block, "<u8", rest, 8 + size + 12 * rest).astype(np.int64)


def merge(blocks: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """One sorted run out of several: equal triples once, with the sum of their counts."""
    tables, keys, counts = zip(*map(_read, blocks))
    names = pa.concat_arrays(tables).dictionary_encode()
    where, at, moved = np.concatenate([[0], names.indices.to_numpy().astype(np.int64) + 1]), 0, []
    for table, k in zip(tables, keys):
        new = np.concatenate([where[:1], where[at + 1:at + 1 + len(table)]])
        a, b, c = _split(k)
        moved.append((new[a] << 2 * _BITS) | (new[b] << _BITS) | new[c])
        at += len(table)
    words, keys = _renumbered(names.dictionary, np.concatenate(moved))
    order = np.argsort(keys, kind="stable")  # runs that are sorted already are merged
    keys, counts = keys[order], np.concatenate(counts)[order]
    heads = np.flatnonzero(np.diff(keys, prepend=-1))
    return words, keys[heads], np.add.reduceat(counts, heads) if len(heads) else counts


_BLOCK_ROW = pa.schema([("lang", pa.string()), ("kind", pa.int32()), ("part", pa.int64()), ("entries", pa.int64()), ("total", pa.int64()),
                        ("block", pa.binary())])


def _packed(rows: Iterator[dict], size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of blocks in batches of bounded size."""
    some, held = [], 0
    for row in rows:
        some.append(row)
        held += len(row["block"]) + 100
        if held > size:
            yield pa.RecordBatch.from_pylist(some, schema=_BLOCK_ROW)
            some, held = [], 0
    if some:
        yield pa.RecordBatch.from_pylist(some, schema=_BLOCK_ROW)


def _stretches(data: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """``data`` cut behind ends of pieces into about ``size`` bytes each; a longer piece stays whole."""
    at = 0
    while at < len(data):
        to = min(at + size, len(data))
        if to < len(data):
            ends = np.flatnonzero(_BREAK[data[at:to]])
            while not len(ends) and to < len(data):
                begin, to = to, min(to + size, len(data))
                ends = np.flatnonzero(_BREAK[data[begin:to]]) + begin - at
            to = at + int(ends[-1]) + 1 if len(ends) else len(data)
        yield data[at:to]
        at = to


def _groups(batches: Iterator[pa.RecordBatch], limit: int | None = None) -> Iterator[tuple[str, int, list[bytes], int]]:
    """(lang, kind, blocks, total) of consecutive rows of one part; with ``limit`` in stretches of so many entries."""
    own, blocks, entries, total = None, [], 0, 0
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(5)]
        for i, (lang, kind, part, n, rows) in enumerate(zip(*columns)):
            if own != (lang, kind, part) or limit is not None and entries + n > limit:
                if blocks:
                    yield own[0], own[1], blocks, total
                own, blocks, entries, total = (lang, kind, part), [], 0, 0
            blocks.append(batch.column(5)[i].as_py())
            entries += n
            total += rows
    if blocks:
        yield own[0], own[1], blocks, total


def _frequent(kind: int, words: pa.Array, keys: np.ndarray, counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of words or phrases that occur ``least`` times; a pair's count is the sum of the triples that begin with it."""
    if kind == WORDS:
        return keys[counts >= least], counts[counts >= least]
    heads = np.flatnonzero(np.diff(keys >> _BITS, prepend=-1))
    pairs, sums = keys[heads] >> _BITS << _BITS, np.add.reduceat(counts, heads)
    triple = (keys & _MANY > 0) & (counts >= least)
    return np.concatenate([pairs[sums >= least], keys[triple]]), np.concatenate([sums[sums >= least], counts[triple]])


def count_phrases(docs: DataFrame, least: int = LEAST, lang_col: str = "lang", text_col: str = "text", entries: int = ENTRIES, burst: int = BURST,
                  parts: int | None = None, cut: int = CUT) -> DataFrame:
    """Exact counts per language (lang, w1, w2, w3, f) of words, pairs and triples that occur at least ``least`` times; the others are null.

    A row with only lang has the number of all its words, in parts to be added up.
    """
    rows = docs.select(F.coalesce(lang_col, F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    if parts is None:
        parts = 1 + (rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // PART_BYTES
    first = min(parts, cut)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def spilled() -> Iterator[dict]:
            tries: dict[str, HatTrie] = {}
            for run in runs(batches, "text", BYTES):
                run = run.filter(pc.greater(pc.fill_null(pc.binary_length(run.column(1)), 0), 0))
                for lang in pc.unique(run.column(0)).to_pylist():
                    # A line end keeps the texts of a run apart.
                    texts = run.column(1).filter(pc.equal(run.column(0), lang))
                    data = np.frombuffer(_joined(texts, b"\n"), np.uint8)
                    trie = tries.setdefault(lang, HatTrie(entries, burst))
                    for stretch in _stretches(data, BYTES):
                        trie.add(stretch)
                        while sum(t.weight for t in tries.values()) > entries:
                            full = max(tries, key=lambda x: tries[x].weight)
                            yield from _run(full, *tries[full].spill(everything=len(tries) > 1 and not tries[full].full()), first)
                            if not tries[full].held:
                                del tries[full]
                                break
            for lang, trie in tries.items():
                yield from _run(lang, *trie.spill(everything=True), first)

        yield from _packed(spilled())

    def recut(size: int):
        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _packed(row for lang, kind, blocks, _ in _groups(batches, MERGED) for row in _blocks(lang, kind, *merge(blocks), size))
        return again

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.schema([("lang", pa.string()), ("w1", pa.string()), ("w2", pa.string()), ("w3", pa.string()), ("f", pa.int64())])
        for lang, kind, blocks, total in _groups(batches):
            words, keys, counts = merge(blocks)
            keys, counts = _frequent(kind, words, keys, counts, least)
            names = pa.concat_arrays([pa.array([None], pa.binary()), words.cast(pa.binary())])
            columns = [pa.compute.cast(names.take(pa.array(c)), pa.string(), safe=False) for c in _split(keys)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), *columns, pa.array(counts)], schema=shape)
            if kind == WORDS:
                yield pa.RecordBatch.from_pylist([{"lang": lang, "f": total}], schema=shape)

    blocks, now = rows.mapInArrow(count, BLOCKS), first
    while now < parts:
        # Parts of one cut are unions of parts of the next.
        now = min(now * cut, -(-parts // now) * now)
        blocks = blocks.repartition("lang", "kind", "part").sortWithinPartitions("lang", "kind", "part").mapInArrow(recut(now), BLOCKS)
    return blocks.repartition("lang", "kind", "part").sortWithinPartitions("lang", "kind", "part").mapInArrow(merged, COUNTS)


#: The best of a language are chosen among the best of so many lots, so no task sees more than lots times REPORTED rows.
LOTS = 64


def collocations(docs: DataFrame, least: int = LEAST, reported: int = REPORTED, inside: int = 50, lang_col: str = "lang", text_col: str = "text", **counting) -> DataFrame:
    """The best phrases of two or three words per language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends and those into words at spaces and tabs. A phrase
    occurs ``a`` times, at least ``least``. Cut in two, its parts occur l and r times; the score is floor(1000000 a a / (l r)) of the cut for
    which that is least, the first such cut if several. A pair goes where a triple that holds it occurs in at least ``inside`` percent of its
    places. n is the number of all words. Order: score, a (descending), phrase in byte order. A null language is ``und``; null and empty texts
    count nothing; repeated rows count each time.
    """
    spark = docs.sparkSession
    found = written(count_phrases(docs, least, lang_col, text_col, **counting), f"{shared_folder(spark, 'collocations')}/counts")
    totals = found.filter("w1 is null").groupBy("lang").agg(F.sum("f").alias("n"))
    words = found.filter("w1 is not null and w2 is null").select("lang", F.col("w1").alias("w"), "f")
    pairs = found.filter("w2 is not null and w3 is null").select("lang", "w1", "w2", F.col("f").alias("a"))
    triples_ = found.filter("w3 is not null").select("lang", "w1", "w2", "w3", F.col("f").alias("a"))

    def word(df: DataFrame, w: str, out: str) -> DataFrame:
        return df.join(words.select("lang", F.col("w").alias(w), F.col("f").alias(out)), ["lang", w])

    def pair(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
        return df.join(pairs.select("lang", F.col("w1").alias(a), F.col("w2").alias(b), F.col("a").alias(out)), ["lang", a, b])

    def score(left: str, right: str) -> str:
        # a may have 16 digits; products are decimals of up to 38.
        wide = [f"cast({c} as decimal(19, 0))" for c in ("a", "a", left, right)]
        return f"((1000000BD * {wide[0]} * {wide[1]}) div ({wide[2]} * {wide[3]}))"

    held = triples_.select("lang", "a", F.inline(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))))
    longest = held.groupBy("lang", "w1", "w2").agg(F.max("a").alias("longer"))
    free = pairs.join(longest, ["lang", "w1", "w2"], "left").filter(f"longer is null or 100 * longer < {inside} * a").drop("longer")
    two = word(word(free, "w1", "l"), "w2", "r").select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", F.expr(score("l", "r")).alias("score"))
    three = word(word(pair(pair(triples_, "w1", "w2", "f12"), "w2", "w3", "f23"), "w1", "f1"), "w3", "f3")
    three = three.withColumn("s1", F.expr(score("f1", "f23"))).withColumn("s2", F.expr(score("f12", "f3")))
    early = F.col("s1") <= F.col("s2")
    three = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(early, F.col("f1")).otherwise(F.col("f12")).alias("l"),
                         F.when(early, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"))
    order, best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], two.union(three).withColumn("lot", F.pmod(F.xxhash64("phrase"), F.lit(LOTS)))
    for among in (["lang", "lot"], ["lang"]):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*among).orderBy(*order))).filter(F.col("rank") <= reported)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
