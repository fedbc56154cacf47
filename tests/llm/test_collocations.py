"""Collocations against plain counting; tries that burst and spill, runs cut in rounds."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tidemark.llm.collocations import HatTrie, _read, _run, _stretches, collocations, count_phrases, merge

SCHEMA = "doc_id long, text string, lang string, phrase string, w1 int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))]


def count(texts):
    f = Counter()
    for t in texts:
        for ws in pieces(t):
            for k in (1, 2, 3):
                f.update(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1))
    return f


def brute(rows, least=10, reported=2000):
    langs = defaultdict(list)
    for _, text, lang in rows:
        langs[lang if lang is not None else "und"].append(text)
    out = []
    for lang, texts in langs.items():
        f = count(texts)
        n = sum(v for k, v in f.items() if len(k) == 1)
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            if len(p) == 2 and any(len(q) == 3 and b >= least and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in f.items()):
                continue
            cuts = [(10 ** 6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:reported], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def texts(seed, n, words="alpha beta gamma delta Epsilon zeta eta theta é ünï a.b x-y"):
    rng = np.random.default_rng(seed)
    vocabulary = words.split()
    ends = [" ", " ", " ", " ", "  ", "\t", ". ", ", ", "\n", "? ", " ", "\x0b"]
    return ["".join(vocabulary[int(i)] + ends[int(j)] for i, j in zip(rng.zipf(1.4, 60) % len(vocabulary), rng.integers(0, len(ends), 60))) for _ in range(n)]


ROWS = [(i, t, ["en", "en", "en", "de", None, "und", ""][i % 7]) for i, t in enumerate(texts(1, 140))] + [
    (500, None, "en"), (501, "", "fr"), (502, " .,;\t\n", "fr"), (503, "One two three. " * 5000, "en"), (503, "One two three. " * 5000, "en"),
    (504, "no end " * 400, "xx"), (505, "w" * 100_000, "en"), (None, "a a a a a a a a a a a a a a a", "rep")]


def got(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in collocations(df, **more).collect())


@pytest.mark.parametrize("more", [{}, {"entries": 40, "burst": 4, "parts": 7}, {"entries": 300, "burst": 8, "parts": 30, "cut": 3}])
def test_whole_results(spark, more):
    assert got(spark, ROWS, **more) == brute(ROWS)


def test_report_is_cut_after_its_last_row(spark):
    assert got(spark, ROWS[:140], least=3, reported=5) == brute(ROWS[:140], 3, 5)


def test_counts_above_32_bits_stay_exact(spark):
    from pyspark.sql import functions as F
    from tidemark.llm import collocations as module

    big = 3 * 10 ** 10
    rows = [("en", None, None, None, 5 * big), ("en", "a", None, None, big + 1), ("en", "b", None, None, big + 7), ("en", "a", "b", None, big)]
    fake = spark.createDataFrame(rows, module.COUNTS)
    kept, module.count_phrases = module.count_phrases, lambda *a, **k: fake
    try:
        row, = collocations(fake.select(F.lit("x").alias("text"), "lang")).collect()
    finally:
        module.count_phrases = kept
    assert row.score == 10 ** 6 * big * big // ((big + 1) * (big + 7)) and row.n == 5 * big


def test_frequent_counts_only(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in ROWS[:60]], SCHEMA)
    rows = count_phrases(df, 4, parts=5).filter("w1 is not null and lang = 'en'").collect()
    f = count([t for _, t, lang in ROWS[:60] if lang == "en"])
    assert {tuple(w for w in r[1:4] if w is not None): r.f for r in rows} == {k: v for k, v in f.items() if v >= 4}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("abC .,\t\né"), max_size=60), max_size=8), st.integers(1, 6), st.integers(1, 9))
def test_tries_count_like_plain_loops(texts, burst, parts):
    trie, blocks = HatTrie(entries=12, burst=burst), []
    for t in texts:
        trie.add(np.frombuffer(t.encode(), np.uint8))
        while trie.full():
            blocks += _run("x", *trie.spill(), parts)
    blocks += _run("x", *trie.spill(everything=True), parts)
    f, words = Counter(), Counter()
    for part in range(parts):
        for kind, into in ((1, words), (2, f)):
            own = [b["block"] for b in blocks if b["part"] == part and b["kind"] == kind]
            if own:
                names, keys, counts = merge(own)
                names = [None, *names.to_pylist()]
                assert (np.diff(keys) > 0).all() and names[1:] == sorted(names[1:])
                for k, n in zip(keys.tolist(), counts.tolist()):
                    key = tuple(names[k >> s & (1 << 21) - 1] for s in (42, 21, 0))
                    assert key not in into
                    into[key] = n
    want = Counter()
    for t in texts:
        for ws in pieces(t):
            ws = [w.encode() for w in ws] + [None, None]
            want.update(zip(ws, ws[1:], ws[2:]))
    assert words == Counter({(k[0].encode(), None, None): n for k, n in count(texts).items() if len(k) == 1})
    assert f == Counter({k: n for k, n in want.items() if k[0] is not None and k[1] is not None})


def test_blocks_read_back():
    trie = HatTrie()
    trie.add(np.frombuffer(b"a b c. b c d. a b c", np.uint8))
    block, = [b for b in _run("en", *trie.spill(True), 1) if b["kind"] == 2]
    words, keys, counts = _read(block["block"])
    assert words.to_pylist() == [b"a", b"b", b"c", b"d"] and len(keys) == block["entries"] and counts.sum() == block["total"]


def test_long_text_is_cut_behind_pieces():
    raw = np.frombuffer(b"one two, three four five six seven eight. nine", np.uint8)
    parts = [bytes(p) for p in _stretches(raw, 10)]
    assert b"".join(parts) == bytes(raw) and parts == [b"one two,", b" three four five six seven eight.", b" nine"]


def test_no_rows(spark):
    assert got(spark, []) == []
