"""Benchmark passages: verbatim, with other numbers, names and units, and look-alikes that are none."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm.decontaminate import (DRIFT, LEAST_COVER, LEAST_EVEN, LEAST_WORDS, NAME, NUMBER, TOKEN, UNIT, UNITS, WINDOW, decontaminate, tokens,
                                        with_words)

ITEM = "A train leaves Oldtown at 40 km per hour and reaches Newtown after 3 hours. How far is Oldtown from Newtown if the train stops for 20 minutes on the way?"
OTHER = "Maria buys 12 apples for 5 dollars each and sells them again. How many dollars does Maria make when she asks 7 dollars for every apple sold?"


def test_templates(spark):
    row = spark.createDataFrame([("Mr Smith paid 1,250.50 dollars. The shop kept 3kg of USB cables",)], "t string")
    got = with_words(row.select(tokens(F.col("t")).alias("tokens"))).first().words
    assert got == ["mr", "<name>", "paid", "<number>", "<unit>", "the", "shop", "kept", "<number>", "of", "usb", "cables"]


def run(spark, docs, items):
    docs = spark.createDataFrame(docs, "doc_id long, text string, cover string")
    items = spark.createDataFrame(items, "item_id long, text string, key string")
    return {(r.doc_id, r.text): r for r in decontaminate(docs, items).collect()}, docs


def test_finds_changed_questions_and_spares_others(spark):
    changed = (ITEM.replace("Oldtown", "Rome").replace("Newtown", "Paris").replace("40 km", "65 miles").replace("20", "45"))
    uneven = changed.replace("far is Rome", "far is Berlin").replace("from Paris", "from Madrid").replace("at 65 miles", "at 65 km")
    docs = [(1, "Before it. " + ITEM + " After it.", "x"), (2, "Some words first, " + changed, "x"), (3, uneven, "x"),
            (4, "A train leaves Oldtown at noon and nobody knows how far it goes.", "x"), (5, None, "x"), (6, "", "x"),
            (7, OTHER.lower(), "x"), (8, ITEM + " " + OTHER, "x"), (None, ITEM, "x"), (1, "unrelated text under the same id", "x"), (9, ITEM, "x"), (9, ITEM, "x"),
            (10, "filler words " * 20_000 + ITEM, "x"), (11, ITEM.replace("reaches", "arrives in").replace("on the way", "en route"), "x")]
    items = [(100, ITEM, "x"), (200, OTHER, "x"), (300, None, "x"), (400, "too short", "x"), (None, "", "x"), (500, "exactly five words stand here", "x")]
    got, df = run(spark, docs + [(12, "and so exactly five words stand here, as said", "x")], items)
    found = {k[0] if k[0] != 1 else k: (r.contaminated, r.item_ids) for k, r in got.items()}
    assert found[1, docs[0][1]] == (True, [100]) and found[1, docs[9][1]] == (False, [])
    assert found[2] == (True, [100]) and got[2, docs[1][1]].changed > 0 and got[1, docs[0][1]].changed == 0
    assert found[3] == (False, []) and found[4] == (False, []) and found[5] == (False, []) and found[6] == (False, [])
    assert found[8] == (True, [100, 200]) and found[None] == (True, [100]) and found[9] == (True, [100]) and found[10] == (True, [100])
    assert found[11] == (True, [100]) and found[12] == (True, [500])
    assert decontaminate(df, spark.createDataFrame(items[:1], "item_id long, text string, key string")).count() == df.count()


def test_empty_tables(spark):
    none, some = [], [(1, ITEM, "x")]
    assert run(spark, none, some)[0] == {}
    got, _ = run(spark, some, none)
    assert [r.contaminated for r in got.values()] == [False]


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    plan = decontaminate(docs, docs.withColumnRenamed("doc_id", "item_id"))._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


CAPITAL, SUM = "What is the capital of France?", "12 + 34 + 56 = 102"
NAMED = "Did Anna, Bert, Carla and Dora meet Emil, Frida and Gustav in Hamburg, Oslo or Rome before Monday?"


@pytest.mark.parametrize("item,copy", [
    (CAPITAL, "Question: What is the capital of France?"), (CAPITAL, "Quiz\nWhat is the capital of France?"), (CAPITAL, "He asked, \u201cWhat is the capital of France?\u201d"),
    (CAPITAL, CAPITAL.lower()), (CAPITAL, 'ask "What is the capital of France?" again'), (SUM, "we know that 12 + 34 + 56 = 102 holds"), (SUM, SUM),
    (NAMED, NAMED), (NAMED, "Then: " + NAMED.lower()), (CAPITAL, "So. What is the capital of France?"), (CAPITAL, CAPITAL.upper())])
def test_exact_copies_are_found_whatever_stands_before_them(spark, item, copy):
    got, _ = run(spark, [(1, copy, "x"), (2, "What is the price of bread?", "x"), (3, "12 + 35 + 56 = 103", "x")], [(9, item, "x")])
    assert {k[0]: r.contaminated for k, r in got.items()} == {1: True, 2: False, 3: False}


def forms(text):
    """(template words, plain words) by plain loops."""
    out, plain = [], []
    for t in re.findall(TOKEN, ". " + (text or "")):
        opens = t[0] in ".!?"
        bare = re.sub(r"^[.!?][\x22\x27\x29\x5D\u00BB\u2019\u201D]*\s+", "", t) if opens else t
        p = bare.lower()
        plain.append(p)
        if not opens and t[0].lower() != t[0] and t[1:2].upper() != t[1:2]:
            out.append(NAME)
        elif "0" <= p[:1] <= "9":
            out.append(NUMBER)
        else:
            out.append(UNIT if p in UNITS else p)
    return out, plain


def brute(text, item):
    """Whether the document holds the item, straight from the definition."""
    (dt, dp), (it, ip) = forms(text), forms(item)
    n = len(it)
    if n < LEAST_WORDS:
        return False
    k = min(n, WINDOW)
    light = {i for i in range(n - k + 1) if 2 * sum(w.startswith("<") for w in it[i:i + k]) <= k}
    hits = defaultdict(lambda: (set(), set()))
    for at in range(len(dt) - k + 1):
        own = {tuple(dt[at:at + k]), tuple(dp[at:at + k])}
        for i in range(n - k + 1):
            if i in light and tuple(it[i:i + k]) in own or tuple(ip[i:i + k]) in own:
                hits[at - i][0].add(i)
            if tuple(ip[i:i + k]) in own:
                hits[at - i][1].add(i)
    islands, last = [], None
    for d in sorted(hits):
        if last is None or d - last > DRIFT:
            islands.append({})
        islands[-1][d] = last = d
    for island in islands:
        seen, same = (set().union(*(hits[d][x] for d in island)) for x in (0, 1))
        if max(len(seen & light) / len(light) if light else 0, len(same) / (n - k + 1)) < LEAST_COVER:
            continue
        filled = defaultdict(list)
        place = {}
        for d in island:
            for i in hits[d][0]:
                for p in range(i, i + k):
                    place[p] = min(place.get(p, d), d)
        for p, d in place.items():
            if it[p].startswith("<") and 0 <= p + d < len(dt) and dt[p + d].startswith("<"):
                filled[ip[p]].append(dp[p + d])
        times = sum(map(len, filled.values()))
        if not times or sum(len(v) for v in filled.values() if len(set(v)) == 1) / times >= LEAST_EVEN:
            return True
    return False


def test_whole_results_by_brute_force(spark):
    rng = random.Random(11)
    words = ["the", "train", "leaves", "Rome", "Paris", "at", "40", "7", "km", "hours", "and", "how", "far", "is", "it", "from", "What", "Anna"]
    sentence = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", " ", ". ", ": ", "\n", ", "]) for _ in range(n)).strip()
    items = [(i, sentence(rng.choice([2, 3, 5, 8, 9, 14, 30])), "x") for i in range(25)]

    def altered(text):
        out = [rng.choice(words) if rng.random() < rate else w for rate in [rng.choice([0, 0.05, 0.15, 0.3])] for w in text.split(" ")]
        text = " ".join(out)
        return rng.choice([text, text.lower(), text.replace("Rome", "Oslo").replace("40", "9"), "Question: " + text])

    docs = [(i, sentence(rng.randrange(12)) + rng.choice([" ", ": ", ". "]) + altered(rng.choice(items)[1]) + " " + sentence(rng.randrange(12)), "x") for i in range(160)]
    got, _ = run(spark, docs, items)
    wrong = []
    for (i, text), r in got.items():
        want = sorted(j for j, item, _ in items if brute(text, item))
        if r.item_ids != want:
            wrong.append((i, text, r.item_ids, want))
    assert not wrong, wrong[:2]
    assert 20 < sum(r.contaminated for r in got.values()) < 155


def test_windows_are_hashed_in_compiled_code(spark):
    # Lambdas over the words of a text are interpreted; the windows of a document, a hash of eight words each, must not be made there.
    from tidemark.llm import decontaminate as D
    seen = []
    whole = D.windows
    D.windows = lambda words, k: seen.append(k) or whole(words, k)
    try:
        docs = spark.createDataFrame([(1, "One two three four five six seven eight nine ten."), (2, "A red fox.")], "doc_id long, text string")
        items = spark.createDataFrame([(7, "two three four five six seven eight nine"), (8, "a red fox")], "item_id long, text string")
        got = {(r.doc_id, r.item_id) for r in D.benchmark_matches(docs, items).collect()}
    finally:
        D.windows = whole
    assert got == {(1, 7), (2, 8)}
    assert sorted(seen) == [3, 3, 8, 8]  # those of the items: template and plain
