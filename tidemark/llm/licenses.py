"""License notices found by diagonal voting, in DataFrame functions only.

Every rolling k-gram of a text's words is hashed and joined to the grams of known notices. A hit at text word d and
notice word t votes for the diagonal d - t. Votes are summed by diagonal, diagonals a few words apart are merged (words
put in or left out), and each merged span is verified by edit distance against the notice's own words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.files import shared_folder, small, written

# Phrases whose every place counts, and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# Openings and short forms of public license notices.
NOTICES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction including without limitation the "
            "rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
               "the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
            "license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"   # the same words before A-Z are lower-cased
GRAM = 3
DRIFT = 3           # diagonals at most this far apart are one span
#: Spans to verify are broadcast to the texts up to this many rows of about 200 bytes; beyond it both sides are shuffled.
BROADCAST_ROWS = 200_000
LEAST_VOTES = 0.4   # share of a notice's grams that makes a candidate
LEAST_ALIKE = 0.85  # share of characters alike that verifies it
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_list(text: Column) -> Column:
    """Words of a text with A-Z lower-cased."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(f"({WORD})"), 1)


def grams(words: Column, k: int) -> Column:
    """Hashes of all runs of k words, in order; empty for shorter lists."""
    n = F.size(words)
    each = F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.xxhash64(*[words[i + j] for j in range(k)]))
    return F.when(n >= k, each).otherwise(F.array().cast("array<bigint>"))


def _templates(spark, rows: list[tuple[str, str]], k: int) -> DataFrame:
    """(template, label, body, n_words, pos, gram); a table of fixed size."""
    t = spark.createDataFrame([(i, label, body) for i, (label, body) in enumerate(rows)], "template int, label string, body string")
    t = t.withColumn("words", F.split("body", " ")).withColumn("n", F.size("words"))
    return t.select("template", "label", "body", "n", F.posexplode(grams(F.col("words"), k)).alias("pos", "gram"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``n_base`` counts the places of the phrases, ``first_word`` and ``last_word`` are their smallest and largest start.
    ``labels`` adds those of verified notices. ``score`` is 1 with a phrase, else the best likeness of a candidate span, else 0.
    A null text counts as empty; null ids are kept; a repeated row gives as many equal result rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    # Rows are told apart by id and text, since ids may repeat.
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("key"), word_list(F.col(text_col)).alias("words"))
    # Two-word grams serve the phrases, longer ones the notices; the tables to look up are of fixed size.
    wanted = []
    for kind, k, known in (("phrase", 2, [(label, body) for body, label in phrases]), ("notice", GRAM, notices)):
        t = _templates(spark, known, k).withColumn("kind", F.lit(kind))
        wanted.append(t)
    lookup = F.broadcast(wanted[0].unionByName(wanted[1]))
    both = F.concat(F.transform(grams(F.col("words"), 2), lambda h, i: F.struct(h.alias("gram"), i.alias("at"), F.lit("phrase").alias("kind"))),
                    F.transform(grams(F.col("words"), GRAM), lambda h, i: F.struct(h.alias("gram"), i.alias("at"), F.lit("notice").alias("kind"))))
    folder = shared_folder(spark, "licenses")
    hits = (rows.select("doc_id", "key", F.inline(both)).join(lookup, ["gram", "kind"])
            .select("doc_id", "key", "kind", "template", "label", "body", "n", "pos", "at"))
    diagonals = (written(hits, f"{folder}/hits").distinct().groupBy("doc_id", "key", "kind", "template", "label", "body", "n", (F.col("at") - F.col("pos")).alias("diagonal"))
                 .agg(F.count(F.lit(1)).alias("votes"), F.min("at").alias("lo"), F.max("at").alias("hi"),
                      F.collect_set("pos").alias("seen")))
    places = diagonals.filter("kind = 'phrase' and votes = n - 1").select(
        "doc_id", "key", F.lit("base").alias("kind"), "label", F.col("diagonal").alias("start"), F.lit(1.0).alias("alike"))

    # Neighbouring diagonals of one notice become one span; a document's diagonals are bounded by its length.
    order = Window.partitionBy("doc_id", "key", "template").orderBy("diagonal")
    notice = diagonals.filter("kind = 'notice'")
    spans = (notice.withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(order) > DRIFT).cast("int"))
             .withColumn("island", F.sum(F.coalesce("new", F.lit(0))).over(order))
             .groupBy("doc_id", "key", "template", "label", "body", "n", "island")
             .agg(F.min(F.col("lo") - F.array_min("seen")).alias("lo"),
                  F.max(F.col("hi") + F.col("n") - F.array_max("seen")).alias("hi"),
                  F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("votes"))
             .filter(F.col("votes") >= F.lit(LEAST_VOTES) * (F.col("n") - GRAM + 1)))
    spans = small(written(spans.withColumnsRenamed({"doc_id": "its_id", "key": "its_key"}), f"{folder}/spans"), BROADCAST_ROWS)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    cut = (texts.join(spans, F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("key") == F.col("its_key")))
           .withColumn("words", word_list(F.col("text"))).select("doc_id", "key", "template", "island", "label", "body", "lo",
                   F.array_join(F.slice("words", F.greatest(F.col("lo"), F.lit(0)) + 1, F.col("hi") - F.greatest(F.col("lo"), F.lit(0))), " ").alias("own"))
           .distinct())
    found = cut.select("doc_id", "key", F.lit("notice").alias("kind"), "label", F.col("lo").alias("start"),
                       (1 - F.levenshtein("own", "body") / F.greatest(F.length("own"), F.length("body"))).alias("alike"))
    # Notices that differ by a word share a start: the likest one names the place.
    found = (found.withColumn("best", F.max("alike").over(Window.partitionBy("doc_id", "key", "start")))
             .filter("alike = best").drop("best"))
    base = F.col("kind") == "base"
    known = F.when(base | (F.col("alike") >= LEAST_ALIKE), F.col("label"))
    summary = (places.unionByName(found).groupBy("doc_id", "key")
               .agg(F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"),
                    F.max(F.when(base, F.col("start"))).alias("last_word"),
                    F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
                    F.array_join(F.sort_array(F.collect_set(known)), ",").alias("labels"), F.max("alike").alias("score")))
    count = F.size(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(ANY_CASE), 0))
    total = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("key"), count.alias("n_words"))
    summary = summary.withColumnsRenamed({"doc_id": "its_id", "key": "its_key"})
    joined = total.join(summary, F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("key") == F.col("its_key")), "left")
    return joined.select(
        F.col("doc_id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
