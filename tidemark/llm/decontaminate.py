"""Benchmark passages in documents, also with changed numbers, names and units; DataFrame functions only.

Texts become templates: numbers, units and names turn into typed placeholders, other words are lower-cased. Windows of
template words are hashed and joined to the benchmark's windows. A document holds an item when windows on near diagonals
cover enough of it and its slots are filled consistently: one value of the item stands for one value in the document.

A capital makes a name or not by what stands before it, so a copy may have another template than its item: behind a colon,
a quotation mark or a line break, or in lower case. Beside its template windows each text therefore has the windows of its
plain lower-cased words, in the same space of hashes, and a place counts as covered when either hits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.files import shared_folder, small, written

NUMBER, UNIT, NAME = "<number>", "<unit>", "<name>"
# Words taken as units of measure or money.
UNITS = ["kg", "g", "mg", "lb", "lbs", "km", "m", "cm", "mm", "mi", "mile", "miles", "ft", "feet", "inch", "inches", "meter",
         "meters", "metre", "metres", "l", "ml", "liter", "liters", "litre", "litres", "s", "sec", "second", "seconds", "min",
         "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "mph",
         "kmh", "usd", "eur", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent"]
WINDOW = 8
LEAST_WORDS = 3      # shorter items match nothing
LEAST_COVER = 0.5    # share of an item's windows on one run of diagonals
LEAST_EVEN = 0.8     # share of its slots that are filled consistently
DRIFT = 3
#: Benchmark windows are broadcast up to this many rows of about 40 bytes; beyond it both sides are shuffled.
BROADCAST_ROWS = 500_000

# A number, or a run of letters, digits and non-ASCII characters but quotation marks and other signs. A sentence end before it stays part of the token, so
# that a capital there does not make a name.
_LETTER = r"[a-zA-Z0-9[^\x00-\x7F\u00A1\u00AB\u00BB\u00BF\u2010-\u205E\u3000-\u303F]]"  # the frequent ones first
_CLOSING = r"[\x22\x27\x29\x5D\u00BB\u2019\u201D]*"
TOKEN = rf"(?:[.!?]{_CLOSING}\s+)?(?:[0-9]+(?:[.,][0-9]+)*(?!{_LETTER})|{_LETTER}+)"


def tokens(text: Column) -> Column:
    """Tokens of a text; its first one counts as the start of a sentence."""
    return F.regexp_extract_all(F.concat(F.lit(". "), F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), 1)


def value(token: Column) -> Column:
    """The bare text of a token."""
    return F.when(F.substring(token, 1, 1).isin(".", "!", "?"), F.regexp_replace(token, rf"^[.!?]{_CLOSING}\s+", "")).otherwise(token)


def template(token: Column, plain: Column) -> Column:
    """The template word of a token; ``plain`` is its lower-cased value."""
    first, second = F.substring(token, 1, 1), F.substring(token, 2, 1)
    name = ~first.isin(".", "!", "?") & (F.lower(first) != first) & (F.upper(second) != second)
    return F.when(name, NAME).when(F.substring(plain, 1, 1).between("0", "9"), NUMBER).when(plain.isin(UNITS), UNIT).otherwise(plain)


def with_words(rows: DataFrame) -> DataFrame:
    """``rows`` with ``plain`` and ``words``: the lower-cased values and the template words of ``tokens``."""
    return (rows.withColumn("plain", F.transform("tokens", lambda t: F.lower(value(t))))
            .withColumn("words", F.zip_with("tokens", "plain", template)))


def windows(words: Column, k: int) -> Column:
    """Hash of every run of ``k`` hashes."""
    n = F.size(words)
    each = F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.xxhash64(*[words[i + j] for j in range(k)]))
    return F.when(n >= k, each).otherwise(F.array().cast("array<bigint>"))


def _hashes(rows: DataFrame) -> DataFrame:
    """``rows`` with hashes of template words and of plain words in one space: where no word is a placeholder they agree."""
    return rows.withColumn("t", F.transform("words", lambda w: F.xxhash64(w))).withColumn("p", F.transform("plain", lambda w: F.xxhash64(w)))


def _slots(rows: DataFrame, keep: list[str]) -> DataFrame:
    """(.., at, value) of the placeholders of each row's tokens."""
    spread = rows.select(*keep, F.posexplode("tokens").alias("at", "token")).withColumn("plain", F.lower(value(F.col("token"))))
    return spread.filter(template(F.col("token"), F.col("plain")).isin(NUMBER, UNIT, NAME)).select(*keep, "at", F.col("plain").alias("value"))


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      item_col: str = "item_id", item_text: str = "text", least_cover: float = LEAST_COVER,
                      least_even: float = LEAST_EVEN, window: int = WINDOW) -> DataFrame:
    """(doc_id, key, item_id, cover, slots, changed, even) of every document and item above the thresholds.

    ``key`` hashes the text, since ids may repeat. Items shorter than a window are matched as a whole if they have at
    least three words; items without that many match nothing. Windows that are placeholders by more than half match
    word by word only. Values are compared in lower case. Null texts count as empty; rows with a null id are kept.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), tokens(F.col(item_text)).alias("tokens"))
    items = with_words(items.filter(F.size("tokens") >= LEAST_WORDS)).withColumn("k", F.least(F.size("words"), F.lit(window)))
    # Ids may repeat in the benchmark too: an item is an id and its words.
    items = items.withColumn("item_key", F.xxhash64("item_id", "plain", "words")).dropDuplicates(["item_key"])
    sizes = [r.k for r in items.select("k").distinct().collect()]  # at most `window` values
    places = None
    for k in sizes:
        each = _hashes(items.filter(F.col("k") == k)).select(
            "item_id", "item_key", F.size("words").alias("n"), "words",
            F.posexplode(F.arrays_zip(windows(F.col("t"), k).alias("t"), windows(F.col("p"), k).alias("p"))).alias("pos", "g"))
        # A window of placeholders by more than half says nothing by itself; its plain words do.
        held = F.size(F.filter(F.slice("words", F.col("pos") + 1, k), lambda w: w.startswith("<")))
        light = held * 2 <= k
        same = F.col("g.t") == F.col("g.p")
        rows = F.array_compact(F.array(
            F.when(light, F.struct(F.col("g.t").alias("gram"), same.alias("verbatim"))),
            F.when(~light | ~same, F.struct(F.col("g.p").alias("gram"), F.lit(True).alias("verbatim")))))
        own = each.select("item_id", "item_key", F.lit(k).alias("k"), "n", "pos", light.alias("light"), F.inline(rows))
        places = own if places is None else places.unionByName(own)
    if places is None:
        places = items.select("item_id", "item_key", "k", F.lit(0).alias("n"), F.lit(0).alias("pos"), F.lit(True).alias("light"), F.lit(0).cast("long").alias("gram"),
                              F.lit(True).alias("verbatim")).limit(0)
    known = places.groupBy("item_key").agg(F.count_distinct(F.when(F.col("light"), F.col("pos"))).alias("n_light"))
    places = places.join(known, "item_key")
    folder = shared_folder(docs.sparkSession, "decontaminate")
    places = small(written(places, f"{folder}/places"), BROADCAST_ROWS)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    held = _hashes(with_words(rows.select("doc_id", "key", tokens(F.col("text")).alias("tokens")))).select("doc_id", "key", "t", "p")
    # A row per window of each size, hashed behind the explode: there Spark compiles it, inside a lambda it does not. Hashes of windows
    # of different sizes differ, so they tell the size too.
    spread = held.withColumn("size", F.explode(F.array(*[F.lit(k) for k in sizes]).cast("array<int>"))).filter(F.size("t") >= F.col("size"))
    spread = spread.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("t") - F.col("size"))))

    def gram(words: str) -> Column:
        each = [(k, F.xxhash64(*[F.get(words, F.col("at") + j) for j in range(k)])) for k in sizes]
        return reduce(lambda rest, e: F.when(F.col("size") == e[0], e[1]).otherwise(rest), each, F.lit(None).cast("long"))

    spread = spread.select("doc_id", "key", "at", gram("t").alias("tg"), gram("p").alias("pg"))
    both = F.when(F.col("tg") == F.col("pg"), F.array("tg")).otherwise(F.array("tg", "pg"))
    hits = (spread.select("doc_id", "key", "at", F.explode(both).alias("gram")).join(places, "gram")
            .groupBy("doc_id", "key", "item_id", "item_key", "n", "k", "n_light", (F.col("at") - F.col("pos")).alias("diagonal"))
            .agg(F.collect_set("pos").alias("seen"), F.collect_set(F.when(F.col("light"), F.col("pos"))).alias("lit"),
                 F.collect_set(F.when(F.col("verbatim"), F.col("pos"))).alias("same")))
    # Diagonals a few words apart belong to one passage with words put in or left out.
    order = Window.partitionBy("doc_id", "key", "item_key").orderBy("diagonal")
    runs = (hits.withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > DRIFT).cast("int"), F.lit(0)))
            .withColumn("island", F.sum("new").over(order)))
    island = Window.partitionBy("doc_id", "key", "item_key", "island")
    number = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c).over(island))))
    # The share of the windows that say something by themselves, or of all windows word by word.
    cover = F.greatest(F.coalesce(F.try_divide(number("lit"), F.col("n_light")), F.lit(0.0)), number("same") / (F.col("n") - F.col("k") + 1))
    runs = runs.withColumn("cover", cover).filter(F.col("cover") >= least_cover).drop("lit", "same")
    runs = written(runs, f"{folder}/runs")

    # Slots are compared only in the passages found: item slot at p against the document's word at p + diagonal.
    found = (runs.select("doc_id", "key", "item_id", "item_key", "island", "cover", "diagonal", "k", F.explode("seen").alias("pos"))
             .withColumn("p", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("k") - 1)))
             .groupBy("doc_id", "key", "item_id", "item_key", "island", "cover", "p").agg(F.min("diagonal").alias("diagonal")))
    wanted = _slots(items, ["item_key"]).withColumnsRenamed({"at": "p", "value": "asked"})
    asked = found.join(wanted, ["item_key", "p"]).withColumn("at", F.col("p") + F.col("diagonal"))
    held = runs.select(F.col("doc_id").alias("its_id"), F.col("key").alias("its_key")).distinct()
    texts = (rows.join(small(held, BROADCAST_ROWS), F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("key") == F.col("its_key")), "left_semi")
             .dropDuplicates(["doc_id", "key"]).withColumn("tokens", tokens(F.col("text"))))
    own = _slots(texts, ["doc_id", "key"]).withColumnsRenamed({"doc_id": "its_id", "key": "its_key", "at": "its_at"})
    pairs = asked.join(own, F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("key") == F.col("its_key")) & (F.col("at") == F.col("its_at")))
    passage = ["doc_id", "key", "item_id", "item_key", "island"]
    each = (pairs.groupBy(*passage, "asked").agg(F.count_distinct("value").alias("kinds"), F.count(F.lit(1)).alias("times"),
                                                F.count(F.when(F.col("value") != F.col("asked"), 1)).alias("changed")))
    filled = each.groupBy(*passage).agg(F.sum("times").alias("slots"), F.sum("changed").alias("changed"),
                                        (F.sum(F.when(F.col("kinds") == 1, F.col("times")).otherwise(0)) / F.sum("times")).alias("even"))
    filled = filled.withColumnsRenamed({c: f"its_{c}" for c in passage})
    passages = runs.groupBy(*passage).agg(F.first("cover").alias("cover"))
    matched = passages.join(filled, F.col("doc_id").eqNullSafe(F.col("its_doc_id")) & (F.col("key") == F.col("its_key"))
                            & (F.col("item_key") == F.col("its_item_key")) & (F.col("island") == F.col("its_island")), "left")
    even = F.coalesce("even", F.lit(1.0))
    return written(
        matched.filter(even >= least_even).groupBy("doc_id", "key", "item_id")
        .agg(F.max("cover").alias("cover"), F.max(F.coalesce("slots", F.lit(0))).alias("slots"),
             F.max(F.coalesce("changed", F.lit(0))).alias("changed"), F.max(even).alias("even")), f"{folder}/matches")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Every row of ``docs`` with ``contaminated``, ``item_ids`` (sorted), ``cover``, ``slots`` and ``changed`` of its best item.

    An existing column of such a name is replaced. Rows that repeat get equal results.
    """
    found = (benchmark_matches(docs, benchmark, id_col, text_col, **options).groupBy("doc_id", "key")
             .agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("cover").alias("cover"),
                  F.max_by("slots", "cover").alias("slots"), F.max_by("changed", "cover").alias("changed"))
             .select(F.col("doc_id").alias("_its_id"), F.col("key").alias("_its_key"),
                     F.struct("item_ids", "cover", "slots", "changed").alias("_found")))
    joined = docs.join(small(found, BROADCAST_ROWS), F.col(id_col).eqNullSafe(F.col("_its_id")) & (F.xxhash64(text_col) == F.col("_its_key")), "left")
    new = {"contaminated": F.col("_its_key").isNotNull(),
           "item_ids": F.coalesce("_found.item_ids", F.array().cast(found.schema["_found"].dataType["item_ids"].dataType)),
           "cover": F.coalesce("_found.cover", F.lit(0.0)), "slots": F.coalesce("_found.slots", F.lit(0)).cast("long"),
           "changed": F.coalesce("_found.changed", F.lit(0)).cast("long")}
    return joined.withColumns(new).drop("_its_id", "_its_key", "_found")
