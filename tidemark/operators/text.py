"""Scores over filings, transcripts and job texts. Whole texts, JVM-side."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.columns import set_minus, token_set, words
from tidemark.functions.vocabularies import EVASIVE_PATTERNS, RISK_SEVERITY, SKILL_PATTERNS
from tidemark.operators.ordered import with_neighbours


def _token_weight(lexicon: dict[str, int]):
    def weight(token: Column) -> Column:
        expr = None
        for word, value in lexicon.items():
            hit = F.contains(token, F.lit(word))
            expr = F.when(hit, F.lit(value)) if expr is None else expr.when(hit, F.lit(value))
        return expr
    return weight


def score_diff(pairs: DataFrame, current: str, prior: str, lexicon: dict[str, int] = RISK_SEVERITY,
               known: str | None = None) -> DataFrame:
    """Score columns for two token-set columns; zeros without prior tokens.

    The set differences are computed once, in their own projection. Tokens may be hashes; ``known`` then names an array of (hash,
    weight) of the current tokens that have a weight.
    """
    staged = pairs.withColumn("_added", set_minus(current, prior)).withColumn("_removed", set_minus(prior, current))
    if known is None:
        weights = F.filter(F.transform("_added", _token_weight(lexicon)), lambda w: w.isNotNull())
    else:
        weights = F.transform(F.filter(known, lambda t: F.array_contains("_added", t["hash"])), lambda t: t["weight"])
    staged = staged.withColumn("_weights", weights)
    plus, minus = F.size("_added"), F.size("_removed")
    total = F.greatest(F.size(current) + minus, F.lit(1))  # size of the union
    has_prior = F.coalesce(F.size(prior) > 0, F.lit(False))

    def pct(count: Column) -> Column:
        return F.when(has_prior, F.round(count / total * 100, 2)).otherwise(0.0)

    return staged.select(
        *[c for c in pairs.columns if c not in (current, prior, known)],
        pct(plus + minus).alias("pct_changed"), pct(plus).alias("pct_added"), pct(minus).alias("pct_removed"),
        F.when(has_prior, F.aggregate("_weights", F.lit(0), lambda a, w: a + w)).otherwise(0).alias("severity_score"),
        F.when(has_prior, F.size("_weights")).otherwise(0).alias("new_risk_count"))


def filing_diff(filings: DataFrame, lexicon: dict[str, int] = RISK_SEVERITY, by: str = "symbol",
                order: Sequence[str] = ("filed", "seq"), text: str = "text") -> DataFrame:
    """Each filing scored against the previous one of the same company.

    Filings are cut into cells by their first order column and then into blocks
    with one copied row, so a company with very many filings spreads out. Words
    stay where they are read: what is dealt and compared are their 64-bit hashes, and
    the weights of the few that the lexicon knows. Equal hashes count as equal words.
    """
    def add(df: DataFrame, w) -> DataFrame:
        return df.withColumn("_before", F.lag("_now", 1).over(w))

    weight = _token_weight(lexicon)
    tokens = filings.select(by, *order, token_set(text).alias("_tokens")).select(
        by, *order, F.transform("_tokens", lambda t: F.xxhash64(t)).alias("_now"),
        F.filter(F.transform("_tokens", lambda t: F.struct(F.xxhash64(t).alias("hash"), weight(t).alias("weight"))), lambda t: t["weight"].isNotNull()).alias("_known"))
    paired = with_neighbours(tokens, [by], list(order), 1, 0, add, F.col(order[0]))
    return score_diff(paired, "_now", "_before", known="_known")


def _unicode(pattern: str) -> str:
    """Word and space classes cover all scripts, whatever the Java version."""
    return "(?U)" + pattern if "\\" in pattern else pattern


def evasiveness(df: DataFrame, text: str = "text", patterns: Sequence[str] = EVASIVE_PATTERNS) -> DataFrame:
    """Evasive phrases of each text: count, rate per 10 000 words (at most 100), first five."""
    staged = df.withColumn("_low", F.lower(text)).withColumn(
        "_found", F.flatten(F.array(*[F.regexp_extract_all("_low", F.lit(_unicode(p)), 0) for p in patterns])))
    rate = F.least(F.col("evasive_phrase_count") / F.greatest(F.size(words("_low")), F.lit(1)) * 10000, F.lit(100.0))
    return (
        staged.withColumn("evasive_phrase_count", F.size("_found"))
        .withColumn("evasiveness_score", F.round(rate, 2))
        .withColumn("sample_matches", F.slice("_found", 1, 5))
        .drop("_low", "_found")
    )


def evasiveness_by(df: DataFrame, by: str, order: str, text: str = "text",
                   patterns: Sequence[str] = EVASIVE_PATTERNS, samples: bool = True) -> DataFrame:
    """The same score for a transcript stored as one row per turn.

    Turns are scored where they lie and only counts are summed, so a transcript
    of any length is never assembled. A phrase does not span two speakers. Without
    ``samples`` texts are read once and ``sample_matches`` is left out.
    """
    def first_five(k: int) -> Column:
        return F.transform(F.slice(F.col("_all")[k], 1, 5),
                           lambda m, i: F.struct(F.lit(k).alias("k"), i.alias("i"), m.alias("m")))

    staged = df.select(by, order, F.lower(text).alias("_low")).withColumn(
        "_all", F.array(*[F.regexp_extract_all("_low", F.lit(_unicode(p)), 0) for p in patterns]))
    hits = F.flatten(F.array(*[first_five(k) for k in range(len(patterns))]))
    scored = staged.select(by, order, F.size(F.flatten("_all")).alias("_c"), F.size(words("_low")).alias("_w"),
                           hits.alias("_h"))
    totals = scored.groupBy(by).agg(F.sum("_c").alias("evasive_phrase_count"), F.sum("_w").alias("_w"))
    rate = F.round(F.least(F.col("evasive_phrase_count") / F.greatest("_w", F.lit(1)) * 10000, F.lit(100.0)), 2).alias("evasiveness_score")
    if not samples:
        return totals.select(by, "evasive_phrase_count", rate)
    first = Window.partitionBy(by).orderBy("k", order, "i")
    firsts = (
        scored.select(by, order, F.inline("_h")).withColumn("_rn", F.row_number().over(first)).filter("_rn <= 5")
        .groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_rn", "m"))).alias("_s"))
    )
    return totals.join(firsts, by, "left").select(
        by, "evasive_phrase_count", rate,
        F.coalesce(F.transform("_s", lambda s: s["m"]), F.array().cast("array<string>")).alias("sample_matches"))


_META = re.compile(r"[\\^$.|?*+()\[\]{}]")
_ESCAPE = re.compile(r"\\.")
_ESCAPED_SIGN = re.compile(r"\\([^A-Za-z0-9])")


def _core(pattern: str) -> str | None:
    """The literal every match of the pattern contains, if it is that simple."""
    inner = pattern.removeprefix(r"\b").removesuffix(r"\b").removesuffix(r"\w*")
    if _META.search(_ESCAPED_SIGN.sub("", inner)):
        return None
    return _ESCAPED_SIGN.sub(r"\1", inner)


def _folded(text: Column) -> Column:
    """Lower case in which every letter that matches an ASCII one regardless of case is that one."""
    return F.translate(F.lower(text), "\u017f\u0131\u0307", "si")


def _matches(text: Column, folded: Column, pattern: str, ignore_case: bool) -> Column | None:
    """Whether a pattern occurs in a text; None when it never can.

    A byte search for the literal inside the pattern decides most texts; the
    regular expression runs only where that literal occurs.
    """
    core = _core(pattern)
    if ignore_case:
        exact = F.rlike(text, F.lit("(?iU)" + pattern))
        return exact if core is None else F.contains(folded, F.lit(core.lower())) & exact
    if any(ch.isupper() for ch in _ESCAPE.sub("", pattern)):
        return None  # the text is lower-cased
    exact = F.rlike(text, F.lit(_unicode(pattern)))
    if core is None:
        return exact
    found = F.contains(text, F.lit(core))
    return found & exact if r"\b" in pattern else found


def skill_tags(jobs: DataFrame, patterns: dict[str, Sequence[str]] = SKILL_PATTERNS, ignore_case: bool = False,
               text: str = "description") -> DataFrame:
    """Per text and category, the number of its patterns that occur in the text.

    By default the text is lower-cased and patterns are taken literally, so those
    with capitals never match; ``ignore_case`` lets them.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rest = [c for c in jobs.columns if c != text]
    staged = jobs.select(*rest, (body if ignore_case else F.lower(body)).alias("_body"),
                         *([_folded(body).alias("_fold")] if ignore_case else []))
    counts = []
    for group in patterns.values():
        tests = [m for m in (_matches(F.col("_body"), F.col("_fold"), p, ignore_case) for p in group) if m is not None]
        counts.append(sum((t.cast("int") for t in tests), F.lit(0)))
    counted = staged.select(*rest, *[c.alias(f"_c{i}") for i, c in enumerate(counts)])
    pairs = F.array(*[F.struct(F.lit(c).alias("skill_category"), F.col(f"_c{i}").alias("count"))
                      for i, c in enumerate(patterns)])
    return counted.select(*rest, F.inline(pairs))
