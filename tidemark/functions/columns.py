"""Scalar expressions used across operators. All stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Whitespace as a Unicode-aware tokeniser sees it (fixed value).
WHITESPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a, b) -> Column:
    """``a / b`` that yields NULL instead of an ANSI divide-by-zero error."""
    return F.try_divide(col(a), col(b))


def clip(x, lo: float, hi: float) -> Column:
    # greatest() and least() skip NULLs, which must stay NULL here.
    v = col(x)
    return F.when(v.isNotNull(), F.greatest(F.least(v, F.lit(hi)), F.lit(lo)))


def micros(ts) -> Column:
    """Microseconds since the epoch of a date or a timestamp of either kind."""
    return F.unix_micros(col(ts).cast("timestamp"))


def no_nan(x) -> Column:
    """NULL is the only missing value; NaN becomes NULL on the way in."""
    return F.nanvl(col(x).cast("double"), F.lit(None).cast("double"))


def lenient_date(x) -> Column:
    """First ten characters as an ISO date; anything unparseable is NULL."""
    return F.try_to_date(F.substring(col(x).cast("string"), 1, 10), "yyyy-MM-dd")


def fiscal_month_end(fiscal_year, fiscal_month) -> Column:
    """Calendar month end of a fiscal month; the fiscal year opens in October."""
    fy, fm = col(fiscal_year).cast("int"), col(fiscal_month).cast("int")
    opened_last_year = (fm <= 3).cast("int")
    return F.last_day(F.make_date(fy - opened_last_year, (fm + 8) % 12 + 1, F.lit(1)))


def words(text) -> Column:
    """Lower-cased whitespace tokens, without empty ones."""
    return F.filter(F.split(F.lower(col(text)), WHITESPACE), lambda w: w != "")


def token_set(text) -> Column:
    return F.array_distinct(words(text))


def set_union(a, b) -> Column:
    return F.array_union(col(a), col(b))


def set_minus(a, b) -> Column:
    return F.array_except(col(a), col(b))


def signal_label(score) -> Column:
    s = col(score)
    return (
        F.when(s > 1.5, "STRONG_BULLISH")
        .when(s > 0.5, "BULLISH")
        .when(s > -0.5, "NEUTRAL")
        .when(s > -1.5, "BEARISH")
        .otherwise("STRONG_BEARISH")
    )


def value_cell(x, per_octave: int = 4096) -> Column:
    """A whole number that never decreases with ``x``.

    Logarithmic buckets, ``per_octave`` to each doubling and mirrored for
    negatives. Ranking jobs shuffle on it, which spreads one group over many
    tasks: values that differ by a few hundredths of a percent already fall into
    different cells, and data spanning twenty doublings has 160 000 of them.
    """
    v = col(x).cast("double")
    size = F.least(F.abs(v), F.lit(1.7976931348623157e308))  # infinity joins the largest cell
    depth = F.floor(F.log2(size) * per_octave) + F.lit(1080 * per_octave)
    return (
        F.when(v.isNull(), F.lit(None))
        .when(v > 0, depth)
        .when(v < 0, -depth)
        .otherwise(F.lit(0))
        .cast("long")
    )
