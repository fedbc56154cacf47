"""Registered queries over the given tables, each beside the SQL that checks it."""

from catalog.base import QUERIES, oracles


def load():
    """Import every module of queries once and return (queries, oracle SQL)."""
    from catalog import (altdata, bars, events, features, hostile, indicators, sources, study,  # noqa: F401
                         streaming, trades, windows)
    return QUERIES, oracles()
