"""Helpers for records held as string maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def merge(loser: Column, winner: Column) -> Column:
    """Both maps in one; on a clash of keys the winner's value stays. A null map counts as empty."""
    empty = F.create_map().cast("map<string,string>")
    loser, winner = F.coalesce(loser, empty), F.coalesce(winner, empty)
    return F.map_concat(F.map_filter(loser, lambda k, _: ~F.map_contains_key(winner, k)), winner)


def keep_keys(m: Column, names: Column) -> Column:
    """The entries whose keys are listed in a comma-separated string."""
    return F.map_filter(m, lambda k, _: F.array_contains(F.split(names, r"\s*,\s*"), k))


def filled(m: Column) -> Column:
    return F.coalesce(F.size(m) > 0, F.lit(False))
