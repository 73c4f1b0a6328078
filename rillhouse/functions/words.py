"""Splitting a phrase into its distinct words."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from rillhouse.session import ship


def words(text: str | Column) -> Column:
    """Distinct lower-case runs of letters and digits; null or blank text has none."""
    c = F.lower(F.col(text) if isinstance(text, str) else text)
    found = F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.coalesce(found, F.array().cast("array<string>")))


def longest_words(text: str, dictionary: set[str], longest: int) -> list[str]:
    """Words by maximum matching: at each place the longest entry, else one character."""
    out, at = [], 0
    while at < len(text):
        n = next((n for n in range(min(longest, len(text) - at), 1, -1) if text[at : at + n] in dictionary), 1)
        if text[at : at + n].isalnum():
            out.append(text[at : at + n])
        at += n
    return list(dict.fromkeys(out))


def dictionary_words(text: str | Column, dictionary: set[str]) -> Column:
    """For text without spaces between words: maximum matching over a word list that the caller
    passes, on Arrow batches."""
    longest = max(map(len, dictionary), default=1)
    if (spark := SparkSession.getActiveSession()) is not None:
        ship(spark)

    @F.pandas_udf("array<string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([longest_words(t or "", dictionary, longest) for t in part])

    return run(text)
