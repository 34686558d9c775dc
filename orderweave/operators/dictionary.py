"""Greedy search for terms of a vocabulary: longest first, without overlaps, in text order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_TERMS = 200_000


def find_terms(text: str | None, terms: list[str], boundary: bool = False) -> list[str]:
    """Terms found in ``text``; ``terms`` come longest first. A place that a longer term holds is taken."""
    if not text:
        return []
    low, taken, found = text.lower(), bytearray(len(text) + 1), []
    for term in terms:
        want = term.lower()
        at = low.find(want) if want else -1
        while at >= 0:
            end = at + len(term)
            alone = not boundary or not ((at and text[at - 1].isalnum()) or (end < len(text) and text[end].isalnum()))
            if alone and not any(taken[at:end]):
                taken[at:end] = b"\1" * (end - at)
                found.append((at, term))
            at = low.find(want, at + 1)
    return [term for _, term in sorted(found)]


def by_length(terms: DataFrame) -> list[str]:
    """The vocabulary as a list; it goes to all tasks, so its size is checked."""
    got = [r[0] for r in terms.limit(MOST_TERMS + 1).collect()]
    if len(got) > MOST_TERMS:
        raise ValueError(f"a vocabulary of more than {MOST_TERMS} terms")
    return sorted(got, key=lambda t: (-len(t), t.lower(), t))


def match_terms(text: Column, terms: DataFrame, boundary: bool = False) -> Column:
    shared = terms.sparkSession.sparkContext.broadcast(by_length(terms))

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: find_terms(t, shared.value, boundary))

    return run(text)
