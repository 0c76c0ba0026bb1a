"""Fuzzy agreement of two label lists."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

WORD = re.compile(r"[^\W_]+")


def indel_ratio(a: str, b: str) -> int:
    """100 times (len_sum - insertions and deletions) / len_sum, rounded; 100 for two empty texts."""
    if not a and not b:
        return 100
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return round(200 * row[-1] / (len(a) + len(b)))


def token_sort_ratio(a: str, b: str) -> int:
    return indel_ratio(*(" ".join(sorted(WORD.findall(x.lower()))) for x in (a, b)))


def list_agreement(a: list[str], b: list[str], least: int = 60) -> float:
    """Greedy one-to-one matches of at least `least`, over the longer list's length; two empty lists agree fully."""
    free, hits = list(b), 0
    for x in a:
        best = max(((token_sort_ratio(x, y), -i) for i, y in enumerate(free)), default=(0, 0))
        if free and best[0] >= least:
            hits += 1
            free.pop(-best[1])
    return hits / max(len(a), len(b)) if a or b else 1.0


def greedy_agreement(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """key and agreement of the two string lists; a null list is empty."""

    def run(batches):
        for batch in batches:
            out = [round(list_agreement(x or [], y or []), 6) for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=[key, "agreement"])

    return df.select(key, a, b).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, agreement double")
