"""Per-key sums whose work does not depend on how rows spread over keys.

Each input split dictionary-encodes its keys, adds its rows into dense numpy arrays (bincount) and
emits those arrays in blocks; a key's block is a hash of the key. Blocks are summed after one shuffle.
A key that holds a third of all rows costs its split no more than any other key, and each split ships
one array slot per key and not one row per record.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLUSH_KEYS = 1_000_000


class _Accumulator:
    """Dense arrays over the keys seen so far in this split."""

    def __init__(self, width: int):
        self.width, self.slots = width, {}
        self.rows = np.zeros(1024, np.int64)
        self.sums = np.zeros((2 * width, 1024), np.float64)

    def add(self, keys: pa.Array, values: list[np.ndarray]) -> None:
        coded = keys.dictionary_encode(null_encoding="encode")
        names = coded.dictionary.to_pylist()
        slots = np.fromiter((self.slots.setdefault(x, len(self.slots)) for x in names), np.int64, len(names))
        if len(self.slots) > len(self.rows):
            size = 2 * len(self.slots)
            self.rows = np.pad(self.rows, (0, size - len(self.rows)))
            self.sums = np.pad(self.sums, ((0, 0), (0, size - self.sums.shape[1])))
        code = coded.indices.to_numpy(zero_copy_only=False)
        n = len(names)
        self.rows[slots] += np.bincount(code, minlength=n)[:n]
        for i, v in enumerate(values):
            known = ~np.isnan(v)
            self.sums[2 * i, slots] += np.bincount(code[known], v[known], n)[:n]
            self.sums[2 * i + 1, slots] += np.bincount(code[known], minlength=n)[:n]

    def blocks(self, count: int) -> Iterator[pa.RecordBatch]:
        if not self.slots:
            return
        names = pd.Series(list(self.slots), dtype=object)
        block = (pd.util.hash_array(names.fillna("").to_numpy(), categorize=False) % np.uint64(count)).astype(np.int32)
        order = np.argsort(block, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([block[part[0]]], pa.int32()),
                    "keys": pa.array([[names[i] for i in part]], pa.list_(pa.string())),
                    "rows": pa.array([self.rows[part]], pa.list_(pa.int64())),
                    "sums": pa.array([self.sums[:, part].ravel()], pa.list_(pa.float64())),
                }
            )


def dense_group_sums(df: DataFrame, key: str, measures: Mapping[str, Column] | None = None, blocks: int | None = None) -> DataFrame:
    """One row per value of key: key, n (all its rows), and sum_<m>, cnt_<m> (non-null values) per measure.

    A null key is a group of its own. NaN counts as null. Without rows the result is empty.
    measures: name to numeric Column. blocks: number of array blocks, four per shuffle partition if not given.
    """
    measures = dict(measures or {})
    names = list(measures)
    width = len(names)
    blocks = blocks or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def partial(batches):
        acc = _Accumulator(width)
        for batch in batches:
            values = [batch.column(i + 1).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(width)]
            acc.add(batch.column(0).cast(pa.string()), values)
            if len(acc.slots) > FLUSH_KEYS:
                yield from acc.blocks(blocks)
                acc = _Accumulator(width)
        yield from acc.blocks(blocks)

    def reduce(table: pa.Table) -> pa.Table:
        keys = pc.list_flatten(table["keys"]).combine_chunks().dictionary_encode(null_encoding="encode")
        code, n = keys.indices.to_numpy(zero_copy_only=False), len(keys.dictionary)
        out = {"k": keys.dictionary}
        rows = pc.list_flatten(table["rows"]).to_numpy()
        total = np.zeros(n, np.int64)
        np.add.at(total, code, rows)
        out["n"] = total
        if width:
            parts = [np.reshape(x.values.to_numpy(), (2 * width, -1)) for x in table["sums"]]
            stacked = np.concatenate(parts, axis=1)
            for i, m in enumerate(names):
                out[f"sum_{m}"] = np.bincount(code, stacked[2 * i], n)
                out[f"cnt_{m}"] = np.bincount(code, stacked[2 * i + 1], n).astype(np.int64)
        return pa.table(out)

    slim = df.select(F.col(key).cast("string").alias("k"), *[c.cast("double").alias(f"m{i}") for i, c in enumerate(measures.values())])
    schema = "k string, n bigint" + "".join(f", sum_{m} double, cnt_{m} bigint" for m in names)
    return (
        slim.mapInArrow(partial, "block int, keys array<string>, rows array<bigint>, sums array<double>")
        .groupBy("block")
        .applyInArrow(reduce, schema)
        .withColumnRenamed("k", key)
    )


def frequency_bin(n: Column, head: int = 50, torso: int = 5) -> Column:
    """head / torso / tail by number of rows."""
    return (
        F.when(n >= head, f"head (>={head})")
        .when(n >= torso, f"torso ({torso}-{head - 1})")
        .otherwise(f"tail (<={torso - 1})")
    )
