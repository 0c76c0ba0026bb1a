"""Split fields that hold several values in one string, one value per row with its position.

The bytes of an Arrow string column are scanned as one numpy array: quote parity and depth give the
bytes that are quoted, separators outside quotes give child offsets, and children are gathered into a
new Arrow array with the ordinal of their parent row. Python touches only values with inner quotes.

Rules. Separators: comma, semicolon, bar, plus, bullet, tab, line end, and the wide comma, enumeration
comma and semicolon. A separator inside a balanced pair of quotes separates nothing. Pairs that enclose
a whole value ("", '', “”, «»), at any depth, and the brackets of a JSON list are taken off; a quote mark
inside a quoted value that was doubled or escaped is written once. Asterisks belong to the value. Blanks around a value go, empty places are not
counted. An unbalanced quote is an ordinary character. Null and blank fields, and fields that are just
NA or nan, hold no value.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATORS = ",;|+\t\n，、；•"
ENCLOSING = ('""', "''", "“”", "«»")
BLANKS = " \t\n\x0b\x0c\r\x85\xa0\u1680\u2028\u2029\u202F\u205F\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
NO_VALUE = ("NA", "nan")


def _found(buf: np.ndarray, text: str) -> np.ndarray:
    """Mask of the bytes at which text starts; buf has three more bytes than data."""
    seq = text.encode()
    hit = buf[:-3] == seq[0]
    for i, b in enumerate(seq[1:], 1):
        hit &= buf[i : len(buf) - 3 + i] == b
    return hit


def _covered(buf: np.ndarray, chars: str) -> np.ndarray:
    """Mask of all bytes of any of chars."""
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars if ord(c) < 128]] = True
    out = table[buf[:-3]]
    for c in chars:
        if ord(c) >= 128:
            at = np.flatnonzero(_found(buf, c))
            for i in range(len(c.encode())):
                out[at + i] = True
    return out


class _Rows:
    """Sums of a mask over byte ranges."""

    def __init__(self, mask: np.ndarray):
        self.sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))

    def over(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.sums[end] - self.sums[start]


def _trim(solid: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges without the blanks at their ends; empty ranges come out as start == end."""
    if not len(solid):
        return start, start
    i, j = np.searchsorted(solid, start), np.searchsorted(solid, end) - 1
    some = i <= j
    first = np.where(some, solid[np.minimum(i, len(solid) - 1)], start)
    return first, np.where(some, solid[np.maximum(j, 0)] + 1, first)


def split_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Parent row, position from 1, number of values of the parent, and value, of every value of column."""
    column = column.cast(pa.string()).fill_null("")
    n = len(column)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, pa.array([], pa.string())
    _, where, what = column.buffers()
    off = np.frombuffer(where, np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(what, np.uint8)[off[0] : off[-1]] if what is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    buf = np.concatenate((data, np.zeros(3, np.uint8)))
    size, start, end = len(data), off[:-1], off[1:]
    row = np.repeat(np.arange(n), np.diff(off))

    blank = _covered(buf, BLANKS)
    solid = np.flatnonzero(~blank)
    first, last = _trim(solid, start, end)
    filled = last > first

    plain = buf[:-3] == ord('"')
    slash = buf[:-3] == ord("\\")
    at = np.minimum(first, max(size - 1, 0))
    to = np.maximum(last - 1, 0)
    listed = np.zeros(n, bool)
    if size:
        listed = filled & (last - first >= 2) & (data[at] == ord("[")) & (data[to] == ord("]"))
        before = np.concatenate(([False], slash[:-1]))
        plain &= ~(before & listed[row])
        odd = _Rows(plain).over(start, end) & 1 == 1
        plain &= ~odd[row]
    seen = np.cumsum(plain, dtype=np.int64)
    base = np.concatenate(([0], seen))[start]
    inside = ((seen - base[row]) & 1 == 1) if size else np.zeros(0, bool)
    if listed.any():
        brackets = _Rows(((data == ord("[")) | (data == ord("]"))) & ~inside)
        listed &= brackets.over(start, end) == 2
        blank[first[listed]] = True
        blank[last[listed] - 1] = True
        solid = np.flatnonzero(~blank)

    for opened, closed in ("“”", "«»"):
        up, down = _found(buf, opened) & ~inside, _found(buf, closed) & ~inside
        if up.any():
            depth = np.cumsum(up.astype(np.int64) - down)
            depth -= np.concatenate(([0], depth))[start][row]
            bad = np.zeros(n, bool)
            bad[row[(depth < 0) | (depth > 1)]] = True
            bad |= _Rows(up).over(start, end) != _Rows(down).over(start, end)
            inside |= (depth > 0) & ~bad[row]

    separator = _covered(buf, SEPARATORS) & ~inside
    apostrophe = np.flatnonzero((buf[:-3] == ord("'")) & ~inside)
    if len(apostrophe):
        cuts = _Rows(separator)
        k = np.searchsorted(solid, apostrophe)
        left = np.where(k > 0, solid[np.maximum(k - 1, 0)], -1)
        right = np.where(k + 1 < len(solid), solid[np.minimum(k + 1, len(solid) - 1)], size)
        r = row[apostrophe]
        opens = (left < start[r]) | (cuts.over(np.maximum(left, start[r]), apostrophe) > 0)
        closes = (right >= end[r]) | (cuts.over(apostrophe + 1, np.minimum(right, end[r] - 1) + 1) > 0)
        step = np.zeros(size, np.int64)
        step[apostrophe] = np.where(opens & ~closes, 1, np.where(closes & ~opens, -1, 0))
        depth = np.cumsum(step)
        depth -= np.concatenate(([0], depth))[start][row]
        bad = np.zeros(n, bool)
        bad[row[(depth < 0) | (depth > 1)]] = True
        total = np.zeros(n, np.int64)
        np.add.at(total, row[apostrophe], step[apostrophe])
        bad |= total != 0
        quoted = (depth > 0) & ~bad[row]
        separator &= ~quoted

    lengths = np.zeros(size, np.int64)
    for c in SEPARATORS:
        lengths[_found(buf, c)] = len(c.encode())
    cut = np.flatnonzero(separator & (lengths > 0))
    parent = np.repeat(np.arange(n), 1 + np.bincount(row[cut], minlength=n))
    a = np.sort(np.concatenate((start, cut + lengths[cut])), kind="stable")
    b = np.sort(np.concatenate((end, cut)), kind="stable")
    a, b = _trim(solid, a, b)

    unquoted = np.zeros(len(a), bool)
    marks = {pair: (_found(buf, pair[0]), _found(buf, pair[1])) for pair in ENCLOSING}
    counts = {pair: _Rows(m[0] | m[1]) for pair, m in marks.items()}
    changed = True
    while changed:
        changed = False
        for pair, (opened, closed) in marks.items():
            w, v = len(pair[0].encode()), len(pair[1].encode())
            idx = np.flatnonzero(b - a >= w + v)
            idx = idx[opened[a[idx]] & closed[b[idx] - v]]
            if pair == '""':
                idx = idx[~unquoted[idx]]
                inner = counts[pair].over(a[idx] + w, b[idx] - v)
                whole = inner == 0
                for j in np.flatnonzero(~whole):
                    i = idx[j]
                    whole[j] = _encloses(data[a[i] + 1 : b[i] - 1].tobytes().decode(errors="replace"), listed[parent[i]])
                idx = idx[whole]
                unquoted[idx] = True
            else:
                idx = idx[counts[pair].over(a[idx] + w, b[idx] - v) == 0]
            if len(idx):
                a[idx], b[idx] = _trim(solid, a[idx] + w, b[idx] - v)
                changed = True

    keep = b > a
    parent, a, b, unquoted = parent[keep], a[keep], b[keep], unquoted[keep]
    size_of = b - a
    offsets = np.concatenate(([0], np.cumsum(size_of))).astype(np.int32)
    gather = np.arange(offsets[-1]) + np.repeat(a - offsets[:-1], size_of)
    values = pa.StringArray.from_buffers(len(a), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[gather])))
    odd = np.flatnonzero(unquoted & (_Rows((data == ord('"')) | slash).over(a, b) > 0)) if len(a) else []
    if len(odd):
        texts = values.to_pylist()
        for i in odd:
            texts[i] = _unescape(texts[i], listed[parent[i]])
        values = pa.array(texts, pa.string())

    many = np.bincount(parent, minlength=n)
    head = np.concatenate(([0], np.cumsum(many)))[:-1]
    pos = np.arange(len(parent)) - head[parent] + 1
    alone = np.flatnonzero(many[parent] == 1)
    none = alone[np.isin(values.take(pa.array(alone)).to_numpy(zero_copy_only=False).astype(object), NO_VALUE)] if len(alone) else alone
    if len(none):
        keep = np.ones(len(parent), bool)
        keep[none] = False
        parent, pos, values = parent[keep], pos[keep], values.filter(pa.array(keep))
    return parent, pos, many[parent], values


def _encloses(inner: str, listed: bool) -> bool:
    return '"' not in (inner.replace("\\\\", "").replace('\\"', "") if listed else inner.replace('""', ""))


def _unescape(text: str, listed: bool) -> str:
    if not listed:
        return text.replace('""', '"')
    try:
        return json.loads(f'"{text}"', strict=False)
    except ValueError:
        return text.replace('\\"', '"')


def unpack(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row per value of each field: keys, tag_field, pos (from 1), tag_value, n_values (of that field and row).

    Every row is read whole and is independent of others, so nothing is shuffled. Repeated rows give
    repeated results; other columns of df are not read.
    """
    keys, fields = list(keys), list(fields)
    schema = T.StructType(
        [df.schema[k] for k in keys]
        + [T.StructField("tag_field", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("tag_value", T.StringType()), T.StructField("n_values", T.IntegerType())]
    )

    def run(batches):
        for batch in batches:
            for i, f in enumerate(fields):
                parent, pos, many, values = split_values(batch.column(len(keys) + i))
                take = pa.array(parent)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(j).take(take) for j in range(len(keys))]
                    + [pa.array([f] * len(parent), pa.string()), pa.array(pos, pa.int32()), values, pa.array(many, pa.int32())],
                    names=[*keys, "tag_field", "pos", "tag_value", "n_values"],
                )

    return df.select(*keys, *[F.col(f).cast("string") for f in fields]).mapInArrow(run, schema)
