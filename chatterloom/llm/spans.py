"""Long spans that stand in more than one document, verbatim or with small changes, by collinear chaining.

Every document is winnowed: of each window of consecutive k-character seeds the one with the smallest
hash is kept, so two documents with a run of k + window - 1 characters in common keep a common seed at
the same place of that run. Seeds are joined, and the matches of a pair of documents are chained in order
on both sides, with a cost for gaps, through a Fenwick tree; every match ends in one chain. Only slices of
the texts around the chains are then brought together, and each chain is aligned: characters are compared
along its diagonals, which gives the verbatim runs, and the gaps between its blocks by edit distance,
which gives the fuzzy passages. A result rests on compared characters only; hashes just find places.

Where a seed repeats at a constant short distance (one letter, one line again and again) the places deep
inside are left to their stretch: its first match carries its end, and the shared parts of such stretches
are found in their slices. Documents with one text are one class; all of this is made once per pair of
classes. A seed of very many documents is joined in blocks, so no task gets all its pairs.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatterloom.session import stage

SEED_CHARS = 64
GAP_COST = 0.05
LEAST_SIMILARITY = 0.8
BLOCK_ROWS = 1000
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of each run of k code points."""
    n = len(codes)
    if n < k:
        return np.zeros(0, np.uint64)
    power = np.cumprod(np.full(n, BASE, np.uint64))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power)))
    back = np.cumprod(np.full(n - k + 1, INVERSE, np.uint64))
    x = (sums[k:] - sums[: n - k + 1]) * back
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def _sliding(x: np.ndarray, width: int, extreme) -> np.ndarray:
    """Extreme of each window of width items, in a fixed number of passes."""
    out, have = x, 1
    while have * 2 <= width:
        out = extreme(out[:-have], out[have:])
        have *= 2
    return extreme(out[: len(x) - width + 1], out[width - have :][: len(x) - width + 1])


def seeds(text: str, k: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, places and ends of the kept seeds of text; the end is another place only at the start of a thinned stretch."""
    h = gram_hashes(_codes(text), k)
    window = least - k + 1
    if len(h) < window:
        return h[:0], np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = _sliding(h, window, np.minimum)
    pad = np.zeros(window - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate((pad, low, pad)), window, np.maximum) == h)
    at = at[np.lexsort((at, h[at]))]
    value = h[at]
    if len(at) < 3 or not np.any(value[2:] == value[:-2]):
        return value, at, at
    # a stretch is a row of places of one seed at one distance of at most a window
    step = np.diff(at)
    linked = (value[1:] == value[:-1]) & (step <= window)
    new = np.concatenate(([True], ~linked))
    new[2:] |= linked[:-1] & (step[1:] != step[:-1])
    group = np.cumsum(new) - 1
    first, last = at[new], at[np.concatenate((new[1:], [True]))]
    deep = (at - first[group] > 2 * window) & (last[group] - at > 2 * window)
    thinned = np.zeros(len(first), bool)
    thinned[group[deep]] = True
    to = np.where(new & thinned[group], last[group], at)
    return value[~deep], at[~deep], to[~deep]


class _Fenwick:
    """Largest value among ranks up to r, with the item that has it."""

    def __init__(self, n: int):
        self.best = [(-1e300, -1)] * (n + 1)

    def put(self, r: int, value: tuple[float, int]) -> None:
        while r < len(self.best):
            if value > self.best[r]:
                self.best[r] = value
            r += r & -r

    def upto(self, r: int) -> tuple[float, int]:
        out = (-1e300, -1)
        while r > 0:
            out = max(out, self.best[r])
            r -= r & -r
        return out


def chains(matches: list[tuple[int, int]], k: int, gap: float = GAP_COST) -> list[tuple[float, list[tuple[int, int]]]]:
    """Score and matches (place in a, place in b) of collinear chains, best first; every match is in one of them.

    A match adds k characters, or what it covers beyond the one before; each character skipped on either
    side costs gap. A chain that runs into a better one is cut there.
    """
    matches = sorted(set(matches))
    rank = {b: i + 1 for i, b in enumerate(sorted({b for _, b in matches}))}
    tree = _Fenwick(len(rank))
    score, back = [float(k)] * len(matches), [-1] * len(matches)
    i = 0
    while i < len(matches):
        j = i
        while j < len(matches) and matches[j][0] == matches[i][0]:
            a, b = matches[j]
            _, at = tree.upto(rank[b] - 1)
            if at >= 0:
                da, db = a - matches[at][0], b - matches[at][1]
                linked = score[at] + min(k, da, db) - gap * (max(0, da - k) + max(0, db - k))
                if linked > score[j]:
                    score[j], back[j] = linked, at
            j += 1
        for m in range(i, j):
            tree.put(rank[matches[m][1]], (score[m] + gap * sum(matches[m]), m))
        i = j
    out, used = [], [False] * len(matches)
    for end in sorted(range(len(matches)), key=lambda m: (-score[m], m)):
        path, at = [], end
        while at >= 0 and not used[at]:
            used[at] = True
            path.append(matches[at])
            at = back[at]
        if path:
            out.append((score[end] - (score[at] if at >= 0 else 0.0), path[::-1]))
    return out


def edits(a: np.ndarray, b: np.ndarray) -> int:
    """Edit distance of two runs of code points, one big-integer step per character of b."""
    n = min(len(a), len(b))
    same = int(np.argmin(np.concatenate((a[:n] == b[:n], [False]))))
    a, b = a[same:], b[same:]
    n = min(len(a), len(b))
    same = int(np.argmin(np.concatenate((a[len(a) - n :][::-1] == b[len(b) - n :][::-1], [False]))))
    a, b = a[: len(a) - same].tolist(), b[: len(b) - same].tolist()
    if not a or not b:
        return len(a) + len(b)
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    more, less, out = full, 0, len(a)
    for y in b:
        eq = where.get(y, 0)
        across = (((eq & more) + more) ^ more) | eq
        up, down = less | ~(across | more) & full, more & across
        out += (up & top > 0) - (down & top > 0)
        up, down = (up << 1 | 1) & full, (down << 1) & full
        diagonal = eq | less
        more, less = (down | ~(diagonal | up)) & full, up & diagonal
    return out


def _stretches(hit: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Rows [start, end) of at least `least` true items."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [(int(s), int(e)) for s, e in zip(edge[::2], edge[1::2]) if e - s >= least]


def runs(x: np.ndarray, y: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Stretches [start, end) of x all of whose substrings of `least` characters stand in y; characters are compared."""
    hx, hy = gram_hashes(x, least), gram_hashes(y, least)
    place: dict[int, int] = {}
    for j, v in enumerate(hy.tolist()):
        place.setdefault(v, j)
    hit = np.zeros(len(x), bool)
    for i in np.flatnonzero(np.isin(hx, hy)).tolist():
        j = place[int(hx[i])]
        if np.array_equal(x[i : i + least], y[j : j + least]):
            hit[i : i + least] = True
    return _stretches(hit, least)


class _Slices:
    """Slices of one text by their places in it."""

    def __init__(self, starts: list[int], texts: list[str]):
        self.starts, self.codes = starts, [_codes(t) for t in texts]

    def around(self, place: int) -> tuple[int, np.ndarray]:
        """Start and code points of the slice that holds place."""
        i = bisect_right(self.starts, place) - 1
        return self.starts[i], self.codes[i]

    def cut(self, start: int, end: int) -> tuple[int, np.ndarray]:
        """Start and code points of [start, end), as far as the slice of start goes."""
        at, codes = self.around(start)
        return start, codes[start - at : end - at]


def align(path: list[tuple[int, int]], a: _Slices, b: _Slices, k: int, least: int, compared: set) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int, int]]]:
    """Verbatim runs (start in a, start in b, length) and passages (from_a, to_a, from_b, to_b, edits) of one chain.

    compared: diagonals of slices whose runs are known already. Blocks of the chain grow as far as the
    characters agree. Gaps between them with more edits than a quarter of the shorter block beside them end a
    passage; passages of at least `least` characters on both sides and of enough similarity count.
    """
    (from_a, x), (from_b, y) = a.around(path[0][0]), b.around(path[0][1])
    found, blocks, equal = [], [], {}
    for pa_, pb_ in path:
        d = pa_ - pb_
        lo, hi = max(from_a, from_b + d), min(from_a + len(x), from_b + len(y) + d)
        if d not in equal:
            equal[d] = x[lo - from_a : hi - from_a] == y[lo - d - from_b : hi - d - from_b]
            if (d, from_a, from_b) not in compared:
                compared.add((d, from_a, from_b))
                found += [(lo + s, lo + s - d, e - s) for s, e in _stretches(equal[d], least)]
        same = equal[d]
        if not same[pa_ - lo : pa_ - lo + k].all():
            continue  # the hashes of two different seeds agree
        if blocks and blocks[-1][0] - blocks[-1][2] == d and blocks[-1][1] >= pa_ + k:
            continue
        behind, ahead = np.flatnonzero(~same[: pa_ - lo]), np.flatnonzero(~same[pa_ - lo :])
        start = lo + int(behind[-1]) + 1 if len(behind) else lo
        end = pa_ + int(ahead[0]) if len(ahead) else hi
        if blocks:
            over = max(blocks[-1][1] - start, blocks[-1][3] - (start - d), 0)
            start += over
        if end > start:
            blocks.append((start, end, start - d, end - d))
    passages, at = [], 0
    for i in range(1, len(blocks) + 1):
        if i < len(blocks):
            p, q = blocks[i - 1], blocks[i]
            changed = edits(x[p[1] - from_a : q[0] - from_a], y[p[3] - from_b : q[2] - from_b])
            if 4 * changed <= min(p[1] - p[0], q[1] - q[0]):
                blocks[i] = (*q, changed)
                continue
        piece = blocks[at:i]
        n_a, n_b, changed = piece[-1][1] - piece[0][0], piece[-1][3] - piece[0][2], sum(p[4] for p in piece[1:])
        if min(n_a, n_b) >= least and changed <= (1 - LEAST_SIMILARITY) * max(n_a, n_b):
            passages.append((piece[0][0], piece[-1][1], piece[0][2], piece[-1][3], changed))
        at = i
    return found, passages


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


_INTS, _LONGS = pa.list_(pa.int32()), pa.list_(pa.int64())
_CHAINED = pa.schema([("rep_a", pa.int64()), ("rep_b", pa.int64()), ("chain", _INTS), ("in_a", _LONGS), ("in_b", _LONGS), ("start_a", _INTS), ("size_a", _INTS), ("start_b", _INTS), ("size_b", _INTS)])
_RUNS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_PASSAGES = pa.list_(pa.struct([(c, pa.int32()) for c in ("from_a", "to_a", "from_b", "to_b", "edits")]))
_ALIGNED = pa.schema([("rep_a", pa.int64()), ("rep_b", pa.int64()), ("runs_a", _RUNS), ("runs_b", _RUNS), ("passages", _PASSAGES)])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def _chain_pair(in_a: list[int], in_b: list[int], k: int, margin: int) -> tuple:
    """Chains of one pair and the slices of both texts they need. in_a, in_b: place * 2^32 + end."""
    low = (1 << 32) - 1
    ends = {(a >> 32, b >> 32): (a & low, b & low) for a, b in zip(in_a, in_b)}
    number, first, second, spans = [], [], [], ([], [])
    for c, (_, path) in enumerate(chains(list(ends), k)):
        for a, b in path:
            to_a, to_b = ends[a, b]
            number.append(c)
            first.append(a << 32 | to_a)
            second.append(b << 32 | to_b)
            if to_a > a or to_b > b:
                spans[0].append((max(0, a - margin), to_a + k + margin))
                spans[1].append((max(0, b - margin), to_b + k + margin))
        for side in (0, 1):
            spans[side].append((max(0, path[0][side] - margin), path[-1][side] + k + margin))
    slices = [_merged(s) for s in spans]
    return number, first, second, *[x for s in slices for x in ([p for p, _ in s], [e - p for p, e in s])]


def _align_pair(chain, in_a, in_b, start_a, texts_a, start_b, texts_b, k: int, least: int) -> tuple[list, list, list]:
    """Runs in a, runs in b and passages of one pair."""
    low = (1 << 32) - 1
    a, b, margin = _Slices(start_a, texts_a), _Slices(start_b, texts_b), least - k
    found_a, found_b, passages, compared = [], [], [], set()
    i = 0
    while i < len(chain):
        j = i
        while j < len(chain) and chain[j] == chain[i]:
            to_a, to_b = in_a[j] & low, in_b[j] & low
            at_a, at_b = in_a[j] >> 32, in_b[j] >> 32
            if to_a > at_a or to_b > at_b:
                (sa, x), (sb, y) = a.cut(max(0, at_a - margin), to_a + k + margin), b.cut(max(0, at_b - margin), to_b + k + margin)
                found_a += [(sa + s, sa + e) for s, e in runs(x, y, least)]
                found_b += [(sb + s, sb + e) for s, e in runs(y, x, least)]
            j += 1
        exact, fuzzy = align([(p >> 32, q >> 32) for p, q in zip(in_a[i:j], in_b[i:j])], a, b, k, least, compared)
        found_a += [(s, s + n) for s, _, n in exact]
        found_b += [(s, s + n) for _, s, n in exact]
        passages += fuzzy
        i = j
    return found_a, found_b, sorted(set(passages))


def shared(df: DataFrame, key: str, text: str, least: int = 100, seed_chars: int = SEED_CHARS) -> tuple[DataFrame, DataFrame]:
    """Pairs of text classes that share a span of at least `least` code points, and the classes' members.

    (pairs: rep_a < rep_b, runs_a and runs_b, verbatim, empty if there is none of that length, and passages,
    aligned; members: id, rep, n_chars). Texts shorter than `least`, empty and null ones are in no pair and no
    class. A class is named by its smallest key. Other columns are not read. A repeated row (key and text) counts once.
    """
    k = min(seed_chars, least)
    slim = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).where(F.length("text") >= least)
    named = slim.select("id", F.xxhash64("text").alias("h1"), F.unhex(F.md5("text")).alias("h2"), F.length("text").alias("n_chars"))
    reps = named.groupBy("h1", "h2").agg(F.min("id").alias("rep"))
    members = stage(named.join(reps, ["h1", "h2"]).select("id", "rep", "n_chars").distinct(), "span-members")
    texts = slim.join(members.where("id = rep").select("id"), "id").dropDuplicates(["id"])

    def scan(batches):
        for batch in batches:
            kept = [(i, *seeds(t, k, least)) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            reps = np.repeat(np.array([i for i, *_ in kept], np.int64), [len(h) for _, h, *_ in kept])
            h, at, to = (np.concatenate([x[c] for x in kept] or [np.zeros(0)]) for c in (1, 2, 3))
            yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.uint64).view(np.int64)), pa.array(reps), pa.array(at.astype(np.int64) << 32 | to.astype(np.int64))], names=["h", "rep", "at"])

    found = stage(texts.mapInArrow(scan, "h bigint, rep bigint, at bigint"), "seeds")
    common = found.groupBy("h").agg(F.count("*").alias("n"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    found = stage(found.join(common.select("h", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks")), "h"), "common-seeds")
    a = found.select("h", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"), F.col("rep").alias("rep_a"), F.col("at").alias("in_a"))
    b = found.select("h", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("rep").alias("rep_b"), F.col("at").alias("in_b"))
    matches = a.join(b, ["h", "block"]).where("rep_a < rep_b")
    pairs = matches.groupBy("rep_a", "rep_b").agg(F.collect_list("in_a").alias("in_a"), F.collect_list("in_b").alias("in_b"))

    def chained(batches):
        for batch in batches:
            yield _table([(ra, rb, *_chain_pair(x, y, k, least - k)) for ra, rb, x, y in zip(*(c.to_pylist() for c in batch.columns))], _CHAINED)

    columns = "rep_a bigint, rep_b bigint, chain array<int>, in_a array<bigint>, in_b array<bigint>, start_a array<int>, size_a array<int>, start_b array<int>, size_b array<int>"
    out = pairs.mapInArrow(chained, columns)
    needed = stage(texts.join(found.select(F.col("rep").alias("id")).distinct(), "id"), "span-texts")
    for side in ("a", "b"):
        cut = F.expr(f"transform(arrays_zip(start_{side}, size_{side}), s -> substring(whole, s.start_{side} + 1, s.size_{side}))")
        out = out.join(needed.select(F.col("id").alias(f"rep_{side}"), F.col("text").alias("whole")), f"rep_{side}").withColumn(f"texts_{side}", cut).drop("whole", f"size_{side}")

    def aligned(batches):
        for batch in batches:
            rows = []
            for ra, rb, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                runs_a, runs_b, passages = _align_pair(*rest, k, least)
                if runs_a or passages:
                    rows.append((ra, rb, *[[{"start": s, "end": e} for s, e in sorted(set(r))] for r in (runs_a, runs_b)], [dict(zip(("from_a", "to_a", "from_b", "to_b", "edits"), p)) for p in passages]))
            yield _table(rows, _ALIGNED)

    spans = "array<struct<start:int,end:int>>"
    out = out.select("rep_a", "rep_b", "chain", "in_a", "in_b", "start_a", "texts_a", "start_b", "texts_b")
    return out.mapInArrow(aligned, f"rep_a bigint, rep_b bigint, runs_a {spans}, runs_b {spans}, passages array<struct<from_a:int,to_a:int,from_b:int,to_b:int,edits:int>>"), members


def document_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """id_a < id_b of every two documents that share a verbatim span: members of paired classes and of one class."""
    members = members.select("id", "rep")
    a, b = members.select(F.col("id").alias("i"), F.col("rep").alias("rep_a")), members.select(F.col("id").alias("j"), F.col("rep").alias("rep_b"))
    across = pairs.where("size(runs_a) > 0").select("rep_a", "rep_b").join(a, "rep_a").join(b, "rep_b").select("i", "j")
    within = a.join(b, F.col("rep_a") == F.col("rep_b")).where("i < j").select("i", "j")
    return across.unionByName(within).select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b"))


def links(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """id, class_id and n_links of every document in a class: the other documents it shares a verbatim span with."""
    members = members.select("id", "rep")
    sizes = members.groupBy("rep").agg(F.count("*").alias("n"))
    linked = pairs.where("size(runs_a) > 0")
    ends = linked.select(F.col("rep_a").alias("rep"), F.col("rep_b").alias("other")).unionByName(linked.select(F.col("rep_b").alias("rep"), F.col("rep_a").alias("other")))
    across = ends.join(sizes.select(F.col("rep").alias("other"), F.col("n").alias("m")), "other").groupBy("rep").agg(F.sum("m").alias("m"))
    counted = sizes.join(across, "rep", "left").select("rep", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"))
    return members.join(counted, "rep").select("id", F.col("rep").alias("class_id"), "n_links")


def passages(pairs: DataFrame) -> DataFrame:
    """rep_a, rep_b, from_a, to_a, from_b, to_b, edits: aligned passages of every pair of classes."""
    return pairs.select("rep_a", "rep_b", F.inline("passages"))


def stretches(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """id, start, length: merged stretches of each document that also stand in another document."""
    sides = pairs.select(F.col("rep_a").alias("rep"), F.explode("runs_a").alias("r")).unionByName(pairs.select(F.col("rep_b").alias("rep"), F.explode("runs_b").alias("r")))
    several = members.groupBy("rep").agg(F.count("*").alias("n"), F.first("n_chars").alias("end")).where("n > 1").select("rep", F.lit(0).alias("start"), "end")
    spans = sides.select("rep", "r.start", "r.end").unionByName(several).distinct()
    order = Window.partitionBy("rep").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)).withColumn("g", F.sum("new").over(order))
    merged = spans.groupBy("rep", "g").agg(F.min("start").alias("start"), (F.max("end") - F.min("start")).alias("length"))
    return members.select("id", "rep").join(merged.drop("g"), "rep").select("id", "start", "length")
