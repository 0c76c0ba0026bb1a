"""Train, validation and test splits that keep related records together.

Records that share a value of any key column are related. Values are joined into components by parallel
hooking and shortcutting over a table of parents: each round every value takes the smallest parent among
the values it occurs with, then its parent's parent, until nothing changes; rounds are written tables, and
their number grows with the logarithm of the longest chain of values. A value that occurs with no other is a
component with an edge to itself.

Components are dealt out by their rows and positives. Those of middling size go in proportion, in classes of
about one size. Then the few large ones go through bitsets of reachable sums, and the many small ones, in
classes of exactly one size, make up the difference: in proportion first, and what is left of each class
through bitsets over size multiplicities, which pick the totals closest to the wanted ones. Swaps of components of one size then even out the
share of positives. The driver sees sizes and their multiplicities, and the few large components.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterloom.llm.quota import places
from chatterloom.session import small, stage

HEADS = 2000
SMALL_ROWS = 100
BITSET_ROWS = 4_000_000
MAX_BROADCAST_ROWS = 500_000


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) of every node of edges (u, v), strings; a node alone has an edge to itself."""
    both = stage(edges.select("u", "v").union(edges.select("v", "u")).distinct(), "edges")
    parents = stage(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("u"), F.min("v")).alias("root")), "parents")
    while True:
        near = both.join(parents.toDF("v", "r"), "v").groupBy(F.col("u").alias("node")).agg(F.min("r").alias("near"))
        hooked = parents.join(near, "node").select("node", "root", F.least("root", "near").alias("low"))
        hook = hooked.groupBy(F.col("root").alias("node")).agg(F.min("low").alias("to"))
        hooked = stage(hooked.join(hook, "node", "left").select("node", F.col("root").alias("old"), F.least("low", F.coalesce("to", "low")).alias("root")), "hooked")
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("up"))
        parents = stage(hooked.join(up, "root").select("node", F.col("up").alias("root"), "old"), "parents")
        if parents.where("root <> old").limit(1).count() == 0:
            return parents.select("node", "root")
        parents = parents.select("node", "root")


def subset_nearest(sizes: Sequence[tuple[int, int]], target: int) -> list[int]:
    """How many of each size (size, how many there are) to take so that their sum is as close to target as any.

    The sums reachable are a bitset; a multiplicity is a few chunks of doubling numbers. Bitsets are kept for
    every so many chunks only and made again between them on the way back.
    """
    chunks = []
    for i, (size, many) in enumerate(sizes):
        part = 1
        while many > 0:
            part = min(part, many)
            chunks.append((i, part, size * part))
            many -= part
            part *= 2
    mask = (1 << (2 * max(target, 0) + 1)) - 1
    step = math.isqrt(len(chunks)) + 1
    reach, kept = 1, []
    for c, (_, _, weight) in enumerate(chunks):
        if c % step == 0:
            kept.append(reach)
        reach |= (reach << weight) & mask
    best = (reach & ((1 << (max(target, 0) + 1)) - 1)).bit_length() - 1
    if above := reach >> (max(target, 0) + 1):
        higher = target + (above & -above).bit_length()
        best = higher if higher - target < target - best else best
    taken = [0] * len(sizes)
    for b in range(len(kept) - 1, -1, -1):
        part, steps = chunks[b * step : (b + 1) * step], [kept[b]]
        for _, _, weight in part[:-1]:
            steps.append(steps[-1] | (steps[-1] << weight) & mask)
        for (i, many, weight), before in zip(reversed(part), reversed(steps)):
            if not before >> best & 1:
                taken[i] += many
                best -= weight
    return taken


class _Pool:
    """Components to choose from: (rows, positives, name, how many)."""

    def __init__(self, items: list[tuple[int, int, object, int]]):
        self.items = [[*x] for x in items if x[3] > 0]

    def take(self, want: float, need: float, unit: int) -> list[tuple[int, int, object, int]]:
        """Take away components with about want rows and need positives. unit: rows are counted in such units.

        Components above and below the overall rate are chosen apart: so many rows of each that rows and positives both fit.
        """
        rows, total = (sum(x[at] * x[3] for x in self.items) for at in (0, 1))
        rate = total / max(rows, 1)
        high, low = [x for x in self.items if x[1] > rate * x[0]], [x for x in self.items if x[1] <= rate * x[0]]
        up, down = (sum(x[1] * x[3] for x in half) / max(sum(x[0] * x[3] for x in half), 1) for half in (high, low))
        part = (need - down * want) / (up - down) if up > down else 0.0
        out, got = [], 0
        for half, aim in ((high, min(max(part, 0.0), want)), (low, None)):
            aim = want - got if aim is None else aim
            by_size: dict[int, list[list]] = {}
            for x in sorted(half, key=lambda x: (-x[0], x[1])):
                by_size.setdefault(max(1, round(x[0] / unit)), []).append(x)
            sizes = [(n, sum(x[3] for x in xs)) for n, xs in by_size.items()]
            for many, xs in zip(subset_nearest(sizes, max(0, round(aim / unit))), by_size.values()):
                for x in xs:
                    some = min(many, x[3])
                    if some:
                        out.append((x[0], x[1], x[2], some))
                        x[3] -= some
                        many -= some
                        got += x[0] * some
        self.items = [x for x in self.items if x[3] > 0]
        return out


def deal(heads: list[tuple[int, int]], classes: list[tuple[int, int, int]], shares: Sequence[float], fixed: Sequence[tuple[int, int]] | None = None) -> tuple[list[int], list[list[int]]]:
    """Split of each head (rows, positives), and how many components of each class (rows, positives, how many) each split gets.

    fixed: rows and positives each split has already.
    """
    k = len(shares)
    fixed = fixed or [(0, 0)] * k
    rows, total = (sum(h[at] for h in heads) + sum(c[at] * c[2] for c in classes) + sum(f[at] for f in fixed) for at in (0, 1))
    want = [s * rows - f[0] for s, f in zip(shares, fixed)]
    need = [s * total - f[1] for s, f in zip(shares, fixed)]
    home, dealt = [0] * len(heads), [[0] * k for _ in classes]
    order = sorted(range(1, k), key=lambda s: shares[s])

    def give(pool: _Pool, s: int, aim: float, positives: float, unit: int) -> None:
        for n, p, (kind, j), many in pool.take(aim, positives, unit):
            if kind == "head":
                home[j] = s
            else:
                dealt[j][s] += many
            want[s] -= n * many
            need[s] -= p * many

    # large ones first, as many rows as is their part of all that is to be dealt; small ones make up the difference
    small = sum(n * m for n, _, m in classes)
    pool = _Pool([(n, p, ("head", i), 1) for i, (n, p) in enumerate(heads)])
    share = 1 - small / max(sum(want), 1)
    for s in order:
        give(pool, s, max(want[s], 0) * share, max(need[s], 0) * share, -(-rows // BITSET_ROWS) or 1)
    for n, p, _, many in pool.items:
        want[0] -= n * many
        need[0] -= p * many
    small = max(small, 1)
    part = [max(w, 0) / small for w in want]
    for j, (n, p, m) in enumerate(classes):
        for s in range(k):
            dealt[j][s] = int(m * part[s] / max(sum(part), 1)) if m >= 10 else 0
            want[s] -= n * dealt[j][s]
            need[s] -= p * dealt[j][s]
    pool = _Pool([(n, p, ("class", j), m - sum(dealt[j])) for j, (n, p, m) in enumerate(classes)])
    for s in order:
        give(pool, s, max(want[s], 0), max(need[s], 0), 1)
    for _, _, (kind, j), many in pool.items:
        if kind == "class":
            dealt[j][0] += many
    _even(heads, home, classes, dealt, shares, fixed)
    return home, dealt


def _even(heads, home, classes, dealt, shares, fixed) -> None:
    """Swap components of equal size between each split and the first until shares of positives agree."""
    by_size: dict[int, list[int]] = {}
    for c, (n, _, _) in enumerate(classes):
        by_size.setdefault(n, []).append(c)
    rows, total = (sum(h[at] for h in heads) + sum(c[at] * c[2] for c in classes) + sum(f[at] for f in fixed) for at in (0, 1))
    for s in range(1, len(shares)):
        have = fixed[s][1] + sum(p for (_, p), h in zip(heads, home) if h == s) + sum(d[s] * c[1] for d, c in zip(dealt, classes))
        size = fixed[s][0] + sum(n for (n, _), h in zip(heads, home) if h == s) + sum(d[s] * c[0] for d, c in zip(dealt, classes))
        lack = round(total * size / max(rows, 1)) - have
        for n in sorted(by_size, reverse=True):
            own = sorted(by_size[n], key=lambda c: classes[c][1])
            for lo in own:
                for hi in reversed(own):
                    gain = classes[hi][1] - classes[lo][1]
                    if gain <= 0 or not lack:
                        continue
                    give, take = (lo, hi) if lack > 0 else (hi, lo)
                    many = min(abs(lack) // gain, dealt[give][s], dealt[take][0])
                    dealt[give][s] -= many
                    dealt[give][0] += many
                    dealt[take][0] -= many
                    dealt[take][s] += many
                    lack -= many * gain if lack > 0 else -many * gain


def related(df: DataFrame, row: str, keys: Sequence[str], label: str | None = None) -> DataFrame:
    """row, y (1 for a label above 0) and unit, the component, of every row. Null and empty key values relate nothing; rows without any key are alone."""
    y = (F.coalesce(F.col(label), F.lit(0)) > 0).cast("int") if label else F.lit(0)
    slim = df.select(F.col(row).alias("row"), y.alias("y"), *[F.nullif(F.col(k).cast("string"), F.lit("")).alias(f"k{i}") for i, k in enumerate(keys)])
    named = [F.concat(F.lit(f"{i}:"), F.col(f"k{i}")) for i in range(len(keys))]
    rows = slim.select("row", "y", F.coalesce(*named).alias("first"), F.array_compact(F.array(*named)).alias("nodes"))
    edges = rows.where("first is not null").select(F.col("first").alias("u"), F.explode("nodes").alias("v")).distinct()
    root = small(components(edges), MAX_BROADCAST_ROWS)
    return rows.join(root.toDF("first", "root"), "first", "left").select("row", "y", F.coalesce("root", F.concat(F.lit("row:"), F.col("row").cast("string"))).alias("unit"))


def _quota(spark, classes, dealt, k: int):
    """Per class the number of places of all splits behind each split."""
    plan = [(n, p, *[int(sum(d[s + 1 :])) for s in range(k)]) for (n, p, *_), d in zip(classes, dealt)]
    return F.broadcast(spark.createDataFrame(plan, "cn bigint, cp bigint, " + ", ".join(f"q{s} bigint" for s in range(k))))


def _by_place(units: DataFrame, classes, dealt, names, seed: int) -> DataFrame:
    """units (unit, cn, cp) with their split: places in a seeded order within the class, by the quota of the class."""
    ranked = places(units, ["cn", "cp"], "unit", seed=seed).join(_quota(units.sparkSession, classes, dealt, len(names)), ["cn", "cp"])
    # the first split takes the places behind all others, the last the first places
    split = F.lit(names[0])
    for s in range(1, len(names)):
        split = F.when(F.col("before") < F.col(f"q{s - 1}"), names[s]).otherwise(split)
    return ranked.withColumn("split", split)


def assign(df: DataFrame, row: str, keys: Sequence[str], label: str, names: Sequence[str] = ("train", "val", "test"), shares: Sequence[float] = (0.7, 0.1, 0.2), seed: int = 11) -> DataFrame:
    """row, component and split of every row.

    Rows without any key are components of their own. Null and empty key values relate nothing. A null
    label counts as no positive. An empty table has an empty result.
    """
    rows, k = related(df, row, keys, label), len(shares)
    sums = stage(rows.groupBy("unit").agg(F.count("*").alias("n"), F.sum("y").alias("p")), "units")
    all_rows = sums.agg(F.sum("n")).first()[0] or 0
    large = max(SMALL_ROWS, all_rows // HEADS)
    spark = df.sparkSession
    # components of middling size, in classes of two digits of rows and tenths of positives, in proportion; their true sums count below
    digits = F.pow(F.lit(10), F.floor(F.log10("n")) - 1)
    near = (F.round(F.col("n") / digits) * digits).cast("bigint")
    middle = sums.where((F.col("n") > SMALL_ROWS) & (F.col("n") <= large)).select("unit", "n", "p", near.alias("cn"), F.round(F.col("p") / F.col("n") * 10).cast("bigint").alias("cp"))
    counted = [(r["cn"], r["cp"], r["m"]) for r in middle.groupBy("cn", "cp").agg(F.count("*").alias("m")).orderBy("cn", "cp").collect()]
    spread, owed = [], [0.0] * k
    for n, p, m in counted:
        owed = [o + m * s for o, s in zip(owed, shares)]
        some = [min(int(o), m) for o in owed]
        some[0] = m - sum(some[1:])
        owed = [o - d for o, d in zip(owed, some)]
        spread.append(some)
    middle = stage(_by_place(middle, counted, spread, names, seed).select("unit", "n", "p", "split"), "middle")
    had = {r["split"]: (r["n"], r["p"]) for r in middle.groupBy("split").agg(F.sum("n").alias("n"), F.sum("p").alias("p")).collect()}
    heads = [(r["unit"], r["n"], r["p"]) for r in sums.where(F.col("n") > large).orderBy("unit").collect()]
    tail = sums.where(F.col("n") <= SMALL_ROWS).select("unit", F.col("n").alias("cn"), F.col("p").cast("bigint").alias("cp"))
    classes = [(r["cn"], r["cp"], r["m"]) for r in tail.groupBy("cn", "cp").agg(F.count("*").alias("m")).orderBy("cn", "cp").collect()]
    home, dealt = deal([h[1:] for h in heads], classes, shares, [had.get(name, (0, 0)) for name in names])
    fixed = spark.createDataFrame([(h[0], names[s]) for h, s in zip(heads, home)], "unit string, split string")
    chosen = _by_place(tail, classes, dealt, names, seed).select("unit", "split").unionByName(middle.select("unit", "split")).unionByName(fixed)
    return rows.join(small(stage(chosen, "splits"), MAX_BROADCAST_ROWS), "unit").select(F.col("row").alias(row), F.col("unit").alias("component"), "split")
