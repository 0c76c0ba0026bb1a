"""Same or nearly same texts across data splits: an exact weighted cosine join.

A text is a vector over (word, n-th occurrence). The square of a component, its mass, falls with the
number of times the word stands in the corpus, from 1 for the rarest to over 2/3 for the most frequent;
the dot product of two vectors is the mass of their common words. If a share t of the longer text's words
stands in the other, each text misses at most n - ceil(t n) words, so the dot product is at least the mass
of the text without that many of its heaviest words: its need. Masses span no more than a third because
the wanted share is one of words, whatever they weigh; a wider span would let a text miss much more mass,
which lowers the need and lengthens the lists.

Inverted lists hold sets of k words (2, or 3 where the word counts foretell long lists). Words are taken
heaviest first. With the largest masses as bound for fewer than k common words among the first p and the
squared residual norm behind p for the rest, indexing stops at the first p for which both together stay
below the need: a qualifying pair of texts shares a list of its first k common words. Each entry carries
its bound (mass of its set and residual norm behind it), the need and the length of its text, and the
places of two of its words; two entries of a list are a candidate if the smaller bound reaches the larger
need, lengths agree and places have moved no further than missing words allow. Candidates get their exact
dot product, then the longest common subsequence of their words, and what remains is compared word by word.

Occurrences are counted over all texts in an array of fixed size by word hash and kept as logarithms; they
only weigh and order words, so collisions cost time and no result. Texts with equal words (a 128-bit digest
of them) are one class; lists, products and alignments are made once per pair of classes. Long lists are
left to the adaptive split of skewed joins.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterloom.llm.lookalike import LOOKALIKES, plain
from chatterloom.session import small, stage

WORD = re.compile(r"[^\W_]+")
TABLE_BITS = 22
LEVELS = 8
SATURATED = (1 << 15) - 1
FAR = (1 << 12) - 1
PARTS = (1 << 11) - 1
MAX_BROADCAST_ROWS = 500_000


def _case_table() -> dict[int, str]:
    """Small letters to the plain letter that they or their capitals look like, so that both cases of a word agree."""
    pairs = [(c, line[0]) for line in LOOKALIKES.split("\n") if line for c in line[2:]]
    small = {ord(c): a for c, a in pairs if c.islower()}
    return small | {ord(c.lower()): a.lower() for c, a in pairs if c.isupper()}


CASE_TABLE = _case_table()


def words_of(text: str) -> list[str]:
    """Words of text: runs of letters and digits, case ignored, look-alikes made plain."""
    folded = plain(text).casefold()
    return WORD.findall(folded if folded.isascii() else folded.translate(CASE_TABLE))


def word_vectors(df: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """key, class (digest of the words) and words (32-bit hashes) of the texts with at least `least` words."""

    def run(batches):
        known: dict[str, int] = {}
        for batch in batches:
            lists = [words_of(t) if t else [] for t in batch.column(1).to_pylist()]
            keep = [i for i, w in enumerate(lists) if len(w) >= least]
            flat = pa.array([w for i in keep for w in lists[i]], pa.string()).dictionary_encode()
            codes = np.array([known.get(w) or known.setdefault(w, xxhash.xxh32_intdigest(w) - (1 << 31)) for w in flat.dictionary.to_pylist()], np.int32)
            if len(known) > 1_000_000:
                known.clear()
            offsets = np.concatenate(([0], np.cumsum([len(lists[i]) for i in keep]))).astype(np.int32)
            hashed = pa.array(codes[flat.indices.to_numpy()] if len(keep) else np.zeros(0, np.int32), pa.int32())
            classes = [xxhash.xxh3_128_digest(" ".join(lists[i]).encode("utf-8", "surrogatepass")) for i in keep]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int64())), pa.array(classes, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), hashed)], names=["key", "class", "words"]
            )

    return df.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, "key bigint, class binary, words array<int>")


def word_levels(vectors: DataFrame, column: str = "words", bits: int = TABLE_BITS) -> np.ndarray:
    """LEVELS times the binary logarithm of the number of occurrences of each word hash, modulo the size of the table, over all rows.

    Splits add up dense arrays and hand on what is not zero; the driver gets a byte for each slot of the table, whose size is fixed.
    """
    size = 1 << bits

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            slots, many = np.unique(pc.list_flatten(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64) & (size - 1), return_counts=True)
            total[slots] += many
        slots = np.flatnonzero(total)
        for at in range(0, len(slots), 100_000):
            part = slots[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["slot", "n"])

    sums = vectors.select(column).mapInArrow(count, "slot int, n bigint").groupBy("slot").agg(F.round(F.log2(F.sum("n")) * LEVELS).cast("int").alias("level")).toArrow()
    out = np.zeros(size, np.uint8)
    out[sums["slot"].to_numpy()] = np.minimum(sums["level"].to_numpy(), 255)
    return out


def masses(levels: np.ndarray) -> np.ndarray:
    """Squared weight by level, from 1 down to more than 2/3."""
    return 1 - levels / (3 * 256)


class _Ordered:
    """Terms of texts whose words lie one after another in flat, heaviest first within each text."""

    def __init__(self, lengths: np.ndarray, flat: np.ndarray, table: np.ndarray, share: float):
        start = np.concatenate(([0], np.cumsum(lengths)))[:-1].astype(np.int64)
        row = np.repeat(np.arange(len(lengths)), lengths)
        order = np.lexsort((flat, row))
        r, w = row[order], flat[order]
        new = np.concatenate(([True], (r[1:] != r[:-1]) | (w[1:] != w[:-1]))) if len(w) else np.zeros(0, bool)
        nth = np.arange(len(w)) - np.maximum.accumulate(np.where(new, np.arange(len(w)), 0))
        once = new & np.concatenate((new[1:], [True])) if len(w) else new
        term = _mix(w.astype(np.uint32).astype(np.uint64) | (nth.astype(np.uint64) << np.uint64(32)))
        place = order - start[r]
        level = table[w.astype(np.int64) & (len(table) - 1)]
        by = np.lexsort((term, level, r))
        self.row, self.term, self.place, self.once = r, term[by], place[by], once[by]
        self.mass = masses(level[by])
        self.lengths, self.start = lengths, start
        upto = np.concatenate(([0.0], np.cumsum(self.mass)))
        self.before = upto[:-1] - upto[start[r]] if len(r) else np.zeros(0)
        self.total = upto[start + lengths] - upto[start]
        self.missing = lengths - np.ceil(share * lengths - 1e-9).astype(np.int64)
        self.spare = self.heaviest(self.missing)
        self.need = self.total - self.spare

    def heaviest(self, many) -> np.ndarray:
        """Mass of so many of the heaviest words of each text."""
        upto = np.concatenate(([0.0], np.cumsum(self.mass)))
        return upto[self.start + np.minimum(many, self.lengths)] - upto[self.start]


def list_keys(lengths: np.ndarray, flat: np.ndarray, table: np.ndarray, share: float, k: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, 64-bit key and info of every inverted list entry of the texts.

    info: n, need and bound as parts of n, the places of the first two words of the set, and whether each stands once in
    its text (15, 11, 11, 12, 12, 1, 1 bits); n stops at SATURATED, which fits anything.
    """
    x = _Ordered(lengths, flat, table, share)
    # fewer than k common words among the first p have at most the k - 1 largest masses, and what follows at most the residual norm
    keep = x.before <= (x.heaviest(k - 1) + x.spare)[x.row] + 1e-9
    r, term, mass, behind = x.row[keep], x.term[keep], x.mass[keep], (x.total[x.row] - x.before - x.mass)[keep]
    place, once = np.minimum(x.place[keep], FAR), x.once[keep] & (x.place[keep] < FAR)
    n = np.maximum(lengths, 1)
    fixed = (np.minimum(lengths, SATURATED) << 48) | (np.floor(np.clip(x.need / n, 0, 1) * PARTS).astype(np.int64) << 37)
    most = int(np.bincount(r).max()) if len(r) else 1
    rows, keys, infos = [], [], []
    sets = [(np.arange(len(r)), np.arange(len(r)), np.arange(len(r)), term, mass)]  # first, second and last word, key, mass
    for size in range(1, k):
        longer = []
        for first, second, last, key, held in sets:
            for d in range(1, most):
                i = np.flatnonzero(last + d < len(r))
                i = i[r[last[i] + d] == r[first[i]]]
                if not len(i):
                    break
                at = last[i] + d
                longer.append((first[i], at if size == 1 else second[i], at, _mix(key[i] * np.uint64(0x9E3779B97F4A7C15) + term[at]), held[i] + mass[at]))
        sets = longer
    for first, second, last, key, held in sets:
        t = r[first]
        bound = np.ceil(np.clip((held + behind[last]) / n[t], 0, 1) * PARTS - 1e-9).astype(np.int64)
        infos.append(fixed[t] | (bound << 26) | (place[first] << 14) | (place[second] << 2) | (once[first].astype(np.int64) << 1) | once[second])
        rows.append(t), keys.append(key)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(infos)


def set_size(features: DataFrame, table: np.ndarray, n: int, share: float, least: int, sample: int = 2000, most: float = 1.0) -> int:
    """2, or 3 if texts would meet more than `most` others by chance per list entry of two words; fewer if the shortest texts need fewer.

    Judged from the words of a bounded random sample (smallest hashes); it decides how much is compared and not what is found.
    """
    met, entries = 0.0, 0
    for x in features.select("words").orderBy(F.xxhash64("rep")).limit(sample).collect():
        c = np.sort(2.0 ** (table[np.asarray(x["words"], np.int64) & (len(table) - 1)] / LEVELS))
        c = c[: len(c) - math.ceil(share * len(c)) + 2]
        met += (c.sum() ** 2 - (c * c).sum()) / 2 / max(n, 1)
        entries += len(c) * (len(c) - 1) // 2
    return max(1, min(2 if met <= most * max(entries, 1) else 3, math.ceil(share * least - 1e-9)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, one big-integer step per item of b."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _entries(features: DataFrame, levels, share: float, k: int) -> DataFrame:
    def run(batches):
        table = np.frombuffer(levels.value, np.uint8)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                words = part.column(1)
                lengths = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
                rows, keys, infos = list_keys(lengths, pc.list_flatten(words).to_numpy(zero_copy_only=False), table, share, k)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), part.column(0).take(pa.array(rows)), pa.array(infos)], names=["list", "rep", "info"])

    return features.select("rep", "words").mapInArrow(run, "list bigint, rep bigint, info bigint")


def _may_match(a, b, share: float):
    """Condition on the infos of two entries of one list."""

    def bits(x, at, mask):
        return F.shiftright(x, at).bitwiseAND(mask)

    na, nb = F.shiftright(a, 48), F.shiftright(b, 48)
    longer, shorter = F.greatest(na, nb), F.least(na, nb)
    slack = (1 - share) * longer + 1e-9
    needs, bounds = ([n * bits(x, at, PARTS) for x, n in ((a, na), (b, nb))] for at in (37, 26))
    at = [(bits(x, 14, FAR), bits(x, 2, FAR)) for x in (a, b)]
    both = a.bitwiseAND(b)
    first, second = both.bitwiseAND(2) == 2, both.bitwiseAND(1) == 1
    return (longer == SATURATED) | (
        (shorter >= share * longer - 1e-9)
        & (F.least(*bounds) >= F.greatest(*needs))
        & (~first | (F.abs(at[0][0] - at[1][0]) <= slack))
        & (~second | (F.abs(at[0][1] - at[1][1]) <= slack))
        & (~(first & second) | ((at[0][0] < at[0][1]) == (at[1][0] < at[1][1])))
    )


def cross_split(texts: DataFrame, splits: DataFrame, key: str, text: str, split: str, train: str = "train", share: float = 0.85, least: int = 8) -> tuple[DataFrame, DataFrame]:
    """Class pairs and members of the texts that stand in train and in another split.

    splits: key and split; a key may repeat with the same split, null splits are left out. Returns
    (pairs: rep_a, rep_b; equal if train and another split hold one class, members: key, rep, split).
    A class is named by the smallest key of its members.
    """
    spark = texts.sparkSession
    vectors = stage(word_vectors(texts, key, text, least), "words")
    split_of = splits.select(F.col(key).cast("bigint").alias("key"), F.col(split).alias("split")).dropna().distinct()
    members = vectors.select("key", "class").join(split_of, "key")
    in_train, in_other = F.max(F.col("split") == train), F.max(F.col("split") != train)
    classes = members.groupBy("class").agg(F.min("key").alias("rep"), in_train.alias("in_train"), in_other.alias("in_other"))
    members = stage(members.join(classes.select("class", "rep"), "class").select("key", "rep", "split").distinct(), "members")
    reps = classes.select(F.col("rep").alias("key"), "in_train", "in_other")
    features = stage(vectors.select("key", "words").join(reps, "key").select(F.col("key").alias("rep"), "in_train", "in_other", "words"), "features")
    table = word_levels(features)
    k = set_size(features, table, features.count(), share, least)
    levels = spark.sparkContext.broadcast(table.tobytes())

    a = _entries(features.where("in_train"), levels, share, k).toDF("list", "rep_a", "info_a")
    b = _entries(features.where("in_other"), levels, share, k).toDF("list", "rep_b", "info_b")
    found = a.join(b, "list").where((F.col("rep_a") != F.col("rep_b")) & _may_match(F.col("info_a"), F.col("info_b"), share))
    found = stage(found.select(F.least("rep_a", "rep_b").alias("rep_a"), F.greatest("rep_a", "rep_b").alias("rep_b")).distinct(), "candidates")
    ends = stage(found.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).distinct(), "ends")
    words = stage(features.select("rep", "words").join(small(ends, MAX_BROADCAST_ROWS), "rep"), "compared")

    def verify(batches):
        table = np.frombuffer(levels.value, np.uint8)
        for batch in batches:
            near = np.flatnonzero(similar(batch.column(2), batch.column(3), table, share))
            some = batch.take(pa.array(near))
            ok = [common_subsequence(x, y) >= share * max(len(x), len(y)) - 1e-9 for x, y in zip(some.column(2).to_pylist(), some.column(3).to_pylist())]
            yield some.select(["rep_a", "rep_b"]).filter(pa.array(ok, pa.bool_()))

    def confirm(batches):
        for batch in batches:
            ok = [common_subsequence(x, y) >= share * max(len(x), len(y)) - 1e-9 for x, y in zip(*([words_of(t) for t in batch.column(c).to_pylist()] for c in (2, 3)))]
            yield batch.select(["rep_a", "rep_b"]).filter(pa.array(ok, pa.bool_()))

    found = _with_both(found, words, "words").mapInArrow(verify, "rep_a bigint, rep_b bigint")
    found = stage(found, "alike")
    whole = texts.select(F.col(key).cast("bigint").alias("rep"), F.col(text).cast("string").alias("text"))
    whole = stage(whole.join(small(stage(found.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).distinct(), "ends"), MAX_BROADCAST_ROWS), "rep"), "confirmed")
    pairs = _with_both(found, whole, "text").mapInArrow(confirm, "rep_a bigint, rep_b bigint").distinct()
    same = features.where("in_train and in_other").select(F.col("rep").alias("rep_a"), F.col("rep").alias("rep_b")).distinct()
    return stage(pairs.unionByName(same), "pairs"), members


def _with_both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """rep_a, rep_b and the column of table (rep, column) for both."""
    out = pairs.join(table.toDF("rep_a", "of_a"), "rep_a").join(table.toDF("rep_b", "of_b"), "rep_b")
    return out.select("rep_a", "rep_b", F.col("of_a").alias(f"{column}_a"), F.col("of_b").alias(f"{column}_b"))


def similar(x: pa.ListArray, y: pa.ListArray, table: np.ndarray, share: float) -> np.ndarray:
    """Whether the dot product of the vectors of each pair of word lists reaches the need of both."""

    def counted(lists):
        n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        words = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
        return _Ordered(n, words, table, share).need, *np.unique((np.repeat(np.arange(len(n)), n) << 32) | words.astype(np.uint32), return_counts=True)

    (need_x, kx, cx), (need_y, ky, cy) = counted(x), counted(y)
    _, i, j = np.intersect1d(kx, ky, assume_unique=True, return_indices=True)
    slot = kx[i].astype(np.uint32).astype(np.int64) & (len(table) - 1)
    dot = np.bincount(kx[i] >> 32, np.minimum(cx[i], cy[j]) * masses(table[slot]), len(need_x))[: len(need_x)]
    return dot >= np.maximum(need_x, need_y) - 1e-6


def member_pairs(pairs: DataFrame, members: DataFrame, train: str = "train") -> DataFrame:
    """id_train, id_other, split: every pair of keys of which one is in train and the other in another split."""
    a = members.where(F.col("split") == train).select(F.col("key").alias("id_train"), F.col("rep").alias("r_train"))
    b = members.where(F.col("split") != train).select(F.col("key").alias("id_other"), F.col("rep").alias("r_other"), "split")
    both = pairs.select(F.col("rep_a").alias("r_train"), F.col("rep_b").alias("r_other")).unionByName(pairs.where("rep_a <> rep_b").select(F.col("rep_b").alias("r_train"), F.col("rep_a").alias("r_other")))
    return both.join(a, "r_train").join(b, "r_other").select("id_train", "id_other", "split")


def links(pairs: DataFrame, members: DataFrame, train: str = "train") -> DataFrame:
    """key, split, class_id and n_links of every key: the keys across the splits (train or not) it is linked with."""
    members = members.withColumn("side", F.col("split") == train)
    sizes = members.groupBy("rep", "side").agg(F.count("*").alias("n"))
    both = pairs.select("rep_a", "rep_b").unionByName(pairs.where("rep_a <> rep_b").select(F.col("rep_b").alias("rep_a"), F.col("rep_a").alias("rep_b")))
    linked = both.join(sizes.toDF("rep_b", "other", "n"), "rep_b").groupBy(F.col("rep_a").alias("rep"), (~F.col("other")).alias("side")).agg(F.sum("n").alias("n_links"))
    return members.join(linked, ["rep", "side"], "left").select("key", "split", F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
