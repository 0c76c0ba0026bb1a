"""Map freely typed values to the entries of a reference list.

Distinct values are cut into tokens, and every distinct token is joined to the vocabulary of the list by
edit distance: both sides give the keys of their deletion neighbourhood (long words the keys of their
segments), tokens that share a key with a word are compared with it, and a cut-off word reaches those it
begins. Repaired tokens are weighted by their rarity in the list (soft TF-IDF) and entries ranked by the
agreement of both token sets; order does not count. A value that no entry agrees well with is taken as one
more token, its letters without blanks, and joined in the same way to the entries as runs of letters. A
value whose best agreement stays below the threshold means no entry.

Values, tokens, words and entries are tables and meet in joins, so neither the list nor the values have to
fit one task; a value that many rows repeat is mapped once.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterloom.llm.lookalike import plain
from chatterloom.session import small, stage

WORD = re.compile(r"[^\W_]+")
THRESHOLD = 0.6
SURE = 0.75
PREFIX = 3
LONG = 24
MAX_BROADCAST_ROWS = 500_000


def letters(text: str) -> str:
    """text in plain characters, without case and accents."""
    flat = unicodedata.normalize("NFD", plain(text).casefold())
    return "".join(c for c in flat if not unicodedata.combining(c))


def distance(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap neighbours) from a to b, or most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1]


def allowed(n: int) -> int:
    """Edits a word of n letters may be away."""
    return 0 if n < 3 else 1 if n < 6 else 2


def _deletions(word: str, most: int) -> Iterator[str]:
    for k in range(most + 1):
        for gone in combinations(range(len(word)), k):
            yield "".join(c for i, c in enumerate(word) if i not in gone)


def _key(kind: str, *parts) -> int:
    return xxhash.xxh64_intdigest("\0".join((kind, *map(str, parts))).encode("utf-8", "surrogatepass")) - (1 << 63)


def _segments(n: int, edits: int) -> list[tuple[int, int]]:
    """Start and end of the 2 * edits + 1 parts of a word of n letters; so many edits, swaps too, leave one part as it is."""
    parts = min(2 * edits + 1, n)
    cuts = [n * i // parts for i in range(parts + 1)]
    return [*zip(cuts, cuts[1:])]


def _segment_keys(kind: str, word: str, edits: int) -> set[int]:
    return {_key(kind, len(word), i, word[a:b]) for i, (a, b) in enumerate(_segments(len(word), edits))}


def _probe_keys(kind: str, text: str, n: int, edits: int) -> set[int]:
    """Keys under which a word of n letters within edits of text has one of its parts."""
    return {
        _key(kind, n, i, text[at : at + b - a]) for i, (a, b) in enumerate(_segments(n, edits)) for at in range(max(0, a - edits), min(len(text) - (b - a), a + edits) + 1)
    }


def word_keys(word: str) -> set[int]:
    """Keys of a vocabulary word: a token it may stand for has one of them."""
    most = allowed(len(word))
    near = {_key("d", d) for d in _deletions(word, most)} if len(word) <= LONG else _segment_keys("s", word, most)
    return near | {_key("p", word[:n]) for n in range(PREFIX, len(word))}


def token_keys(token: str, longest: int) -> set[int]:
    """Keys of a typed token. longest: length of the longest word."""
    out = {_key("p", token)} if PREFIX <= len(token) < longest else set()
    if len(token) <= min(LONG, longest) + 2:
        out |= {_key("d", d) for d in _deletions(token, allowed(len(token)))}
    for n in range(max(LONG + 1, len(token) - 2), min(longest, len(token) + 2) + 1):
        out |= _probe_keys("s", token, n, 2)
    return out


def token_similarity(token: str, word: str) -> float:
    """How well token stands for word, 0 if it does not."""
    if token == word:
        return 1.0
    longest = max(len(token), len(word))
    most = allowed(longest)
    k = distance(token, word, most)
    out = 1 - k / longest if k <= most else 0.0
    return max(out, 0.6 + 0.4 * len(token) / len(word)) if PREFIX <= len(token) < len(word) and word.startswith(token) else out


def _run_edits(n: int) -> int:
    return max(1, n // 5)


def whole_keys(whole: str) -> set[int]:
    """Keys of an entry as a run of letters."""
    cut_off = (whole[:n] for n in range(max(5, (len(whole) + 1) // 2), len(whole)))
    return _segment_keys("j", whole, _run_edits(len(whole))) | {_key("q", d) for x in cut_off for d in _deletions(x, 1)}


def run_keys(run: str, lengths: list[int]) -> set[int]:
    """Keys of a value as a run of letters. lengths: of all entries."""
    out = {_key("q", d) for d in _deletions(run, 1)} if 5 <= len(run) < max(lengths, default=0) else set()
    for n in lengths:
        if abs(n - len(run)) <= _run_edits(n):
            out |= _probe_keys("j", run, n, _run_edits(n))
    return out


def run_similarity(run: str, whole: str) -> float:
    """How well a value without blanks stands for an entry without blanks, 0 if it does not."""
    n, most = len(run), _run_edits(len(whole))
    if abs(n - len(whole)) <= most and (k := distance(run, whole, most)) <= most:
        return 1 - k / max(n, len(whole))
    if 5 <= n < len(whole) <= 2 * n and (k := distance(run, whole[:n], 1)) <= 1:
        return 0.85 - 0.1 * k
    return 0.0


def best_entry(tokens: list[dict]) -> tuple[float, int, int]:
    """Soft TF-IDF agreement, label_id and position of the entry that agrees best; ties go to the first entry.

    tokens: of one value, each with loose (the weight it has if the entry does not hold it) and hits on words
    of entries: label_id, pos, word, sim, weight, times (how often the entry holds the word), total (weight of the entry).
    """
    by_entry: dict[tuple[int, int], dict[int, dict]] = defaultdict(dict)
    for i, t in enumerate(tokens):
        for h in t["hits"] or ():
            mine = by_entry[h["label_id"], h["pos"]]
            if i not in mine or (h["sim"], h["word"]) > (mine[i]["sim"], mine[i]["word"]):
                mine[i] = h
    best = (0.0, 0, 0)
    for (label, pos), hits in by_entry.items():
        left: dict[str, int] = {}
        match, used = 0.0, set()
        for i, h in sorted(hits.items(), key=lambda x: (-x[1]["sim"], x[0])):
            if left.setdefault(h["word"], h["times"]):
                left[h["word"]] -= 1
                used.add(i)
                match += h["sim"] * h["weight"]
        extra = sum(t["loose"] for i, t in enumerate(tokens) if i not in used)
        score = math.sqrt(match / h["total"] * match / (match + extra)) if match else 0.0
        best = max(best, (score, -label, -pos))
    return best[0], -best[1], -best[2]


def _mapped(df: DataFrame, schema: str, rows) -> DataFrame:
    """df through rows(dict of a row) -> tuples of schema, a batch at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            out = [x for row in batch.to_pylist() for x in rows(row)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(kinds), kinds)], schema=kinds)

    return df.mapInArrow(run, schema)


def _joined_by_keys(tokens: DataFrame, words: DataFrame, keys_of_token, keys_of_word, similarity) -> DataFrame:
    """tag_field, token, word, sim of every token and word of one field whose similarity is not 0."""
    a = _mapped(tokens, "tag_field string, token string, key bigint", lambda r: [(r["tag_field"], r["token"], k) for k in keys_of_token(r["token"])])
    b = _mapped(words, "tag_field string, word string, key bigint", lambda r: [(r["tag_field"], r["word"], k) for k in keys_of_word(r["word"])])
    met = a.join(b, ["tag_field", "key"]).select("tag_field", "token", "word").distinct()
    return _mapped(met, "tag_field string, token string, word string, sim double", lambda r: [(r["tag_field"], r["token"], r["word"], s)] if (s := similarity(r["token"], r["word"])) > 0 else [])


def _entries(reference: DataFrame) -> DataFrame:
    """tag_field, label_id, pos (0 is the label, then its aliases), words and run of letters of every entry."""
    texts = F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = reference.select("tag_field", F.col("label_id").cast("int").alias("label_id"), F.posexplode(texts).alias("pos", "text")).where("text is not null")

    def cut(r):
        words = WORD.findall(letters(r["text"]))
        return [(r["tag_field"], r["label_id"], r["pos"], words, "".join(words))] if words else []

    return stage(_mapped(rows, "tag_field string, label_id int, pos int, words array<string>, run string", cut), "entries")


def _postings(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Words of entries with their weight (tag_field, word, weight, label_id, pos, times, total), and per field the weight of an unknown token."""
    count = entries.groupBy("tag_field").agg(F.count("*").alias("n_entries"))
    held = entries.select("tag_field", "label_id", "pos", F.explode("words").alias("word")).groupBy("tag_field", "label_id", "pos", "word").agg(F.count("*").alias("times"))
    weights = held.groupBy("tag_field", "word").agg(F.count("*").alias("n")).join(count, "tag_field").select("tag_field", "word", F.log(1 + F.col("n_entries") / F.col("n")).alias("weight"))
    weights = stage(weights, "word-weights")
    held = held.join(weights, ["tag_field", "word"])
    total = held.groupBy("tag_field", "label_id", "pos").agg(F.sum(F.col("weight") * F.col("times")).alias("total"))
    return stage(held.join(total, ["tag_field", "label_id", "pos"]), "postings"), weights.groupBy("tag_field").agg((0.3 * F.avg("weight")).alias("unknown"))


def meanings(values: DataFrame, reference: DataFrame) -> DataFrame:
    """value (digest of field and value), tag_field, tag_value, label_id of every distinct value that is not itself a label, 0 for none."""
    named = values.where(F.col("tag_value").rlike(r"(?U)\S")).select("tag_field", "tag_value").distinct()
    labels = reference.select("tag_field", F.col("label").alias("tag_value")).distinct()
    named = named.join(labels, ["tag_field", "tag_value"], "left_anti").withColumn("value", _digest())
    typed = stage(
        _mapped(named, "value binary, tag_field string, tag_value string, tokens array<string>", lambda r: [(r["value"], r["tag_field"], r["tag_value"], WORD.findall(letters(r["tag_value"])))]), "typed"
    )
    entries = _entries(reference)
    postings, unknown = _postings(entries)
    longest = postings.agg(F.max(F.length("word"))).first()[0] or 0
    each = typed.select("value", "tag_field", F.explode("tokens").alias("token"))
    vocabulary = postings.select("tag_field", "word").distinct()
    repairs = _joined_by_keys(each.select("tag_field", "token").distinct(), vocabulary, lambda t: token_keys(t, longest), word_keys, token_similarity)
    hit = F.struct("label_id", "pos", "word", "sim", "weight", "times", "total")
    hits = repairs.join(postings, ["tag_field", "word"]).groupBy("tag_field", "token").agg(F.max(F.col("sim") * F.col("weight")).alias("known"), F.collect_list(hit).alias("hits"))
    hits = stage(hits, "token-hits")
    each = each.join(unknown, "tag_field").join(hits, ["tag_field", "token"], "left").select("value", F.struct(F.coalesce("known", "unknown").alias("loose"), "hits").alias("token"))
    ranked = each.groupBy("value").agg(F.collect_list("token").alias("tokens"))
    ranked = stage(_mapped(ranked, "value binary, score double, label_id int, pos int", lambda r: [(r["value"], *best_entry(r["tokens"]))]), "ranked")
    unsure = ranked.where(F.col("score") < SURE).join(typed, "value").select("value", "tag_field", F.array_join("tokens", "").alias("token"))
    wholes = entries.select("tag_field", F.col("run").alias("word")).distinct()
    lengths = sorted(r[0] for r in wholes.select(F.length("word")).distinct().collect())
    runs = _joined_by_keys(unsure.select("tag_field", "token").distinct(), wholes, lambda t: run_keys(t, lengths), whole_keys, run_similarity)
    as_run = unsure.join(runs, ["tag_field", "token"]).join(entries.select("tag_field", F.col("run").alias("word"), "label_id", "pos"), ["tag_field", "word"]).select("value", F.col("sim").alias("score"), "label_id", "pos")
    best = ranked.unionByName(as_run).groupBy("value").agg(F.max(F.struct("score", (-F.col("label_id")).alias("l"), (-F.col("pos")).alias("p"))).alias("b"))
    label = F.when(F.col("b.score") >= THRESHOLD, -F.col("b.l")).otherwise(0).cast("int")
    return stage(typed.join(best, "value", "left").select("value", "tag_field", "tag_value", label.alias("label_id")), "meanings")


def _digest():
    return F.unhex(F.md5(F.concat_ws("\0", "tag_field", "tag_value")))


def map_to_list(values: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tag_field, label_id of every value that is not itself an entry, 0 for values that mean none.

    values: keys, tag_field, tag_value. reference: label_id, tag_field, label, aliases; aliases may be
    null. Null and blank values are left out; a row with several values of one meaning gives one row.
    Ties go to the entry that comes first by label_id. With an empty list every value means none.
    """
    values = values.select(*keys, "tag_field", F.col("tag_value").cast("string").alias("tag_value"))
    known = small(meanings(values, reference).select("value", "label_id"), MAX_BROADCAST_ROWS)
    return values.withColumn("value", _digest()).join(known, "value").select(*keys, "tag_field", "label_id").distinct()


def unmatched(values: DataFrame, reference: DataFrame) -> DataFrame:
    """tag_field, tag_value, n (rows) of every value that means no entry of its field."""
    none = meanings(values.select("tag_field", F.col("tag_value").cast("string").alias("tag_value")), reference).where("label_id = 0")
    counts = values.groupBy("tag_field", "tag_value").agg(F.count("*").alias("n")).withColumn("value", _digest())
    return counts.join(none.select("value"), "value").select("tag_field", "tag_value", "n")
