"""One form for texts that look the same but hold different characters.

plain() is the table: canonical decomposition, plain letters for wide, styled and joined forms and for
look-alikes of other scripts, nothing for what is invisible, one blank for every kind of blank. Case,
accents and visible marks stay, and each blank stays one blank.

canonical_texts() is the corpus operator. The vocabulary is every token of the corpus that is already
ordinary (one script, composed, nothing invisible); it is kept in tries whose edges are its characters as
they stand. Tokens that are not ordinary, or that read as plain letters throughout, go through a trie as
typed with a weighted edit automaton: an edge that looks like the character read costs nothing, neither
does reading past an ignorable or reading a joined form as its letters; any other edit costs 1. Texts that
look the same are asked for, so the corpus run allows no cost: the canonical spelling is a vocabulary token
reached at cost zero, the form in plain letters first, then the most frequent. Tokens that reach none take
the form of the table. The tries are sharded by a hash of the plain form, which tokens that look the same
share, and there are as many shards as keep each below a fixed number of words.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterloom.session import stage

# Plain character, then the characters of other scripts that look like it.
LOOKALIKES = """
A АΑ
B ВΒ
C СϹ
E ЕΕ
G Ԍ
H НΗ
I ІΙ
J ЈͿ
K КΚ
M МΜϺ
N Ν
O ОΟ
P РΡ
Q Ԛ
S Ѕ
T ТΤ
W Ԝ
X ХΧ
Y ҮΥ
Z Ζ
a а
c сϲ
d ԁ
e е
h һհ
i і
j јϳ
l ӏ
n ո
o оοօ
p рρ
q ԛ
s ѕ
u ս
v ν
w ԝ
x х
y у
- ‐‑
"""

# Compatibility forms that look like the plain characters they stand for.
SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")
LINE_ENDS = "\n\x0b\x0c\r\x85\u2028\u2029"
BLANK_LETTERS = "\u2800\u3164\uFFA0\u115F\u1160"
INVISIBLE_MARKS = "\u034F\u180B\u180C\u180D\u180E\u180F"
VISIBLE_FORMATS = "\u0600\u0601\u0602\u0603\u0604\u0605\u06DD\u070F\u0890\u0891\u08E2"
JOINED_EMOJI = re.compile("(?<=[\u2600-\u27BF\uFE0F\U0001F000-\U0001FAFF])\u200D(?=[\u2600-\u27BF\U0001F000-\U0001FAFF])")
JOINER = "\U0010fffd"


class _Table(dict):
    """Code point to plain text, None for what is invisible; filled as code points are met."""

    def __missing__(self, cp: int):
        c = chr(cp)
        kind = unicodedata.category(c)
        if c == JOINER:
            out = "\u200D"
        elif c in LINE_ENDS:
            out = "\n"
        elif kind == "Zs" or c == "\t" or c in BLANK_LETTERS:
            out = " "
        elif kind in ("Cf", "Cc") and c not in VISIBLE_FORMATS or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or c in INVISIBLE_MARKS:
            out = None
        else:
            out = c
            tag, _, rest = unicodedata.decomposition(c).partition(" ")
            if tag in SAME_LOOK or tag == "<compat>" and kind[0] == "L":
                out = "".join(self[int(x, 16)] or "" for x in rest.split())
        self[cp] = out
        return out


TABLE = _Table({ord(c): line[0] for line in LOOKALIKES.split("\n") if line for c in line[2:]})
BLANK = re.compile("[ \n\t\x0b\x0c\r\x85\xa0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\u2800\u3164\uFFA0\u115F\u1160]")
ORDINARY_ASCII = re.compile(r"[ -~\n]*")


def plain(text: str) -> str:
    """text in plain characters, blank by blank; ends are not trimmed."""
    if text.isascii() and ORDINARY_ASCII.fullmatch(text):
        return text
    text = text.replace("\r\n", "\n")
    if "\u200D" in text:
        text = JOINED_EMOJI.sub(JOINER, text)
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(TABLE))


_SCRIPTS: dict[str, str] = {}


def _script(c: str) -> str:
    """Script of a letter, empty for other characters."""
    s = _SCRIPTS.get(c)
    if s is None:
        s = _SCRIPTS[c] = unicodedata.name(c, "?").split(" ")[0] if unicodedata.category(c)[0] == "L" else ""
    return s


ALIKE_SCRIPTS = {"LATIN", "CYRILLIC", "GREEK", "ARMENIAN"}


def ordinary(token: str, plain_token: str) -> bool:
    """True if token is written as it would be typed: letters of one of the scripts that look alike, composed, nothing invisible or wide."""
    scripts = ALIKE_SCRIPTS.intersection(map(_script, token))
    if len(scripts) > 1:
        return False
    if token == plain_token:
        return True
    if not unicodedata.is_normalized("NFC", token) or not scripts or scripts == {"LATIN"}:
        return False
    return all(isinstance(m := TABLE[ord(c)], str) and len(m) == 1 and (m == c or _script(c)) for c in unicodedata.normalize("NFD", token)) and not any(
        unicodedata.decomposition(c).startswith("<") for c in token
    )


def units(token: str) -> list[tuple[str, str | None]]:
    """Decomposed characters of token as typed, each with the plain characters it looks like, None if it does not show."""
    if "\u200D" in token:
        token = JOINED_EMOJI.sub(JOINER, token)
    chars = unicodedata.normalize("NFD", token)
    if any(TABLE[ord(c)] is None and unicodedata.combining(d) for c, d in zip(chars, chars[1:])):
        # an ignorable between a letter and its marks would keep the marks out of order
        chars = unicodedata.normalize("NFD", "".join(c for c, d in zip(chars, [*chars[1:], ""]) if not (TABLE[ord(c)] is None and d and unicodedata.combining(d))))
    return [(c, None if (p := TABLE[ord(c)]) is None else unicodedata.normalize("NFD", p)) for c in chars]


class Trie:
    """Vocabulary trie whose edges are characters as they stand in the words; node: {char: node}, words at key None."""

    def __init__(self, words: Iterable[str]):
        self.root: dict = {}
        self.alike: dict[str, list[str]] = {}  # edges by the plain characters they look like
        for w in words:
            node = self.root
            for c, p in units(w):
                if p is None:
                    continue
                if c not in (same := self.alike.setdefault(p, [])):
                    same.append(c)
                node = node.setdefault(c, {})
            node.setdefault(None, []).append(w)

    def near(self, token: str, most: int = 0) -> Iterator[tuple[int, str]]:
        """(cost, word) of the vocabulary words within cost most of token.

        Taking an edge that looks like the character read, passing an ignorable and reading a joined form
        as its letters cost 0; any other insertion, deletion or substitution costs 1. A word may come more
        than once.
        """
        read = units(token)
        todo = [(self.root, 0, "", 0)]  # node, characters read, what is left of a joined form, cost
        while todo:
            node, i, rest, cost = todo.pop()
            if not rest:
                while i < len(read) and read[i][1] is None:
                    i += 1
                if i == len(read):
                    for w in node.get(None, ()):
                        yield cost, w
                else:
                    rest, i = read[i][1], i + 1
            if rest:
                # the whole form as one edge of the same look, or its first letter
                for part in {rest, rest[0]}:
                    for c in self.alike.get(part, ()):
                        if (step := node.get(c)) is not None:
                            todo.append((step, i, rest[len(part) :], cost))
            if cost < most:
                if rest:
                    todo.append((node, i, rest[1:], cost + 1))
                for c, step in node.items():
                    if c is not None:
                        todo.append((step, i, rest, cost + 1))
                        if rest and c not in self.alike.get(rest[0], ()):
                            todo.append((step, i, rest[1:], cost + 1))


def digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


FLUSH = 400_000
SHARD_WORDS = 100_000
_SCAN = "kind int, fld string, id bigint, raw binary, canon binary, text string, need array<string>, token string, plain string, ordinary boolean, n bigint"


def _scan(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pd.DataFrame]:
    """Rows of kind 0 are texts, rows of kind 1 are tokens with their number in this split."""
    names = [c.split()[0] for c in _SCAN.split(", ")]
    seen: Counter = Counter()
    known: dict[str, tuple[str, bool]] = {}

    def tokens():
        out = [(1, None, None, None, None, None, None, t, *(known[t] if t in known else (t, True)), n) for t, n in seen.items()]
        seen.clear()
        known.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out) if out else [[]] * len(names), _ARROW)], schema=_ARROW)

    for batch in batches:
        out = []
        for fld, key, text, raw in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if text is None:
                continue
            words = BLANK.split(text)
            seen.update(words)
            need, form = [], text
            if not (text.isascii() and ORDINARY_ASCII.fullmatch(text)):
                for w in set(words):
                    if w.isascii() and ORDINARY_ASCII.fullmatch(w):
                        continue
                    if w not in known:
                        p = plain(w)
                        known[w] = (p, ordinary(w, p))
                    p, good = known[w]
                    if not good or p != w and p.isascii():
                        need.append(w)
                form = None if need else respell(text, {})
            out.append((0, fld, key, raw, None if form is None else digest(form.strip(" \n")), text if form is None else (form.strip(" \n") if keep else None), need or None, None, None, None, None))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _ARROW)], schema=_ARROW)
        if len(seen) > FLUSH:
            yield tokens()
    if seen:
        yield tokens()


_ARROW = pa.schema(
    [
        ("kind", pa.int32()), ("fld", pa.string()), ("id", pa.int64()), ("raw", pa.binary()), ("canon", pa.binary()), ("text", pa.string()),
        ("need", pa.list_(pa.string())), ("token", pa.string()), ("plain", pa.string()), ("ordinary", pa.bool_()), ("n", pa.int64()),
    ]
)


def respell(text: str, spelling: dict[str, str]) -> str:
    """text with its tokens as spelled in spelling and its blanks as ordinary blanks."""
    text = text.replace("\r\n", "\n")
    words = BLANK.split(text)
    gaps = ["\n" if c in LINE_ENDS else " " for c in BLANK.findall(text)]
    return "".join(spelling.get(w, w) + g for w, g in zip(words, [*gaps, ""]))


def _match(asked: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
    """Canonical spelling of each asked token that is not its own."""
    trie = Trie(words["word"])
    count = dict(zip(words["word"], words["seen"]))
    out = []
    for token, form in zip(asked["token"], asked["plain"]):
        best = min((w for _, w in trie.near(token)), key=lambda w: (w != form, -count[w], w), default=form)
        if best != token:
            out.append((token, best))
    return pd.DataFrame(out, columns=["token", "spelling"])


def canonical_texts(df: DataFrame, fld: str, key: str, text: str, keep: bool = False) -> DataFrame:
    """fld, id, raw (MD5 of the text), canon (digest of its canonical form) and, if keep, canonical_text.

    fld: column that names the text's field, passed through. key: bigint column, passed through as id; it
    need not be unique if fld and key together with repeated rows have equal texts. Null texts are left
    out; empty, blank and invisible texts have the canonical form ''. Blanks at the ends do not show and
    are dropped.
    """
    slim = df.select(F.col(fld).alias("fld"), F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).withColumn("raw", F.unhex(F.md5("text")))
    scan = stage(slim.mapInArrow(lambda b: _scan(b, keep), _SCAN), "lookalike", by="kind")
    rows = scan.where("kind = 0").select("fld", "id", "raw", "canon", "text", "need")
    tokens = stage(scan.where("kind = 1").groupBy("token", "plain", "ordinary").agg(F.sum("n").alias("n")), "tokens")
    asked = tokens.where("not ordinary or (plain <> token and plain rlike '^[\\\\x00-\\\\x7F]*$')")
    words = tokens.where("ordinary").select("plain", F.col("token").alias("word"), F.col("n").alias("seen"))
    shards = max(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), tokens.count() // SHARD_WORDS)
    shard = F.pmod(F.xxhash64("plain"), F.lit(shards)).alias("shard")
    spelling = (
        asked.select(shard, F.col("token").alias("token"), F.col("plain").alias("plain")).groupBy("shard")
        .cogroup(words.select(shard, "word", "seen").groupBy("shard"))
        .applyInPandas(_match, "token string, spelling string")
    )
    odd = rows.where("canon is null")
    found = (
        odd.select("fld", "id", "raw", F.explode("need").alias("token")).distinct().join(spelling, "token")
        .groupBy("fld", "id", "raw").agg(F.collect_list("token").alias("tokens"), F.collect_list("spelling").alias("spellings"))
    )

    def finish(batches):
        for batch in batches:
            forms = [respell(t, dict(zip(a or [], b or []))).strip(" \n") for t, a, b in zip(*(batch.column(c).to_pylist() for c in ("text", "tokens", "spellings")))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("fld"), batch.column("id"), batch.column("raw"), pa.array([digest(x) for x in forms], pa.binary()), pa.array(forms if keep else [None] * len(forms), pa.string())],
                names=["fld", "id", "raw", "canon", "canonical_text"],
            )

    mended = odd.drop("canon", "need").join(found, ["fld", "id", "raw"], "left").select("fld", "id", "raw", "text", "tokens", "spellings")
    mended = mended.mapInArrow(finish, "fld string, id bigint, raw binary, canon binary, canonical_text string")
    out = rows.where("canon is not null").select("fld", "id", "raw", "canon", F.col("text").alias("canonical_text")).unionByName(mended)
    return out if keep else out.drop("canonical_text")


EMPTY = digest("")


def same_look_pairs(texts: DataFrame) -> DataFrame:
    """Pairs of ids (id_a < id_b) whose texts have one canonical form and different characters.

    texts: result of canonical_texts on one field. Texts with nothing visible make no pair. Different texts
    of one form are paired first, each once; their ids are joined to these pairs, so a text with very many
    copies meets no other copy of itself.
    """
    classes, members = _look_classes(texts)
    lo, hi = classes.toDF("canon", "raw_a"), classes.toDF("canon", "raw_b")
    pairs = lo.join(hi, "canon").where("raw_a < raw_b").select("raw_a", "raw_b")
    ids = members.select("id", "raw").distinct()
    out = pairs.join(ids.toDF("i", "raw_a"), "raw_a").join(ids.toDF("j", "raw_b"), "raw_b").where("i <> j")
    return out.select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b")).distinct()


def _look_classes(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Canonical forms that more than one text has, with these texts (canon, raw), and the ids of the texts (id, raw, canon)."""
    shown = stage(texts.where(F.col("canon") != F.lit(EMPTY)).select("id", "raw", "canon"), "canon")
    forms = shown.groupBy("canon", "raw").agg(F.lit(1).alias("one")).drop("one")
    mixed = shown.groupBy("canon").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("canon")
    classes = stage(forms.join(mixed, "canon").select("canon", "raw"), "look-classes")
    return classes, shown.join(classes.select("raw"), "raw", "left_semi")


def look_links(texts: DataFrame) -> DataFrame:
    """id, class_id (hex of the form's digest) and n_links of every id whose text looks like another one's: the ids it makes a pair with."""
    _, members = _look_classes(texts)
    members = members.distinct()
    per_raw = members.groupBy("canon", "raw").agg(F.count("*").alias("n"))
    whole = per_raw.groupBy("canon").agg(F.sum("n").alias("all"))
    counted = per_raw.join(whole, "canon").select("raw", (F.col("all") - F.col("n")).alias("n_links"))
    return members.join(counted, "raw").select("id", F.hex("canon").alias("class_id"), "n_links")
