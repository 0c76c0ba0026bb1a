"""Copies of one record that differ only in blanks, letter case, punctuation or the order of named fields.

A record is a tree: its columns are ordered children. A column reads as an ordered leaf, its tokens; one that
names fields reads also as an unordered node over them: a JSON object, whose members may be objects again, or
two or more separated parts "name: value", "name = value" or "name - value", whose values may be fields in
braces. A part is cut off by a semicolon, bar, line end or comma not between digits; a name may have several
words; the text up to the next field belongs to the value. Words before the first field are the title of the
node, and fields of one name keep their order: together they are one child.

Digests are built bottom up: leaves are normalised, the child digests of an unordered node are sorted, and a
root digest stands for each reading. Beside its digest each tree has a canonical form that holds all of it.
Records are grouped by both, so equal digests are confirmed by comparing the whole structure. Marks strewn
into prose can look like fields, so for flat fields neither reading decides alone: two columns are the same
if their tokens are or their nodes are, and groups that share a reading are joined into components.

Equal rows combine before the shuffle, so a post with very many copies costs no task more than a row or so
from each split, and the first row of each post is sent to its copies, not the copies to it.

Tokens are words, numbers with the marks inside them, and symbols such as emoji and currency signs.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Sequence

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterloom.llm.related_splits import components
from chatterloom.session import small, stage

TOKEN = re.compile("\\d+(?:[^\\w\\s]+\\d+)*|[^\\W\\d_]+|[$\u00A2-\u00A5\u20A0-\u20CF\u2600-\u27BF\U0001F000-\U0001FAFF]")
PART = re.compile(r"[;\n|]|(?<!\d),|,(?!\d)")
MARK = re.compile(r"\s*[:=]\s*|\s+[-–—]\s+")
BULLET = re.compile(r"\s*[-–—•>]\s+")
CLOCK = re.compile(r"(?:^|\W)\d+$")
WRAPPING = str.maketrans("", "", "{}[]\"\u201C\u201D\u00AB\u00BB*")
MIN_FIELDS = 2
LEAF, NODE, FIELD, VALUES, END = "\x01", "\x02", "\x03", "\x04", "\x05"
MAX_BROADCAST_ROWS = 500_000

# a leaf is its tokens, a node its title and its fields: a name with the children of that name
Node = "str | tuple[str, list[tuple[str, list]]]"


def tokens(text: str) -> str:
    return " ".join(TOKEN.findall(text))


def name_and_value(part: str) -> tuple[str, str] | None:
    """Name and value of a part, as tokens, cut at its first mark; None if it names nothing."""
    at = BULLET.match(part)
    part = part[at.end() :] if at else part
    for m in MARK.finditer(part):
        if m.group() == ":" and (part[m.end() :].startswith("//") or part[m.end() : m.end() + 1].isdigit() and CLOCK.search(part[: m.start()])):
            continue
        name = tokens(part[: m.start()])
        return (name, tokens(part[m.end() :])) if name and not name[0].isdigit() else None
    return None


def _named(title: str, found: list[tuple[str, object]]) -> tuple:
    """Node of a title and fields, with the children of one name together in their order."""
    by_name: dict[str, list] = {}
    for name, child in found:
        by_name.setdefault(name, []).append(child)
    return title, [*by_name.items()]


def _parts(text: str) -> list[str]:
    """Separated parts of text; nothing separates inside braces that are balanced."""
    if "{" not in text:
        return PART.split(text)
    out, depth, start = [], 0, 0
    cuts = {m.start(): m.end() for m in PART.finditer(text)}
    for i, c in enumerate(text):
        depth += (c == "{") - (c == "}")
        if depth < 0:
            return PART.split(text)
        if depth == 0 and i in cuts:
            out.append(text[start:i])
            start = cuts[i]
    return PART.split(text) if depth else [*out, text[start:]]


def _inner(part: str):
    """Name and node of a part "name: {fields}", None if it is no such part."""
    at = part.find("{")
    if at < 0 or not part.rstrip().endswith("}") or not (head := MARK.search(part[:at])) or part[head.end() : at].strip():
        return None
    name = tokens(part[: head.start()])
    node = fields(part[at:], least=1) if name else None
    return (name, node) if node else None


def fields(text: str, titled: bool = False, least: int = MIN_FIELDS):
    """Node of the fields text names; None for fewer than `least`. text is casefolded.

    titled: read a first part "title: name: value" as words and a field; None if there is none.
    """
    if len(MARK.findall(text)) < least:
        return None
    text = text.strip()
    if text.startswith("{") and text.endswith("}"):
        text = text[1:-1]
    title, found = [], []
    for part in _parts(text):
        if (nested := _inner(part)) is not None:
            found.append([*nested])
            continue
        part = part.translate(WRAPPING)
        if (field := name_and_value(part)) is not None:
            if titled and not found:
                if title or (inner := _titled(part)) is None:
                    return None
                title.append(inner[0])
                field = inner[1]
            found.append([*field])
        elif words := tokens(part):
            if found and isinstance(found[-1][1], str):
                found[-1][1] = f"{found[-1][1]} {words}".strip()
            elif found:
                found.append(["", words])
            else:
                title.append(words)
    if len(found) < least:
        return None
    return _named(" ".join(title), found)


def _titled(part: str) -> tuple[str, tuple[str, str]] | None:
    """Title and field of a part "title: name: value"."""
    head, mark, rest = part.partition(":")
    field = name_and_value(rest) if mark and ":" in rest else None
    return (tokens(head), field) if field and tokens(head) else None


def json_node(text: str):
    """Node of a JSON object, None for other text. Lists keep their order: of values as one leaf, else as a node whose children have one name."""
    text = text.strip()
    if not (text.startswith("{") and text.endswith("}")):
        return None

    def tree(value):
        if isinstance(value, tuple):
            return _named("", [(tokens(n), tree(v)) for n, v in value])
        if isinstance(value, list):
            items = [tree(v) for v in value]
            return " ".join(items) if all(isinstance(x, str) for x in items) else _named("", [("", x) for x in items])
        return tokens({True: "true", False: "false", None: "null"}[value] if value is None or isinstance(value, bool) else value)

    try:
        value = json.loads(text, object_pairs_hook=tuple, parse_int=str, parse_float=str, parse_constant=str, strict=False)
    except (ValueError, RecursionError):
        return None
    return tree(value) if value else None


def _deep(node) -> bool:
    return not isinstance(node, str) and any(not isinstance(c, str) for _, children in node[1] for c in children)


def readings(text: str) -> list:
    """Trees of a column's value: its tokens, first, and each way it names fields.

    Records in records have no reading as tokens: which record a field belongs to is more than punctuation.
    """
    text = text.casefold()
    if (node := json_node(text)) is not None:
        named = [node]
    else:
        named = [n for n in (fields(text), fields(text, titled=True)) if n]
    return [n for n in named if _deep(n)][:1] or [tokens(text), *named]


def _hash(*parts: bytes) -> bytes:
    return xxhash.xxh3_128_digest(b"".join(parts))


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def digest(node) -> bytes:
    """Digest of a tree from those of its children; the order of a node's names does not count."""
    if isinstance(node, str):
        return _hash(b"L", _bytes(node))
    title, named = node
    return _hash(b"N", _hash(_bytes(title)), *sorted(_hash(_hash(_bytes(name)), *map(digest, children)) for name, children in named))


def form(node) -> str:
    """The whole tree as text, equal for equal trees only; tokens hold none of the marks it uses."""
    if isinstance(node, str):
        return LEAF + node
    title, named = node
    return NODE + title + "".join(FIELD + name + VALUES + "".join(map(form, children)) for name, children in sorted(named, key=lambda f: f[0])) + END


def root(nodes: Sequence) -> tuple[bytes, bytes]:
    """Digest and form of a record, whose columns are ordered."""
    return _hash(b"R", *map(digest, nodes)), _bytes("".join(map(form, nodes)))


_TREE = pa.struct([("root", pa.binary()), ("form", pa.binary())])


def trees(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """key, root and form of the tokens, and others: those of every other reading, null for none; columns may hold no null."""

    def run(batches):
        for batch in batches:
            roots, forms, others = [], [], []
            for values in zip(*(c.to_pylist() for c in batch.columns[1:])):
                first, *more = (root(nodes) for nodes in itertools.product(*map(readings, values)))
                roots.append(first[0])
                forms.append(first[1])
                others.append([{"root": r, "form": f} for r, f in more] or None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(roots, pa.binary()), pa.array(forms, pa.binary()), pa.array(others, pa.list_(_TREE))], names=["key", "root", "form", "others"])

    return df.select(F.col(key).cast("bigint").alias("key"), *[F.col(c).cast("string") for c in columns]).mapInArrow(
        run, "key bigint, root binary, form binary, others array<struct<root:binary,form:binary>>"
    )


def grouped(df: DataFrame, key: str, columns: Sequence[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows (key, root, form), their posts (root, form, kept_id, n_copies over all rows of the post), and the columns to join them by.

    These are the root alone, unless two different forms have one root.
    """
    rows = stage(trees(df, key, columns), "trees")
    exact = stage(rows.groupBy("root", "form").agg(F.min("key").alias("first"), F.count("*").alias("n")), "exact")
    doubled = exact.groupBy("root").agg(F.count("*").alias("forms")).where("forms > 1").limit(1).count()
    by = ["root", "form"] if doubled else ["root"]
    edges = rows.where("others is not null").select(*by, F.inline("others").alias("other", "as")).distinct().join(exact.select(*by, "first"), by).select("first", "other", "as")
    shared = edges.groupBy("other", "as").agg(F.min("first").alias("lo"), F.max("first").alias("hi")).where("lo <> hi").select("other", "as", "lo")
    links = edges.join(shared, ["other", "as"]).where("first <> lo").select(F.col("lo").cast("string").alias("u"), F.col("first").cast("string").alias("v"))
    moved = components(links).select(F.col("node").cast("bigint").alias("first"), F.col("root").alias("post"))
    groups = stage(exact.join(moved, "first", "left").select(*by, "first", "n", F.coalesce("post", F.col("first").cast("string")).alias("post")), "groups")
    kept = groups.groupBy("post").agg(F.min("first").alias("kept_id"), F.sum("n").alias("n_copies"))
    return rows, stage(groups.join(kept, "post").select(*by, "kept_id", "n_copies"), "posts"), by


def posts(df: DataFrame, key: str, columns: Sequence[str], required: str | None = None) -> DataFrame:
    """One row per record: kept_id (smallest key) and n_copies (all its rows).

    Rows with a null in one of columns, or a blank required column, are left out. Records without any
    token (only marks) are equal to each other if their other columns are. Exact repeats count.
    """
    return grouped(_usable(df, key, columns, required), key, columns)[1].select("kept_id", "n_copies").distinct()


def copies(df: DataFrame, key: str, columns: Sequence[str], required: str | None = None) -> DataFrame:
    """kept_id and copy_id: every row but the first of each record, with the first."""
    rows, kept, by = grouped(_usable(df, key, columns, required), key, columns)
    kept = small(stage(kept.where("n_copies > 1").select(*by, "kept_id"), "kept"), MAX_BROADCAST_ROWS)
    return rows.select("key", *by).join(kept, by).where("key <> kept_id").select("kept_id", F.col("key").alias("copy_id"))


def _usable(df: DataFrame, key: str, columns: Sequence[str], required: str | None) -> DataFrame:
    slim = df.select(key, *columns).dropna(subset=list(columns))
    return slim.where(F.col(required).rlike(r"(?U)\S")) if required else slim
