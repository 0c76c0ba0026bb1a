"""Token ids of whole texts by a byte-level BPE vocabulary file.

Texts of up to chunk_chars characters are encoded where they are. Longer ones are cut into overlapping
chunks that are pre-tokenised in parallel. Within the overlap of two chunks the first position at which
both have a pre-token boundary is where the later chunk has resynchronised; there the text is cut. The
pieces between cuts are encoded in parallel and their ids joined in order. Where the boundaries of an
overlap never meet, the text stays whole from the chunk before on, so the result is always that of the
text in one piece. Null and empty texts have no ids: the empty list.
"""

from __future__ import annotations

import base64
import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterloom.session import stage

TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the published pattern that splits text before the merges of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK_CHARS = 8192
OVERLAP_CHARS = 512

_ENCODERS: dict[str, object] = {}


def vocabulary(spark: SparkSession, directory: str = TOKENIZER_DIR, name: str = VOCABULARY):
    """The vocabulary file as a broadcast; it is read on the driver and has a fixed size (below 1 MB)."""
    with open(os.path.join(directory, name), "rb") as f:
        return spark.sparkContext.broadcast((name, f.read()))


def encoder(shipped):
    """Encoder of a broadcast vocabulary, built once per worker process."""
    import tiktoken

    name, data = shipped.value
    if name not in _ENCODERS:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        _ENCODERS[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[name]


def boundaries(text: str, begin: int, end: int) -> list[int]:
    """Starts of pre-tokens of text within [begin, end) that follow no blank, but for 0 and the last, which may be cut short.

    A blank before a cut would be split otherwise at the end of a piece than before more text.
    """
    import regex

    global _PRE
    _PRE = _PRE or regex.compile(PATTERN)
    starts = [m.start() for m in _PRE.finditer(text)]
    return [p for p in starts[1:-1] if begin <= p < end and not text[p - 1].isspace()]


_PRE = None


def _encode(df: DataFrame, keys: str, shipped, count_only: bool) -> DataFrame:
    """df has the columns of keys and then text."""
    names = [k.split()[0] for k in keys.split(", ")]

    def run(batches):
        enc = encoder(shipped)
        for batch in batches:
            ids = [enc.encode_ordinary(t) if t else [] for t in batch.column(len(names)).to_pylist()]
            out = pa.array([len(x) for x in ids], pa.int64()) if count_only else pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], out], names=[*names, "n_tokens" if count_only else "ids"])

    return df.mapInArrow(run, f"{keys}, " + ("n_tokens bigint" if count_only else "ids array<int>"))


def _pieces(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """id, piece, text of the texts longer than chunk: consecutive pieces that start at pre-token boundaries."""
    chunks = long.select("id", F.posexplode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(chunk))).alias("c", "at"), "text")
    chunks = chunks.select("id", "c", "at", F.substring(F.col("text"), F.col("at") + 1, F.lit(chunk + overlap)).alias("text"))

    def scan(batches):
        for batch in batches:
            rows = [(boundaries(t, 0, overlap), boundaries(t, chunk, chunk + overlap)) for t in batch.column("text").to_pylist()]
            head = [[at + p for p in h] for at, (h, _) in zip(batch.column("at").to_pylist(), rows)]
            tail = [[at + p for p in x] for at, (_, x) in zip(batch.column("at").to_pylist(), rows)]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("c"), pa.array(head, kind), pa.array(tail, kind)], names=["id", "c", "head", "tail"])

    marks = stage(chunks.mapInArrow(scan, "id bigint, c int, head array<int>, tail array<int>"), "marks")
    later = marks.select("id", (F.col("c") - 1).alias("c"), F.col("head").alias("next"))
    cuts = marks.join(later, ["id", "c"]).select("id", "c", F.array_min(F.array_intersect("tail", "next")).alias("cut"))
    good = cuts.groupBy("id").agg(F.min(F.when(F.col("cut").isNull(), F.col("c"))).alias("bad"), F.sort_array(F.collect_list(F.struct("c", "cut"))).alias("cuts"))
    good = good.select("id", F.expr("transform(filter(cuts, x -> bad is null or x.c < bad), x -> x.cut)").alias("cuts"))
    whole = long.join(good, "id", "left").select("id", "text", F.concat(F.array(F.lit(0)), F.coalesce("cuts", F.array().cast("array<int>")), F.array(F.length("text"))).alias("cuts"))
    piece = F.expr("transform(sequence(1, size(cuts) - 1), i -> struct(cuts[i - 1] as a, cuts[i] as b))")
    return whole.select("id", "text", F.posexplode(piece).alias("piece", "p")).select("id", "piece", F.expr("substring(text, p.a + 1, p.b - p.a)").alias("text"))


def encode(df: DataFrame, key: str, text: str, count_only: bool = False, directory: str = TOKENIZER_DIR, name: str = VOCABULARY, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """key and ids (array<int>), or key and n_tokens, of every row. key is a bigint column; keys of long texts have to be unique."""
    shipped = vocabulary(df.sparkSession, directory, name)
    slim = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    is_long = F.coalesce(F.length("text"), F.lit(0)) > chunk_chars
    short = _encode(slim.where(~is_long), "id bigint", shipped, count_only)
    parts = _encode(_pieces(slim.where(is_long), chunk_chars, overlap_chars), "id bigint, piece int", shipped, count_only)
    if count_only:
        joined = parts.groupBy("id").agg(F.sum("n_tokens").alias("n_tokens"))
    else:
        joined = parts.groupBy("id").agg(F.expr("flatten(transform(sort_array(collect_list(struct(piece, ids))), x -> x.ids))").alias("ids"))
    return short.unionByName(joined).withColumnRenamed("id", key)


def decode(ids: DataFrame, key: str, column: str = "ids", directory: str = TOKENIZER_DIR, name: str = VOCABULARY) -> DataFrame:
    """key and text: the tokens' bytes, joined and read as UTF-8."""
    shipped = vocabulary(ids.sparkSession, directory, name)

    def run(batches):
        enc = encoder(shipped)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else enc.decode_bytes(x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()], pa.string())], names=[key, "text"])

    return ids.select(key, column).mapInArrow(run, f"{key} bigint, text string")
