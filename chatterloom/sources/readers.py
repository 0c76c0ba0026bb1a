"""Readers of the inputs: CSV with header repair, xz CSV, JSON lines, JSON documents."""

from __future__ import annotations

import io
import lzma

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGES = "source string, msg_id string, channel string, message string, risk_label double, normalized_domain string, theme string, claim_types string, ctas string, evidence string"
RAW = "channel string, msg_id string, msg_date string, text string"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with header and quoted line ends; columns are taken by place, so a mangled first name does no harm."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def read_csv_xz(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """xz-compressed CSV files, one task a file, read in pieces; xz cannot be split, so convert large corpora to Parquet once."""
    names = [c.split()[0] for c in schema.split(", ")]

    def parse(batches):
        for pdf in batches:
            for blob in pdf["content"]:
                for part in pd.read_csv(io.TextIOWrapper(lzma.open(io.BytesIO(blob)), "utf-8"), dtype=str, chunksize=50_000, keep_default_na=False, na_values=[""]):
                    yield part.set_axis(names, axis=1)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, schema)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with file, start of the block and pos, so that the later record of an id can be told: ordered by these three, lines stand as in the sorted files."""
    return spark.read.schema(schema).json(path).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"))


def read_json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)
