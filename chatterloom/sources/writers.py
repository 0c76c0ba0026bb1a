"""Writers: CSV tables, sharded JSON lines, JSON summaries, markdown."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_jsonl(df: DataFrame, path: str, shard_rows: int = 1000) -> None:
    df.write.mode("append").option("maxRecordsPerFile", shard_rows).json(path)


def write_summary(df: DataFrame, path: str) -> None:
    """The one row of df as a JSON object."""
    row = df.limit(2).collect()
    if len(row) != 1:
        raise ValueError("a summary has one row")
    Path(path).write_text(json.dumps(row[0].asDict(recursive=True), ensure_ascii=False, indent=2, default=str))


def markdown(df: DataFrame, max_rows: int = 1000, floats: str = "{:.4f}") -> str:
    """Markdown table of a small result; null is empty."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} rows")
    cell = lambda v: "" if v is None or v != v else floats.format(v) if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows])
