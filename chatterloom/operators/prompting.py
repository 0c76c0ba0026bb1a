"""Prompts for a model that tags messages, and a pluggable client run over partitions."""

from __future__ import annotations

import html
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterloom.operators.annotation import RECORD

# Marks of the prompt format.
USER_HEAD = "message text:"
PAGE_HEAD = "\n\n--- Appended Web Content ---\n"
CUT_MARK = " [Content Truncated]"
PAGE_CHARS = 4000


def first_url(c: Column) -> Column:
    """First URL with a scheme, cut at the first character that cannot belong to it; null if there is none."""
    rough = F.regexp_extract(c, r'https?://[^\s<>"]+|www\.[^\s<>"]+', 0)
    clean = F.regexp_extract(rough, r"^https?://[a-zA-Z0-9/:._?=&%#~+,@-]+", 0)
    return F.nullif(clean, F.lit(""))


def search_results_wanted(c: Column) -> Column:
    """Results a fallback search should give: only texts with a URL, more for short ones."""
    return F.when(~c.contains("http"), 0).when(F.length(c) < 50, 3).when(F.length(c) < 100, 2).otherwise(0)


def chat(system: Column, text: Column) -> Column:
    return F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), F.concat(F.lit(USER_HEAD), text).alias("content")))


def prompt_and_label(messages: Column) -> tuple[Column, Column]:
    """All turns but the last, and the last one's content."""
    return F.slice(messages, 1, F.greatest(F.size(messages) - 1, F.lit(0))), F.element_at(messages, -1)["content"]


def with_page(messages: DataFrame, pages: DataFrame, text: str) -> DataFrame:
    """messages with the text of the page its first URL names appended, cut at 4000 characters. pages: url, content, one row a url."""
    page = pages.select(F.col("url").alias("_url"), F.col("content").alias("_content")).where("_content <> ''")
    joined = messages.withColumn("_first", first_url(F.col(text))).join(page, F.col("_first") == F.col("_url"), "left")
    body = F.when(F.length("_content") > PAGE_CHARS, F.concat(F.substring("_content", 1, PAGE_CHARS), F.lit(CUT_MARK))).otherwise(F.col("_content"))
    added = F.when(F.col("_content").isNotNull(), F.concat(F.col(text), F.lit(PAGE_HEAD), body)).otherwise(F.col(text))
    return joined.withColumn(text, added).drop("_first", "_url", "_content")


def page_text(markup: str | None) -> str:
    """Visible text of an HTML page, blank lines left out; pages that only ask for JavaScript have none."""
    if not markup or ("javascript" in markup.lower() and "disabled" in markup.lower()):
        return ""
    bare = re.sub(r"(?is)<(script|style|noscript|head)\b.*?</\1>|<!--.*?-->", " ", markup)
    lines = html.unescape(re.sub(r"(?s)<[^>]+>", "\n", bare)).split("\n")
    return "\n".join(x.strip() for x in lines if x.strip())


def call_with_retries(call: Callable[[], dict], attempts: int = 8, base_s: float = 1.0, most_s: float = 60.0, transient: tuple[type[Exception], ...] = (TimeoutError, ConnectionError), sleep: Callable[[float], None] = time.sleep) -> dict:
    """Result of call; transient errors are tried again after growing waits, others are raised."""
    for i in range(attempts):
        try:
            return call()
        except transient:
            if i + 1 == attempts:
                raise
            sleep(min(base_s * 2**i, most_s))
    raise ValueError("attempts must be positive")


def answer(prompts: DataFrame, make_client: Callable[[], Callable[[str], dict]], model: str) -> DataFrame:
    """A record per prompt (message_id, prompt); what the client raises is kept as the record's error.

    make_client builds one client a partition; concurrency is the number of partitions.
    """
    names = [c.split()[0] for c in RECORD.replace("usage struct<prompt_tokens:int,completion_tokens:int,total_tokens:int>", "usage x").split(", ")]

    def run(batches: Iterator[pd.DataFrame]):
        client = make_client()
        for pdf in batches:
            rows = []
            for key, prompt in zip(pdf["message_id"], pdf["prompt"]):
                began = time.time()
                try:
                    r = call_with_retries(lambda p=prompt: client(p))
                    rows.append((key, model, r.get("p_high_risk"), r.get("y_pred"), r.get("usage"), r.get("raw"), time.time() - began, None))
                except Exception as e:  # noqa: BLE001
                    rows.append((key, model, None, None, None, None, time.time() - began, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=names).astype({"y_pred": "Int32"})

    return prompts.select("message_id", "prompt").mapInPandas(run, RECORD)
