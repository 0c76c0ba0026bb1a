"""Text and date column builders."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The URL patterns of the labelled-message pipeline (scheme only, whole www and t.me tokens).
URL_MASK = r"https?://|http://|www\.\S*|t\.me/\S*"
URL_FULL = r"https?://[^\s<>\"]+|www\.[^\s<>\"]+"
URL_HINT = r"(?i)(http://|https://|www\.|t\.me/)"
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ssX", "dd.MM.yyyy HH:mm", "yyyy-MM-dd", "MMM dd, yyyy HH:mm:ss")


def utrim(c: Column) -> Column:
    """Strip all Unicode blanks, not just U+0020."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def url_mask(c: Column, ignore_case: bool = False) -> Column:
    """Replace URL tokens by a blank; host and path of URLs with a scheme stay."""
    return utrim(F.regexp_replace(c, ("(?i)" if ignore_case else "") + URL_MASK, " "))


def has_url(c: Column) -> Column:
    return c.rlike(URL_HINT).cast("int")


def urls(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("(?i)" + URL_FULL), F.lit(0))


def token_count(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(r"(?U)\S+"), F.lit(0)))


def _parts(c: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(c, pattern), utrim), lambda x: x != "")


def tokenize_multi(c: Column) -> Column:
    """Labels between commas and plus signs, without link/url; null gives no labels."""
    return F.coalesce(F.filter(_parts(c, "[,+]"), lambda x: F.regexp_replace(F.lower(x), r"\s", "") != "link/url"), F.array().cast("array<string>"))


def split_multi(c: Column) -> Column:
    """Labels between commas without NA; null, empty, nan and NA give none."""
    whole = F.coalesce(utrim(c), F.lit(""))
    return F.when(F.lower(whole).isin("", "nan", "na"), F.array().cast("array<string>")).otherwise(F.filter(_parts(whole, ","), lambda x: F.upper(x) != "NA"))


def split_plain(c: Column) -> Column:
    return F.coalesce(_parts(c, ","), F.array().cast("array<string>"))


def sanitize_token(c: Column) -> Column:
    dashes = F.translate(utrim(c), "‐‑‒–—", "-----")
    return F.regexp_replace(F.regexp_replace(dashes, r"(?U)\s+", "_"), r"[^\p{L}\p{N}_\-/]", "_")


def excerpt(c: Column, most: int = 220) -> Column:
    flat = utrim(F.translate(c, "\n", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def _compat(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else x if x.isascii() else unicodedata.normalize("NFKC", x))


def nfkc(c: Column) -> Column:
    """Compatibility form; Spark has no built-in for it."""
    return F.pandas_udf(_compat, StringType())(c)


def key_exact(c: Column) -> Column:
    return utrim(F.coalesce(c, F.lit("")))


def key_fuzzy(c: Column, compat: bool = True) -> Column:
    """Lower case, URLs and user names masked, only letters a-z and digits kept."""
    t = F.lower(nfkc(F.coalesce(c, F.lit(""))) if compat else F.coalesce(c, F.lit("")))
    t = F.regexp_replace(F.regexp_replace(t, "(?i)" + URL_FULL, "<url>"), r"(?U)@\w{2,}", "<user>")
    return F.trim(F.regexp_replace(t, "[^a-z0-9<>]+", " "))


def parse_date(c: Column) -> Column:
    """UTC timestamp of a date in any of the known formats, null if in none."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMATS])


def week_label(ts: Column) -> Column:
    monday = F.date_trunc("week", ts)
    return F.concat(F.date_format(monday, "yyyy-MM-dd"), F.lit("/"), F.date_format(monday + F.expr("interval 6 days"), "yyyy-MM-dd"))


def category_key(c: Column) -> Column:
    """Cleaned category: missing markers become Unknown, words get capitals."""
    t = utrim(c)
    return F.when(t.isNull() | F.lower(t).isin("", "nan", "none"), "Unknown").otherwise(F.initcap(t))
