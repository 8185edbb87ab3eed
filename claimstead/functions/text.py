"""Hosts, pages, slugs and other small text functions as column expressions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def host_of(url: Column) -> Column:
    """Lower-case host without a leading www.; empty where there is none."""
    return F.coalesce(F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", ""), F.lit(""))


def host_matches(url: Column, domains: list[str]) -> Column:
    """Whether the host is one of the domains or below one."""
    host = host_of(url)
    clean = [d.lower().removeprefix("www.") for d in domains]
    return (host != "") & F.exists(F.array(*map(F.lit, clean)), lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d)))


@F.pandas_udf(T.StringType())
def _decoded(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def unescaped(text: Column) -> Column:
    """Character references of HTML5 decoded, named and numeric ones. No built-in does this; texts without any stay in the JVM."""
    return F.when(F.contains(text, F.lit("&")), _decoded(F.when(F.contains(text, F.lit("&")), text))).otherwise(text)


@F.pandas_udf(T.ArrayType(T.StringType()))
def unescaped_all(texts: pd.Series) -> pd.Series:
    return texts.map(lambda xs: [html.unescape(x) for x in xs], na_action="ignore")


def page_text(page: Column, most: int = 6000) -> Column:
    """Readable text of a page: no scripts, styles or tags; entities decoded; white space collapsed."""
    bare = F.regexp_replace(page, r"(?is)<(script|style|noscript)[^>]*>.*?</\1>", " ")
    bare = F.trim(unescaped(F.regexp_replace(bare, "<[^>]+>", "")))
    return F.substring(F.regexp_replace(bare, r"(?U)\s+", " "), 1, most)


def slug(target: Column) -> Column:
    """For file names: lower-case letters and digits, hyphens between, 40 characters at most."""
    s = F.substring(F.regexp_replace(F.regexp_replace(F.lower(target), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 40)
    return F.when(s == "", "audit").otherwise(s)


def norm_org(name: Column) -> Column:
    """An organisation's name for comparison: trimmed, without its legal form, lower case."""
    form = r"(?iU)\s+(?:gmbh|ltd|llc|inc|bv|nv|sa|ag|plc|foundation|association|institute)\.?$"
    return F.lower(F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), form, ""))
