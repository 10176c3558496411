"""URL filter: a weighted vocabulary over whole URLs, under host and path rules.

An Aho-Corasick automaton finds every term in the lower-cased URL in one pass.  A hit counts only with a boundary on
both sides (no ASCII letter or digit).  One strict term, or `soft_needed` different soft terms, block the URL.  Host
rules come first: the longest rule that fits decides alone.

Defined cases
-------------
* Null URLs and URLs without `://` have an empty host and path; the vocabulary still reads what there is.
* A rule (host, path) fits its host and all subdomains, if the path begins with the rule's path.
* A rule without anything behind its host's slash asks for a path that begins with a slash, so it doesn't fit a bare host.
* A URL may be of any length; it is read once.  Rows are independent: repeated rows, ties and null page_ids change
  nothing.  Empty tables give empty results.  Other columns than page_id and url are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exact_dedup import LOWER, UPPER

# The rules asked for, and this filter's vocabulary.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
STRICT = ("camgirls", "casino", "escorts", "hentai", "keygen", "malware", "phishing", "porn", "spam-farm", "viagra", "warez", "xxx")
SOFT = ("adult", "bet", "bonus", "cheap", "click", "coupon", "crypto", "dating", "deal", "download", "free", "jackpot", "loan", "lottery", "pills", "poker", "prize", "promo", "spam", "torrent", "win")
SOFT_NEEDED = 2


def automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for weight, terms in ((1, soft), (2, strict)):
        for term in terms:
            found.add_word(term, (term, weight))
    if len(found):
        found.make_automaton()
    return found


_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_FOLD = str.maketrans(UPPER, LOWER)


def hits(url: str | None, found: ahocorasick.Automaton) -> tuple[int, int]:
    """How many different strict and soft terms stand in the URL between boundaries."""
    text = (url or "").translate(_FOLD)
    seen = set()
    if len(found):
        for end, hit in found.iter(text):
            start = end + 1 - len(hit[0])
            if (start == 0 or text[start - 1] not in _ALNUM) and (end + 1 == len(text) or text[end + 1] not in _ALNUM):
                seen.add(hit)
    strict = sum(w == 2 for _, w in seen)
    return strict, len(seen) - strict


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER), F.coalesce(path, F.lit(""))


def url_filter(
    pages: DataFrame,
    rules: tuple[tuple[str, str], ...] = RULES,
    strict: tuple[str, ...] = STRICT,
    soft: tuple[str, ...] = SOFT,
    soft_needed: int = SOFT_NEEDED,
) -> DataFrame:
    """page_id, host, path, rule, verdict, strict_terms and soft_terms of every page."""

    @F.pandas_udf("strict int, soft int")
    def count(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        found = automaton(strict, soft)
        for block in urls:
            yield pd.DataFrame([hits(u, found) for u in block], columns=["strict", "soft"])

    host, path = url_parts(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"), count("url").alias("hits"))
    rule, verdict = F.lit(None).cast("string"), F.when((F.col("hits.strict") >= 1) | (F.col("hits.soft") >= soft_needed), "block").otherwise("allow")
    for text, says in sorted(rules, key=lambda r: len(r[0])):  # the longest is asked first
        name, _, rest = text.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith(f".{name}")) & F.col("path").startswith(f"/{rest}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return judged.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), F.col("hits.strict").alias("strict_terms"), F.col("hits.soft").alias("soft_terms"))
