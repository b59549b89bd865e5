"""URL filter: host and path rules first, then a weighted vocabulary found by an Aho-Corasick automaton.

A term counts only where it stands alone, between signs that are neither letters nor digits. One strict term rejects
a URL, and so do several distinct soft ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRICT = ("casino", "porn", "xxx", "spam", "malware", "phishing", "warez", "viagra")
SOFT = ("adult", "bets", "bet", "win", "free", "sex", "escort", "poker", "slots", "loan", "pills", "crack", "torrent", "nude", "dating", "cheap")
#: Distinct soft terms that reject.
SOFT_HITS = 2
#: (host and path, verdict): the rules that go before the vocabulary.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


@lru_cache(4)
def _automaton(terms: tuple[tuple[str, int], ...]):
    import ahocorasick

    own = ahocorasick.Automaton()
    for term, weight in terms:
        own.add_word(term, (term, weight))
    own.make_automaton()
    return own


def hits(url: str, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT) -> tuple[int, int]:
    """(distinct strict terms, distinct soft terms) that stand alone in a URL, A-Z read as a-z."""
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in url)
    alone = lambda k: not (0 <= k < len(text) and (("a" <= text[k] <= "z") or ("0" <= text[k] <= "9")))
    terms = tuple((t, 1) for t in strict) + tuple((t, 0) for t in soft if t not in strict)
    found = {v for end, v in _automaton(terms).iter(text) if alone(end + 1) and alone(end - len(v[0]))}
    return sum(w for _, w in found), sum(1 - w for _, w in found)


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): both '' for a null URL or one without '://'."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules=RULES, strict=STRICT, soft=SOFT, soft_hits: int = SOFT_HITS, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """id, host, path, rule, verdict, strict_hits, soft_hits: one row for each row of pages.

    A rule fits its host and all subdomains if the path begins with the rule's; the longest one wins. Without a rule
    the vocabulary decides. Null and malformed URLs have empty parts, no rule, and the vocabulary's verdict on their
    text. The vocabulary and the rules are constants of the plan; nothing is shuffled.
    """

    @F.pandas_udf("struct<strict: int, soft: int>")
    def count(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in urls:
            yield pd.DataFrame([hits(u or "", strict, soft) for u in x], columns=["strict", "soft"])

    host, path = parts(F.col(url_column))
    df = pages.select(F.col(id_column), F.col(url_column).alias("_url"), host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):  # the longest is asked first
        domain, _, tail = text.partition("/")
        fits = ((F.col("host") == domain) | F.col("host").endswith("." + domain)) & F.col("path").startswith("/" + tail)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    df = df.withColumn("rule", rule).withColumn("_says", verdict).withColumn("_hits", count(F.col("_url")))
    method = F.when((F.col("_hits.strict") >= 1) | (F.col("_hits.soft") >= soft_hits), F.lit("block")).otherwise(F.lit("allow"))
    return df.select(id_column, "host", "path", "rule", F.coalesce("_says", method).alias("verdict"), F.col("_hits.strict").alias("strict_hits"), F.col("_hits.soft").alias("soft_hits"))


def sql(rules=RULES, strict=STRICT, soft=SOFT, soft_hits: int = SOFT_HITS) -> str:
    """The same for DuckDB."""
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    count = lambda terms: " + ".join(f"CAST(regexp_matches({lower('u')}, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS INTEGER)" for t in terms)
    when = "".join(
        f" WHEN (host = '{d}' OR ends_with(host, '.{d}')) AND starts_with(path, '/{p}') THEN {{{r}}}"
        for r, (text, _) in sorted(enumerate(rules), key=lambda x: -len(x[1][0]))
        for d, _, p in [text.partition("/")]
    )
    texts = when.format(*(f"'{t}'" for t, _ in rules))
    says = when.format(*(f"'{v}'" for _, v in rules))
    return f"""
WITH a AS (SELECT page_id, coalesce(url, '') AS u, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, u, {lower("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, {count(strict)} AS strict_hits, {count(soft)} AS soft_hits FROM b)
SELECT page_id, host, path, CASE{texts} END AS rule,
       coalesce(CASE{says} END, CASE WHEN strict_hits >= 1 OR soft_hits >= {soft_hits} THEN 'block' ELSE 'allow' END) AS verdict,
       CAST(strict_hits AS INTEGER) AS strict_hits, CAST(soft_hits AS INTEGER) AS soft_hits
FROM c"""
