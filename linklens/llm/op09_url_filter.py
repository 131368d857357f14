"""URL filter: a weighted vocabulary counted by an Aho-Corasick automaton, under host and path rules.

Strict terms reject on one hit, soft terms on ``soft_limit`` distinct hits. A
hit counts only between boundaries (no ASCII letter or digit on either side).
A host/path rule, where one fits, overrides the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linklens.llm.common import query, table

#: Weighted vocabulary (own choice).
STRICT_TERMS = ("porn", "xxx", "adult", "casino", "malware", "phishing", "escort", "warez", "spam")
SOFT_TERMS = ("free", "win", "bet", "bets", "farm", "cheap", "click", "bonus", "deal", "deals", "offer", "pills",
              "poker", "loan", "loans", "prize", "hot")
SOFT_LIMIT = 2
#: Host and path rules in the order (rule, verdict); fixed values of the contract.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url: both empty for null or without ``://``."""
    u = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(u, pattern, 1), upper, upper.lower()), F.regexp_extract(u, pattern, 2)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; equal lengths: the first listed."""
    rule = verdict = F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: len(r[0])):  # the longest ends up outermost
        rule_host, _, rest = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def build_automaton(strict: Sequence[str], soft: Sequence[str]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for term in soft:
        automaton.add_word(term, (term, False))
    for term in strict:  # a term in both lists is strict
        automaton.add_word(term, (term, True))
    if len(automaton):
        automaton.make_automaton()
    return automaton


def count_terms(automaton: ahocorasick.Automaton, url: str) -> tuple[int, int]:
    """(distinct strict, distinct soft) terms of ``url`` between boundaries."""
    strict, soft = set(), set()
    if not len(automaton):
        return 0, 0
    low = url.translate(_LOWER)
    for end, (term, is_strict) in automaton.iter(low):
        start = end - len(term) + 1
        if (start and low[start - 1] in _INNER) or (end + 1 < len(low) and low[end + 1] in _INNER):
            continue
        (strict if is_strict else soft).add(term)
    return len(strict), len(soft)


_INNER = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", strict: Sequence[str] = STRICT_TERMS,
               soft: Sequence[str] = SOFT_TERMS, soft_limit: int = SOFT_LIMIT,
               rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """One row per page: id, host, path, n_strict, n_soft, rule, verdict.

    A null or empty url has no host, path, rule or hits and is allowed. Repeated
    rows each get their result; other columns of ``pages`` are not read. Very
    long urls are scanned whole. One pass over the rows without a shuffle.
    """
    strict, soft = tuple(strict), tuple(soft)
    id_type = pages.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = build_automaton(strict, soft)
        for pdf in batches:
            hits = [count_terms(automaton, url or "") for url in pdf["url"]]
            yield pdf.assign(n_strict=[h[0] for h in hits], n_soft=[h[1] for h in hits])

    counted = (pages.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).cast("string").alias("url"))
               .mapInPandas(scan, "id string, url string, n_strict bigint, n_soft bigint"))
    host, path = split_url(F.col("url"))
    parts = counted.select(F.col("id").cast(id_type).alias(id_col), host.alias("host"), path.alias("path"), "n_strict",
                           "n_soft")
    rule, ruled = matching_rule(F.col("host"), F.col("path"), rules)
    own = F.when((F.col("n_strict") >= 1) | (F.col("n_soft") >= soft_limit), "block").otherwise("allow")
    return parts.select(id_col, "host", "path", "n_strict", "n_soft", rule.alias("rule"),
                        F.coalesce(ruled, own).alias("verdict"))


def _oracle() -> str:
    def hit(term: str) -> str:
        return (f"CAST(regexp_matches(lower(coalesce(url, '')), '(^|[^a-z0-9]){term}([^a-z0-9]|$)') AS BIGINT)")

    def fits(text: str) -> str:
        host, _, rest = text.partition("/")
        return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{rest}'))"

    ordered = sorted(RULES, key=lambda r: -len(r[0]))
    rule = "CASE " + " ".join(f"WHEN {fits(t)} THEN '{t}'" for t, _ in ordered) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(t)} THEN '{v}'" for t, v in ordered) + \
        f" WHEN n_strict >= 1 OR n_soft >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END"
    return f"""
WITH p AS (
  SELECT page_id,
         lower(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1)) AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path,
         {' + '.join(hit(t) for t in STRICT_TERMS)} AS n_strict,
         {' + '.join(hit(t) for t in SOFT_TERMS)} AS n_soft
  FROM pages)
SELECT page_id, host, path, n_strict, n_soft, {rule} AS rule, {verdict} AS verdict FROM p"""


@query("op9_url_filter", _oracle())
def op9_url_filter(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages"))
