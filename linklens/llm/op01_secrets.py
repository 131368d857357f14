"""Secret scan over a trigram inverted index, in SQL functions only.

Every rule is a regular expression with a Boolean trigram query that any match
must satisfy: an OR of ANDs of three-letter strings, derived from the
expression's mandatory literals. Postings (block, trigram -> documents) are
built for the trigrams of these queries; ANDs intersect postings, ORs unite
them, and only candidates are searched with the expression. Rules without a
mandatory trigram search every text.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linklens.llm.common import materialise, query, row_key, table

#: Documents a block of the index has about; a posting list is one block's documents with a trigram.
BLOCK_ROWS = 4096
#: Matches walked at a time when places are added up.
WALK = 512


@dataclass(frozen=True)
class Rule:
    """``pattern``: for Java and Python alike; matches whose ``group`` has fewer than ``least`` characters are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: Base kinds (fixed values of the contract), then the kinds this scan adds. Where a match always takes the whole run of
#: its characters, its least length stands in the pattern: the same matches, without walking every short run.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Runs before a rule's literal, and repeated groups, are bounded: an unbroken run of letters costs its length, not its square.
ADDED_RULES = (
    Rule("pem", r"-----BEGIN(?: [A-Z0-9]{1,32}){0,4} PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{1,1000}\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("userinfo", r"[a-z][a-z0-9+.-]{0,15}://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]+@", 0, 8),
)
RULES = BASE_RULES + ADDED_RULES


def trigram_query(pattern: str) -> list[set[str]]:
    """OR of ANDs of lower-case trigrams that every match of ``pattern`` contains; [] if some match needs none."""
    branches = _literals(sre_parser.parse(pattern))
    clauses = [{lit[i:i + 3] for lit in runs for i in range(len(lit) - 2)} for runs in branches]
    return [] if any(not c for c in clauses) else [c for i, c in enumerate(clauses) if c not in clauses[:i]]


def _literals(parsed) -> list[list[str]]:
    """For each alternative way to match: the literal stretches it must contain, lower-cased."""
    ways: list[list[str]] = [[""]]  # the last stretch of a way is still open

    def cut(w: list[str]) -> list[str]:
        return w if w[-1] == "" else [*w, ""]

    for op, arg in parsed:
        if op is sre.LITERAL:
            ways = [[*w[:-1], w[-1] + chr(arg).lower()] for w in ways]
        elif op is sre.SUBPATTERN:
            ways = _joined(ways, _literals(arg[-1]))
        elif op is sre.IN and len(arg) <= 8 and all(x is sre.LITERAL for x, _ in arg):
            ways = _joined(ways, [[chr(c).lower()] for _, c in arg])
        elif op is sre.BRANCH:
            ways = _joined(ways, [w for branch in arg[1] for w in _literals(branch)])
        elif op is sre.MAX_REPEAT and arg[:2] == (0, 1) and len(_literals(arg[2])) == 1 and _literals(arg[2])[0][0]:
            ways = ways + _joined(ways, _literals(arg[2]))
        elif op is sre.MAX_REPEAT and arg[0] >= 1 and arg[1] == arg[0]:
            for _ in range(arg[0]):
                ways = _joined(ways, _literals(arg[2]))
        else:
            ways = [cut(w) for w in ways]
    return ways


def _joined(ways: list[list[str]], more: list[list[str]]) -> list[list[str]]:
    return [[*w[:-1], w[-1] + m[0], *m[1:]] for w in ways for m in more]


SPANS = "array<struct<start:int,ord:int,kind:string,stop:int>>"


def matches_of(text: Column, rule: Rule) -> Column:
    """array<struct<gap, size, checked>>: characters before each match since the last one, in it, and in its group."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    groups = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    between = F.split(text, rule.pattern, -1)  # what stands between matches gives their places
    zipped = F.filter(F.arrays_zip(found, groups, between), lambda m: m["0"].isNotNull())
    sizes = F.transform(zipped, lambda m: F.struct(F.char_length(m["2"]).alias("gap"),
                                                   F.char_length(m["0"]).alias("size"),
                                                   F.char_length(m["1"]).alias("checked")))
    return F.when(text.rlike(rule.pattern), sizes).otherwise(
        F.array().cast("array<struct<gap:int,size:int,checked:int>>"))


def spans_of(matches: Column, rule: Rule, order: int) -> Column:
    """The rule's spans, leftmost and non-overlapping, in code points; ``matches``: a column with :func:`matches_of`.

    Places are running sums. They are added up over ``WALK`` matches at a time,
    as an array that grows by one match a step would be copied at every step.
    """
    none = F.array().cast(SPANS)

    def walk(end: Column, some: Column) -> Column:
        return F.aggregate(some, F.struct(end.alias("end"), none.alias("spans")), lambda acc, m: F.struct(
            (acc["end"] + m["gap"] + m["size"]).alias("end"),
            F.concat(acc["spans"], F.when(m["checked"] >= rule.least, F.array(F.struct(
                (acc["end"] + m["gap"]).alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"),
                (acc["end"] + m["gap"] + m["size"]).alias("stop")))).otherwise(none)).alias("spans")))

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / WALK).cast("int")),
                        lambda i: F.slice(matches, i * WALK + 1, WALK))
    # a part walks from where the last one ended
    walked = F.aggregate(parts, F.struct(F.lit(0).alias("end"), F.array().cast(f"array<{SPANS}>").alias("parts")),
                         lambda acc, part: F.transform(F.array(walk(acc["end"], part)), lambda w: F.struct(
                             w["end"].alias("end"), F.concat(acc["parts"], F.array(w["spans"])).alias("parts")))[0])
    return F.when(F.size(matches) > 0, F.flatten(walked["parts"])).otherwise(none)


def build_postings(docs: DataFrame, trigrams: Sequence[str], id_col: str, text_col: str) -> DataFrame:
    """(block, trigram, ids): rows that contain each of the ``trigrams``, as (k_id, k_text) keys.

    Row keys are dealt to blocks by a hash of id and text, and there are as many
    blocks as rows ask for, so a trigram that a third of all rows hold has many
    lists, all of them short, also where these rows are copies of one text.
    """
    blocks = max(1, -(-docs.count() // BLOCK_ROWS))
    # bound by a projection of its own: lower-cased once, not once for each trigram
    keyed = docs.select(*row_key(id_col, text_col), F.lower(F.col(text_col)).alias("low"))
    present = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in sorted(trigrams)]))
    return (keyed.select("k_id", "k_text", present.alias("found")).select(F.pmod(F.xxhash64("k_id", "k_text"), F.lit(blocks)).alias("block"), F.struct("k_id", "k_text").alias("id"),
                         F.explode_outer("found").alias("trigram"))  # explode would compute the array twice
            .filter(F.col("trigram").isNotNull()).groupBy("block", "trigram").agg(F.collect_set("id").alias("ids")))


def candidates(postings: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(k_id, k_text, kinds): rows whose trigrams satisfy a rule's query, by intersecting and uniting posting lists."""
    wanted = {r.kind: trigram_query(r.pattern) for r in rules}
    trigrams = sorted({t for clauses in wanted.values() for c in clauses for t in c})
    lists = postings.groupBy("block").pivot("trigram", trigrams).agg(F.first("ids"))
    none = F.array().cast(postings.schema["ids"].dataType)

    def of(trigram: str) -> Column:
        return F.coalesce(F.col(f"`{trigram}`"), none)

    def rows(clauses: list[set[str]]) -> Column:
        return reduce(F.array_union, [reduce(F.array_intersect, [of(t) for t in sorted(c)]) for c in clauses])

    per_kind = F.array(*[F.struct(F.lit(kind).alias("kind"), rows(clauses).alias("ids"))
                         for kind, clauses in wanted.items() if clauses])
    return (lists.select(F.explode(per_kind).alias("hit"))
            .select("hit.kind", F.explode("hit.ids").alias("id"))
            .groupBy("id").agg(F.collect_set("kind").alias("kinds"))
            .select("id.k_id", "id.k_text", "kinds"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 rules: Sequence[Rule] = RULES) -> DataFrame:
    """(id, spans) of every row of ``docs``; spans: array<struct<start, ord, kind, stop>> by start, then rule order.

    Null and empty texts have no span. Repeated rows each get their result;
    other columns are not read. Ties (spans of several kinds at one place) all
    stay, in the order of ``rules``. An empty table gives an empty result.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = [(i, r) for i, r in enumerate(rules) if queries[r.kind]]
    searched = docs.select(F.col(id_col).alias("ll_id"), *row_key(id_col, text_col),
                           F.coalesce(F.col(text_col), F.lit("")).alias("ll_text"),
                           F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("ll_low"))
    # rules without a trigram query search every text here, before the join
    full = [matches_of(F.col("ll_text"), r).alias(f"m{i}") for i, r in enumerate(rules) if not queries[r.kind]]
    # a text without the first trigram of any AND is in no result of the index, so it need not travel to the join
    keys = sorted({min(c) for _, r in indexed for c in queries[r.kind]})
    listed = reduce(lambda a, b: a | b, [F.contains("ll_low", F.lit(t)) for t in keys], F.lit(False))
    rows = searched.select("ll_id", "k_id", "k_text", *full, F.when(listed, F.col("ll_text")).alias("ll_text"))
    if indexed:
        trigrams = sorted({t for _, r in indexed for c in queries[r.kind] for t in c})
        found = materialise(candidates(build_postings(docs, trigrams, id_col, text_col), rules), "candidates")
        hits = found.toDF("c_id", "c_text", "kinds")
        rows = rows.join(hits, (rows["k_text"] == hits["c_text"]) & rows["k_id"].eqNullSafe(hits["c_id"]), "left")
        verified = [F.when(F.array_contains("kinds", r.kind), matches_of(F.col("ll_text"), r)).alias(f"m{i}")
                    for i, r in indexed]
        rows = rows.select("*", *verified)
    spans = [F.coalesce(spans_of(F.col(f"m{i}"), r, i), F.array().cast(SPANS)) for i, r in enumerate(rules)]
    return rows.select(F.col("ll_id").alias(id_col), F.array_sort(F.concat(*spans)).alias("spans"))


def joined_spans(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def _oracle() -> str:
    def lists(i: int, r: Rule) -> str:
        p = r.pattern.replace("'", "''")
        return (f"regexp_extract_all(t, '{p}', 0) AS f{i}, regexp_extract_all(t, '{p}', {r.group}) AS g{i}, "
                f"string_split_regex(t, '{p}') AS b{i}")

    def spans(i: int, r: Rule) -> str:
        start = (f"list_sum(list_transform(b{i}[1:k], lambda x: length(x))) + "
                 f"coalesce(list_sum(list_transform(f{i}[1:k - 1], lambda x: length(x))), 0)")
        all_of = (f"list_transform(range(1, len(f{i}) + 1), lambda k: {{'s': CAST({start} AS BIGINT), 'o': {i}, "
                  f"'kind': '{r.kind}', 'e': CAST({start} + length(f{i}[k]) AS BIGINT), 'c': length(g{i}[k])}})")
        return f"list_filter({all_of}, lambda x: x.c >= {r.least})"

    def joined(what: str) -> str:
        return f"array_to_string(list_transform({what}, lambda x: concat(x.kind, ':', x.s, ':', x.e)), ',')"

    counts = ", ".join(f"CAST(len(list_filter(s, lambda x: x.o = {i})) AS BIGINT) AS n_{r.kind}"
                       for i, r in enumerate(BASE_RULES))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, {', '.join(lists(i, r) for i, r in enumerate(RULES))} FROM d),
a AS (SELECT doc_id, list_sort({' || '.join(spans(i, r) for i, r in enumerate(RULES))}) AS s FROM f)
SELECT doc_id, {counts}, sha256({joined(f"list_filter(s, lambda x: x.o < {len(BASE_RULES)})")}) AS base_sha256,
  {joined('s')} AS spans
FROM a"""


@query("op1_secrets", _oracle())
def op1_secrets(spark, sf_dir):
    found = scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["ord"] < len(BASE_RULES))

    def count_of(order: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["ord"] == order)).cast("long")

    counts = [count_of(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE_RULES)]
    return found.select("doc_id", *counts, F.sha2(joined_spans(base).cast("binary"), 256).alias("base_sha256"),
                        joined_spans(F.col("spans")).alias("spans"))
