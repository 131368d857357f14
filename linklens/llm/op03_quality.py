"""Quality rules as weak supervision, in DataFrame functions only.

Every rule votes good (1) or bad (-1) or abstains (0). Expectation-maximisation
over all documents estimates how often each rule is right about good and about
bad texts, and how many texts are good; a text is kept if its posterior
probability of being good is at least one half.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linklens.llm.common import WORD, materialise, query, row_key, table, without_rows, words

SYMBOLS = "#*$%&|<>"
WINDOW = 3
#: Base rule (fixed values of the contract).
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Voting rules, see :func:`votes`. Each sort of bad text is in sight of two rules or more: agreement is what tells.
RULES = ("symbols", "symbol_runs", "punctuation", "repeats", "dup_lines", "word_length", "capitals", "shouting",
         "variety")
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ROUNDS, TOLERANCE = 25, 1e-5
#: Where estimation starts: a rule seldom calls a good text bad, and sees one sort of bad text in a few. So many imagined
#: votes stand for the start.
START_ON_GOOD, START_ON_BAD, START_GOOD, PRIOR_VOTES = 0.995, 0.3, 0.85, 10.0


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k_id, k_text and the counts of every row; all 0 for null, empty and blank texts.

    n_repeat_words sorts the hashes of a text's word windows next to their
    places, so equal windows stand side by side: n log n for one text, nothing
    across texts, no shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    base = docs.select(*row_key(id_col, text_col), text.alias("t"), words(text).alias("ws"), lines.alias("ls"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def count_of(chars: str) -> Column:
        return (F.char_length("t") - F.char_length(F.translate("t", chars, ""))).cast("long")

    n = F.size("ws")
    windows = F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(0), n - WINDOW),
        lambda i: F.struct(F.xxhash64(*[F.get("ws", i + k) for k in range(WINDOW)]).alias("h"), i.alias("at"))))
    counted = base.select(
        "k_id", "k_text", n.cast("long").alias("n_words"),
        (F.char_length("t") - count_of(" \t\n\x0b\x0c\r")).cast("long").alias("word_chars"),
        count_of(SYMBOLS).alias("n_symbols"), F.size("ls").cast("long").alias("n_lines"),
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        count_of(upper).alias("n_upper"), count_of("!").alias("n_shouts"), count_of(PUNCTUATION).alias("n_marks"),
        F.regexp_count("t", F.lit(f"[{SYMBOLS}]+")).cast("long").alias("n_runs"),
        F.size(F.array_distinct("ws")).cast("long").alias("n_distinct"),
        F.sort_array(windows).alias("sorted"))
    # a window is repeated if it equals its neighbour in the sorted order
    repeated = F.transform(F.filter("sorted", lambda w, i: (w["h"] == F.get("sorted", i - 1)["h"]) |
                                    (w["h"] == F.get("sorted", i + 1)["h"])), lambda w: w["at"])
    rest = [c for c in counted.columns if c != "sorted"]
    placed = counted.select(*rest, F.sort_array(repeated).alias("at"))
    # windows overlap: each adds the words up to the next repeated one
    added = F.transform("at", lambda a, i: F.least(F.lit(WINDOW), F.get("at", i + 1) - a))
    total = F.aggregate(added, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return placed.select(*rest, F.coalesce(total, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def votes() -> dict[str, Column]:
    """Vote of every rule from the columns of :func:`features`; texts without a word get no vote."""
    n = F.greatest("n_words", F.lit(1))

    def vote(bad: Column, good: Column) -> Column:
        return F.when(F.col("n_words") == 0, 0).when(bad, -1).when(good, 1).otherwise(0)

    symbols, repeats = F.col("n_symbols") / n, F.col("n_repeat_words") / n
    dup, length = F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)), F.col("word_chars") / n
    capitals, shouts = F.col("n_upper") / F.greatest("word_chars", F.lit(1)), F.col("n_shouts") / n
    runs, marks = F.col("n_runs") / n, F.col("n_marks") / F.greatest("word_chars", F.lit(1))
    variety, some = F.col("n_distinct") / n, F.col("n_words") >= 30
    return dict(zip(RULES, (
        vote(symbols >= 0.1, symbols < 0.02), vote(runs >= 0.1, runs < 0.02), vote(marks >= 0.08, marks < 0.05),
        vote(some & (repeats >= 0.3), repeats < 0.1),
        vote((F.col("n_lines") >= 4) & (dup >= 0.5), (F.col("n_lines") >= 2) & (dup == 0)),
        vote(some & ((length < 2.5) | (length > 14)), (length >= 3) & (length <= 9)),
        vote(some & (capitals >= 0.4), capitals <= 0.15), vote(some & (shouts >= 0.2), shouts < 0.05),
        vote(some & (F.col("n_words") <= 1000) & (variety < 0.2), variety >= 0.4)), strict=True))


@dataclass
class Model:
    """P(good), and for each rule P(it votes good | good text), P(it votes bad | bad text), given that it votes."""

    good: float = START_GOOD
    on_good: dict[str, float] = field(default_factory=lambda: dict.fromkeys(RULES, START_ON_GOOD))
    on_bad: dict[str, float] = field(default_factory=lambda: dict.fromkeys(RULES, START_ON_BAD))

    def posterior(self) -> Column:
        """P(good) of a row with a vote column for each rule."""
        odds = F.lit(math.log(self.good / (1 - self.good)))
        for r in RULES:
            odds = odds + F.when(F.col(r) == 1, math.log(self.on_good[r] / (1 - self.on_bad[r]))).when(
                F.col(r) == -1, math.log((1 - self.on_good[r]) / self.on_bad[r])).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def estimate(voted: DataFrame) -> Model:
    """Expectation-maximisation over all rows of ``voted`` (a vote column for each rule).

    Rows with equal votes count together: at most 3 ** len(RULES) rows are left
    after one aggregation, and each round is an aggregation of those to one row.
    """
    patterns = materialise(voted.groupBy(*RULES).agg(F.count("*").alias("n")).coalesce(1), "votes")
    model = Model()
    for _ in range(ROUNDS):
        p = patterns.withColumn("p", model.posterior())
        sums = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("p")).alias("good")]
        for r in RULES:
            for name, weight, right in (("g", F.col("p"), 1), ("b", 1 - F.col("p"), -1)):
                sums += [F.sum(F.when(F.col(r) != 0, F.col("n") * weight)).alias(f"{r}_{name}"),
                         F.sum(F.when(F.col(r) == right, F.col("n") * weight)).alias(f"{r}_{name}_right")]
        s = p.agg(*sums).first().asDict()

        def share(right: float | None, of: float | None, start: float) -> float:
            return ((right or 0.0) + PRIOR_VOTES * start) / ((of or 0.0) + PRIOR_VOTES)

        new = Model(share(s["good"], s["n"], START_GOOD),
                    {r: share(s[f"{r}_g_right"], s[f"{r}_g"], START_ON_GOOD) for r in RULES},
                    {r: share(s[f"{r}_b_right"], s[f"{r}_b"], START_ON_BAD) for r in RULES})
        moved = max(abs(new.good - model.good), *(abs(new.on_good[r] - model.on_good[r]) for r in RULES),
                    *(abs(new.on_bad[r] - model.on_bad[r]) for r in RULES))
        model = new
        if moved < TOLERANCE:
            break
    return model


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: k_id, k_text, the counts, base_failed, posterior, kept.

    Null, empty and blank texts have no word and fail the base rule. Repeated
    rows each get their (equal) result; a posterior of exactly one half keeps.
    Other columns are not read. An empty table gives an empty result.
    """
    counted = features(docs, id_col, text_col)
    voted = materialise(counted.select("*", *[v.alias(r) for r, v in votes().items()]), "features")
    model = estimate(voted)
    return voted.select(*counted.columns, base_failed().alias("base_failed"), model.posterior().alias("posterior"),
                        (~base_failed() & (model.posterior() >= 0.5)).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) without the rows that :func:`judge_quality` rejects."""
    return without_rows(docs, judge_quality(docs).filter(~F.col("kept")).select("k_id", "k_text"))


@query("op3_quality")
def op3_quality(spark, sf_dir):
    return judge_quality(table(spark, sf_dir, "documents")).select(
        F.col("k_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")
