"""Language identification with hyperdimensional profiles.

Every letter owns a random +1/-1 vector. A letter trigram is the element-wise
product of its letters' vectors, rotated by two, one and no places (binding of
permuted vectors); a text is the sum of its trigrams (bundling); a language is
the sum of its texts. A text gets the language whose prototype has the largest
cosine with it.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linklens.llm.common import free_prefix, query, table

DIMS = 1024
SEED = 20240611
UNKNOWN = "und"
#: Trigram vectors a worker keeps at once (1 KB each); beyond that it starts anew.
KEPT_TRIGRAMS = 1 << 16
_GAP = 32  # code point that stands for any stretch without letters


@dataclass(frozen=True)
class Profiles:
    """Prototypes: one row of ``vectors`` for each language, languages in ascending order."""

    languages: tuple[str, ...]
    vectors: np.ndarray


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@functools.cache
def _letter_vector(code: int) -> np.ndarray:
    return (np.random.default_rng([SEED, code]).integers(0, 2, DIMS, dtype=np.int8) * 2 - 1).astype(np.int8)


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(distinct trigram keys, counts) of the lower-cased letters of ``text``; both empty without a letter."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4")
    codes = np.where(_letters()[codes], codes, _GAP).astype(np.int64)
    codes = codes[np.r_[True, (codes[1:] != _GAP) | (codes[:-1] != _GAP)]]
    if len(codes) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.unique((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:], return_counts=True)


class TrigramVectors:
    """Vectors of trigrams, made when first met."""

    def __init__(self) -> None:
        self.rows: dict[int, int] = {}
        self.matrix = np.empty((1024, DIMS), np.int8)

    def _row(self, key: int) -> int:
        row = self.rows.get(key)
        if row is None:
            row = self.rows[key] = len(self.rows)
            if row == len(self.matrix):
                self.matrix = np.concatenate([self.matrix, np.empty_like(self.matrix)])
            a, b, c = key >> 42, (key >> 21) & 0x1FFFFF, key & 0x1FFFFF
            self.matrix[row] = np.roll(_letter_vector(a), 2) * np.roll(_letter_vector(b), 1) * _letter_vector(c)
        return row

    def bundle(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of the trigrams' vectors times their counts."""
        total = np.zeros(DIMS)
        for at in range(0, len(keys), 8192):
            part = keys[at:at + 8192]
            if len(self.rows) + len(part) > KEPT_TRIGRAMS:
                self.__init__()
            rows = [self._row(k) for k in part.tolist()]
            total += counts[at:at + 8192].astype(np.float32) @ self.matrix[rows].astype(np.float32)
        return total


def learn_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Prototypes from all rows with a text and a language.

    Each task sums its rows to one vector for each language, Spark adds those;
    what reaches the driver is one vector of ``DIMS`` numbers for each language
    (language codes: a small, bounded set), however many rows there are.
    """

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors, sums = TrigramVectors(), {}
        for pdf in batches:
            for lang, group in pdf.groupby("lang"):
                # texts joined by gaps: the same trigrams as one by one
                for at in range(0, len(group), 256):
                    keys, counts = trigrams(" ".join(group["text"].iloc[at:at + 256]))
                    sums[lang] = sums.get(lang, 0) + vectors.bundle(keys, counts)
        for lang, total in sums.items():
            yield pd.DataFrame({"lang": lang, "dim": range(DIMS), "value": total.astype(np.int64)})

    rows = (docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna()
            .mapInPandas(bundle, "lang string, dim int, value bigint")
            .groupBy("lang", "dim").agg(F.sum("value").alias("value")).collect())
    languages = tuple(sorted({r["lang"] for r in rows}))
    vectors = np.zeros((len(languages), DIMS))
    for r in rows:
        vectors[languages.index(r["lang"]), r["dim"]] = r["value"]
    return Profiles(languages, vectors)


def predict_text(text: str | None, profiles: Profiles, vectors: TrigramVectors) -> tuple[str, float]:
    """(language, cosine cut to 0..1); ``und`` and 0 without letters or without any language."""
    keys, counts = trigrams(text or "")
    if not len(keys) or not profiles.languages:
        return UNKNOWN, 0.0
    own = vectors.bundle(keys, counts)
    norms = np.linalg.norm(profiles.vectors, axis=1) * np.linalg.norm(own)
    cosines = (profiles.vectors @ own) / np.where(norms > 0, norms, 1)
    best = int(np.argmax(cosines))  # equal cosines: the first in ascending order
    return profiles.languages[best], float(min(1.0, max(0.0, cosines[best])))


def predict_languages(docs: DataFrame, profiles: Profiles, keep: list[Column], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of every row, then lang_pred and score.

    Reads whole texts and nothing else for the prediction; null, empty and
    letterless texts get ``und`` and 0. Repeated rows each get their result. A
    pass without a shuffle; a task holds one batch and ``KEPT_TRIGRAMS`` vectors.
    """
    text = f"{free_prefix(docs.select(*keep))}text"
    kept = docs.select(*keep, F.col(text_col).alias(text))
    names = kept.columns[:-1]

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors = TrigramVectors()
        for pdf in batches:
            found = [predict_text(t, profiles, vectors) for t in pdf["ll_text"]]
            yield pd.DataFrame({"kept": pdf["kept"], "lang_pred": [f[0] for f in found],
                                "score": [f[1] for f in found]})

    # kept columns travel as one JSON text, so their types and names do not matter in Python
    packed = kept.select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("kept"), F.col(text).alias("ll_text"))
    out = packed.mapInPandas(predict, "kept string, lang_pred string, score double")
    schema = kept.select(*names).schema
    return out.select(F.from_json("kept", schema).alias("k"), "lang_pred", "score").select("k.*", "lang_pred", "score")


def is_held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


@query("op10_language_id")
def op10_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = learn_profiles(docs.filter(~is_held_out()))
    return predict_languages(docs, profiles, [F.col("doc_id"), is_held_out().alias("held_out")])
