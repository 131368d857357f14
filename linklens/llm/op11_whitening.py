"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred vectors.

The centred rows Y (n x d) are bidiagonalised, Y V = U B: step j alternates the
products Y v and Y' u. Left vectors are as long as the table, so none is ever
stored: each is U = Y G for a small matrix G (d x j) which the driver holds next to
V, and a task derives its own rows of U from its own rows of Y. One pass a step
gives |w|, U'w and Y'w of w = Y v - U h, which is all that both products and the
full reorthogonalisation of U need; V is reorthogonalised on the driver (d numbers a
vector). The SVD of the small bidiagonal B yields components and deviations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linklens.llm.common import materialise, query, table
from linklens.session import ensure_checkpoint_dir, ship_package

#: Entries become floor(SCALE * c) + SHIFT (fixed values of the contract).
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Entries from here on have no exact integer form in a double.
LARGEST = 2.0**46
#: A direction whose length is under this share of the largest one so far counts as none.
NONE = 1e-10
#: Left vectors are orthogonalised again while what is left over is more than this share.
ORTHOGONAL = 1e-9
INT64 = 2**63


@dataclass
class Fit:
    """Counts and sums of the fit list: ``total`` (of each dimension, exact), ``largest`` absolute entry."""

    n: int
    total: list[int]
    largest: int

    def spread(self, x: np.ndarray) -> np.ndarray:
        """n * x - total, exact; Python integers where 64 bits do not hold it."""
        if self.n * (self.largest + 1) >= 2**61:
            return x.astype(object) * self.n - np.array(self.total, object)
        return x * np.int64(self.n) - np.array(self.total, np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.spread(x).astype(np.float64) / self.n


@dataclass
class Whitening:
    """``components``: a unit eigenvector in each column, by falling ``eigenvalues``; ``trace``: total variance."""

    fit: Fit
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def projection(self) -> np.ndarray:
        return self.components / np.sqrt(self.eigenvalues)


def usable_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, x array<bigint>) of the rows that can be whitened, all of one length."""
    vec = F.col("v")
    fits = F.forall(vec, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < LARGEST))
    rows = (df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
            .filter(vec.isNotNull()).filter(F.coalesce(fits, F.lit(False))))
    lengths = rows.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    length = lengths["length"] if lengths else 0
    return rows.filter((F.size("v") == length) & (F.size("v") > 0)).select(
        "id", F.transform("v", lambda e: F.floor(e * SCALE) + SHIFT).alias("x"))


def pack(vectors: DataFrame) -> DataFrame:
    """(id, x binary): every vector as its little-endian 64-bit integers, written once and read by every pass."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            width = len(lists[0]) if len(lists) else 0
            values = lists.flatten().to_numpy().astype("<i8", copy=False)
            at = np.arange(len(lists) + 1, dtype=np.int64) * (8 * width)
            x = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(at), pa.py_buffer(values.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), x.cast(pa.binary())], names=["id", "x"])

    kind = vectors.schema["id"].dataType.simpleString()
    return materialise(vectors.mapInArrow(packed, f"id {kind}, x binary"), "vectors")


def rows_of(batch: pa.RecordBatch, place: int = 0) -> np.ndarray:
    """The packed vectors of a batch as a matrix of integers."""
    x = batch.column(place)
    n = len(x)
    return np.frombuffer(b"".join(x.to_pylist()), "<i8").reshape(n, -1)


def totals(packed: DataFrame, kind: str, part: Callable[[np.ndarray], np.ndarray], how=F.sum) -> dict[int, float]:
    """Place and total of ``part`` over all packed vectors.

    Each task adds up its own batches; the rest is one aggregation by place, so
    the driver gets as many rows as ``part`` has numbers, whatever the table's size.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            if batch.num_rows:
                own = part(rows_of(batch))
                found = own if found is None else found + own if how is F.sum else np.maximum(found, own)
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found), dtype=np.int32)), pa.array(found)],
                                             names=["at", "value"])

    rows = packed.select("x").mapInArrow(add, f"at int, value {kind}")
    return {r["at"]: r["value"] for r in rows.groupBy("at").agg(how("value").alias("value")).collect()}


def measure(packed: DataFrame) -> Fit:
    """n, sums and the largest entry of the packed vectors."""
    sums = totals(packed, "bigint", lambda x: np.concatenate([[len(x)], x.sum(axis=0)]))
    largest = totals(packed, "bigint", lambda x: np.array([np.abs(x).max()]), F.max)
    return Fit(sums.get(0, 0), [sums[i] for i in range(1, len(sums))], largest.get(0, 0))


def left_products(packed: DataFrame, fit: Fit, g: np.ndarray, left: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """|w|^2, U'w and Y'w of w = Y g and U = Y left, in one pass over the vectors."""
    both, j = np.column_stack([left, g]), left.shape[1]

    def part(x: np.ndarray) -> np.ndarray:
        y = fit.centred(x)
        products = y @ both
        w = products[:, j]
        return np.concatenate([[w @ w], products[:, :j].T @ w, y.T @ w])

    found = totals(packed, "double", part)
    all_of = np.array([found[i] for i in range(1 + j + len(g))])
    return all_of[0], all_of[1:1 + j], all_of[1 + j:]


def orthogonal(r: np.ndarray, to: np.ndarray) -> np.ndarray:
    for _ in range(2):
        r = r - to @ (to.T @ r)
    return r


def bidiagonalise(packed: DataFrame, fit: Fit, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(V, B) with Y V = U B, V square and orthogonal, B upper bidiagonal.

    All d steps are taken, so that equal eigenvalues are found as often as they
    occur. Where a step leads nowhere new (an invariant space is complete), it goes
    on in a random direction orthogonal to all earlier ones.
    """
    d, rng = len(fit.total), np.random.default_rng(seed)
    right, b = np.zeros((d, d)), np.zeros((d, d))
    left, products = np.zeros((d, 0)), np.zeros((d, 0))  # U = Y left, products = Y'U
    v, largest = rng.standard_normal(d), 0.0
    v /= np.linalg.norm(v)
    for j in range(d):
        right[:, j] = v
        h, alpha = products.T @ v, 0.0
        for _ in range(4):
            g = v - left @ h
            square, over, back = left_products(packed, fit, g, left)
            if square <= (NONE * largest) ** 2:
                break
            alpha = np.sqrt(max(square - over @ over, 0.0))
            h = h + over
            if over @ over <= ORTHOGONAL**2 * square:
                break
        if alpha <= NONE * largest or not alpha:
            alpha, u, z = 0.0, np.zeros(d), np.zeros(d)  # Y v lies in the span of U
        else:
            u, z = (g - left @ over) / alpha, (back - products @ over) / alpha
        left, products = np.column_stack([left, u]), np.column_stack([products, z])
        b[j, j], largest = alpha, max(largest, alpha)
        if j + 1 == d:
            break
        r = orthogonal(z - alpha * v, right[:, :j + 1])
        beta = np.linalg.norm(r)
        if beta <= NONE * largest:
            beta, r = 0.0, orthogonal(rng.standard_normal(d), right[:, :j + 1])
        b[j, j + 1], largest = beta, max(largest, beta)
        v = orthogonal(r / np.linalg.norm(r), right[:, :j + 1])
        v /= np.linalg.norm(v)
    return right, b


def fit_whitening(packed: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all packed vectors; None where there is no variance."""
    fit = measure(packed)
    if not fit.n:
        return None
    right, b = bidiagonalise(packed, fit)
    _, sigma, rotation = np.linalg.svd(b)
    some = sigma > max(sigma[0], 1e-300) * NONE
    if not some.any():
        return None
    k = min(components, int(some.sum()))
    out = Whitening(fit, (right @ rotation.T)[:, :k], sigma[:k] ** 2 / fit.n, float((sigma**2).sum() / fit.n))
    project = out.projection

    def part(x: np.ndarray) -> np.ndarray:
        w = fit.centred(x) @ project
        return (w.T @ w).ravel()

    found = totals(packed, "double", part)
    covariance = np.array([found[i] for i in range(k * k)]).reshape(k, k) / fit.n
    out.identity_error = float(np.abs(covariance - np.eye(k)).max())
    return out


def project_vectors(packed: DataFrame, model: Whitening) -> DataFrame:
    """(id, deviation, whitened array<double>) of every packed vector."""
    fit, project = model.fit, model.projection

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spread = fit.spread(rows_of(batch, 1))
            near = spread.astype(np.float64)
            exact = (spread * spread).sum(axis=1)
            fits = (near * near).sum(axis=1) < INT64 * (1 - 1e-9)
            deviation = pa.array([int(x) if ok else None for x, ok in zip(exact, fits, strict=True)], pa.int64())
            w = near / fit.n @ project
            at = np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, lists], names=["id", "deviation", "whitened"])

    kind = packed.schema["id"].dataType.simpleString()
    return packed.mapInArrow(apply, f"id {kind}, deviation bigint, whitened array<double>")


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
           components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None]:
    """((id, deviation, whitened) of every usable row of ``df``, the model).

    Dropped are rows whose vector is null, empty, or holds a null, a value that
    is not finite or one of 2^46 and more, and vectors of another length than most
    have (the longer one of equally frequent lengths). Ids may be null or repeated; repeated
    rows count and return as often as they occur. Directions without
    variance have no component, so that fewer than ``components`` may be there; an empty table, one
    row, or equal rows have none, the model is None and the result is empty. Other
    columns are not read, whatever their names. deviation is null where it
    exceeds 64 bits.
    """
    ensure_checkpoint_dir(df.sparkSession)
    ship_package(df.sparkSession)
    packed = pack(usable_vectors(df, id_col, vec_col))
    model = fit_whitening(packed, components)
    if model is None:
        kind = packed.schema["id"].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"id {kind}, deviation bigint, whitened array<double>"), None
    return project_vectors(packed, model), model


def whitened_components(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                        components: int = COMPONENTS) -> DataFrame:
    """A row for every usable vector and component (1, 2, ...), with the model's figures."""
    rows, model = whiten(df, id_col, vec_col, components)
    shares = [float(e / model.trace) for e in model.eigenvalues] if model else [0.0]
    return (rows.select(F.col("id").alias(id_col), "deviation", F.posexplode("whitened").alias("place", "value"))
            .select(id_col, (F.col("place") + 1).alias("component"), F.lit(model.fit.n if model else 0).cast("bigint").alias("n"),
                    "deviation", F.col("value").alias("whitened"),
                    F.get(F.array(*map(F.lit, shares)), F.col("place")).alias("explained"),
                    F.lit(model.identity_error if model else 0.0).alias("identity_error")))


@query("op11_whitening")
def op11_whitening(spark, sf_dir):
    return whitened_components(table(spark, sf_dir, "embeddings"))
