"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The distinct vectors, on an integer grid, are the rows of a matrix X, centred by their exact
mean. From a random direction v the process alternates

    alpha_j u_j = X v_j - beta_{j-1} u_{j-1}        one number for each row of X
    beta_j v_{j+1} = X' u_j - alpha_j v_j           one number for each dimension

so that X V = U B with B upper bidiagonal. The singular vectors of the small B, turned by V,
are the components; its squared singular values over n their eigenvalues.

A left vector has as many entries as there are rows, and is never stored: each one is
u_j = X q_j for a q_j of few numbers, which the driver keeps. A sweep over the written blocks
forms the rows of X v and of all earlier u again, and brings back X'(X v) and the products
of X v with each earlier u, by which both sides are reorthogonalised in full. A lost executor
costs its blocks of the sweep at hand.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from detlake.llm.vectors import finite, matrix, on_grid, summed
from detlake.session import stored

#: Rows of one packed block; a sweep holds one block at a time.
BLOCK_ROWS = 2048
_EPS = np.finfo(float).eps


@dataclass
class Whitening:
    """``components`` by falling eigenvalue, one in each row; ``sums`` are exact."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float


class Blocks:
    """Distinct integer vectors of ``width`` entries, packed and written once."""

    def __init__(self, rows: DataFrame, width: int):
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low in range(0, batch.num_rows, BLOCK_ROWS):
                    part = batch.column(0).slice(low, BLOCK_ROWS)
                    packed = matrix(part, width).astype("<i8").tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([len(part)], pa.int32()), pa.array([packed], pa.binary())], ["rows", "data"])

        self.width = width
        self.table = stored(rows.distinct().mapInArrow(pack, "rows int, data binary"), "whitening-blocks")
        self.n = self.table.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]
        self.sums = self._sums()

    def _sums(self) -> np.ndarray:
        """Exact sums of each dimension."""
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width, np.int64)
            for batch in batches:
                for data in batch.column(1):
                    total += np.frombuffer(data.as_py(), "<i8").reshape(-1, width).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], ["i", "value"])

        sums = np.zeros(width, np.int64)
        for row in self.table.mapInArrow(run, "i int, value long").groupBy("i").agg(F.sum("value").alias("value")).collect():
            sums[row["i"]] = row["value"]
        return sums

    def sweep(self, numbers, size: int) -> np.ndarray:
        """Sum of ``numbers(centred block)``, ``size`` doubles, over all blocks."""
        n, sums, width = self.n, self.sums, self.width

        def of(batch: pa.RecordBatch) -> np.ndarray:
            total = np.zeros(size)
            for data in batch.column(1):
                total += numbers(centred(np.frombuffer(data.as_py(), "<i8").reshape(-1, width), n, sums))
            return total

        return summed(self.table, of, size)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n with an exact numerator and one rounding."""
    return (n * x - sums) / n


def _orthogonal(vector: np.ndarray, basis: np.ndarray) -> np.ndarray:
    for _ in range(2):
        vector = vector - basis @ (basis.T @ vector)
    return vector


def bidiagonalise(blocks: Blocks, leading: int, seed: int = 0, tolerance: float | None = None):
    """(V, B, trace of X'X): orthonormal right vectors as columns, B upper bidiagonal.

    Without ``tolerance`` V spans the whole space, one sweep a dimension, so that equal
    eigenvalues are all found. With it the process ends when the ``leading`` singular values
    of B have residuals below ``tolerance`` times the largest; a direction with exactly the
    same eigenvalue as another may then be missed.
    """
    d, random = blocks.width, np.random.default_rng(seed)
    right, left, images = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))
    b = np.zeros((0, 0))
    trace = beta = 0.0

    def fresh_direction() -> np.ndarray:
        v = _orthogonal(random.standard_normal(d), right)
        return v / np.linalg.norm(v)

    v = fresh_direction()
    while True:
        k = right.shape[1]
        right = np.column_stack([right, v])
        q = v - beta * left[:, -1] if k else v

        def numbers(x: np.ndarray, q=q, left=left, first=not k) -> np.ndarray:
            w = x @ q
            squares = [float(np.vdot(x, x))] if first else [0.0]
            return np.concatenate([x.T @ w, (x @ left).T @ w, [w @ w], squares])

        got = blocks.sweep(numbers, d + k + 2)
        image, products, square = got[:d], got[d : d + k], got[d + k]
        trace = trace or got[-1]
        floor = d * _EPS * np.sqrt(trace)
        # Full reorthogonalisation against the earlier left vectors.
        q, image = q - left @ products, image - images @ products
        alpha = np.sqrt(max(square - products @ products, 0.0))
        b = np.pad(b, ((0, 1), (0, 1)))
        if k:
            b[k - 1, k] = beta
        if alpha > floor:
            b[k, k] = alpha
            left, images = np.column_stack([left, q / alpha]), np.column_stack([images, image / alpha])
            rest = _orthogonal(image / alpha - alpha * v, right)
            beta = float(np.linalg.norm(rest))
        else:  # X v is a combination of earlier left vectors
            left, images, beta = np.pad(left, ((0, 0), (0, 1))), np.pad(images, ((0, 0), (0, 1))), 0.0
        if k + 1 == d:
            break
        if tolerance is not None and k + 1 >= min(leading, d):
            turned, values, _ = np.linalg.svd(b)
            if (beta * np.abs(turned[-1, :leading]) <= tolerance * values[0]).all():
                break
        if beta > floor:
            v = rest / beta
        else:  # an invariant space is exhausted
            beta, v = 0.0, fresh_direction()
    return right, b, trace


def fit_whitening(rows: DataFrame, width: int, components: int = 16, seed: int = 0, tolerance: float | None = None) -> Whitening:
    """The whitening of the distinct vectors in the one column of ``rows`` (array of longs).

    Directions whose variance is no more than rounding are not components.
    """
    none = Whitening(0, np.zeros(width, np.int64), np.zeros((0, width)), np.zeros(0), 0.0, 0.0)
    if not width:
        return none
    blocks = Blocks(rows, width)
    n, sums = blocks.n, blocks.sums
    if not n:
        return none
    right, b, trace = bidiagonalise(blocks, components, seed, tolerance)
    _, values, turned = np.linalg.svd(b)
    eigenvalues = (values**2 / n)[:components]
    real = eigenvalues > width * _EPS * trace / n
    if not real.any():
        return none
    axes, eigenvalues = (right @ turned.T).T[:components][real], eigenvalues[real]
    axes = axes / np.linalg.norm(axes, axis=1, keepdims=True)
    m, scaled = len(axes), (axes / np.sqrt(eigenvalues)[:, None]).T

    def numbers(x: np.ndarray) -> np.ndarray:
        w = x @ scaled
        return (w.T @ w).ravel()

    covariance = blocks.sweep(numbers, m * m).reshape(m, m) / n
    return Whitening(n, sums, axes, eigenvalues, trace / n, float(np.abs(covariance - np.eye(m)).max()))


def whiten(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16, scale: int = 64,
    shift: int = 1_000_000, seed: int = 0, tolerance: float | None = None,
) -> DataFrame:
    """One row per usable row of ``df`` and component: key, component (from 1), n (distinct vectors),
    deviation, whitened, explained, identity_error.

    Entries become longs on the grid ``floor(scale * c) + shift``. A vector takes no part if it
    is null, holds null or non-finite entries, or is shorter or longer than most are (of equally
    frequent lengths the longest counts). Repeated vectors are fitted once and all returned, null
    keys like others. An empty table, and one whose vectors are all equal, has no component and
    gives no rows. Other columns are not read. A deviation beyond 63 bits is an error.
    """
    column = F.col(f"`{vector}`")
    usable = df.filter(finite(column))
    common = usable.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    width = common["d"] if common else 0
    rows = usable.filter(F.size(column) == width).select(F.col(f"`{key}`"), on_grid(column, scale, shift).alias("x"))
    fit = fit_whitening(rows.select("x"), width, components, seed, tolerance)
    n, sums, m = int(fit.n), fit.sums, len(fit.components)
    scaled = (fit.components / np.sqrt(fit.eigenvalues)[:, None]).T
    explained = fit.eigenvalues / fit.trace if m else fit.eigenvalues
    error = fit.identity_error
    names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if m else ():
            x = n * matrix(batch.column(1), width) - sums
            if x.size and (x.astype(float) ** 2).sum(axis=1).max() >= 2.0**63:
                raise OverflowError("a deviation exceeds 63 bits")
            count = len(x)
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(count), m))),
                pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), count)),
                pa.array(np.full(count * m, n, np.int64)),
                pa.array(np.repeat((x * x).sum(axis=1), m)),
                pa.array((x / n @ scaled).ravel()),
                pa.array(np.tile(explained, count)),
                pa.array(np.full(count * m, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    own = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.mapInArrow(run, T.StructType([df.schema[key], *T._parse_datatype_string(own).fields]))


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
