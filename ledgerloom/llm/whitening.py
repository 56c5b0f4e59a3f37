"""Whitening of vectors by shifted CholeskyQR: distributed Gram passes, small triangular factors, one small SVD."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import written

#: Entries become floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Gram passes at most; three suffice unless the vectors lie in a smaller space.
PASSES = 8
#: A direction with less than this share of the variance holds rounding errors only.
NO_VARIANCE = 1e-12
_FAR = float(1 << 62)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, dim)


def whole_numbers(rows: np.ndarray) -> np.ndarray:
    """floor(64 * c) + 1000000 as long; beyond 2^62 the ends of that range."""
    return np.clip(np.floor(SCALE * rows.astype(np.float64)), -_FAR, _FAR).astype(np.int64) + SHIFT


def _whole(rows: DataFrame, dim: int) -> DataFrame:
    """id and x, the 64-bit whole numbers of the vector end to end."""

    def make(batches):
        for batch in batches:
            entries = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x.tobytes() for x in whole_numbers(entries)], pa.binary())], names=["id", "x"])

    return rows.mapInArrow(make, "id long, x binary")


def _summed(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums of their entries: one row a dimension leaves each task, and Spark adds these up."""

    def add(batches):
        n, total = 0, [0] * dim
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"), dim)
                n += len(x)
                halves = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)  # neither sum can leave 64 bits
                total = [t + (int(h) << 32) + int(low) for t, h, low in zip(total, *halves)]
        yield pa.RecordBatch.from_pydict({"at": np.arange(dim + 1), "value": [str(v) for v in [n, *total]]})

    rows = fit.mapInArrow(add, "at long, value string").groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()  # dim + 1 rows
    values = {r["at"]: int(r["value"]) for r in rows}
    return values.get(0, 0), [values.get(i + 1, 0) for i in range(dim)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(x - sums / n, exact sum over dimensions of (n * x - sums)^2): whole numbers up to the division, of any size."""
    largest = max(int(np.abs(x).max(initial=0)) * n, *(abs(s) for s in sums)) * 2
    if largest < 1 << 62:
        whole = x * n - np.array(sums, np.int64)
        if int(np.abs(whole).max(initial=0)) ** 2 * x.shape[1] < 1 << 62:
            return whole / n, (whole * whole).sum(axis=1)
    exact = x.astype(object) * n - np.array(sums, object)
    return (exact / n).astype(np.float64), (exact * exact).sum(axis=1)


def triangular_solve(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """rows times the inverse of the upper triangle ``r``, column by column."""
    out = np.empty_like(rows)
    for j in range(r.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def _gram(fit: DataFrame, dim: int, width: int, turned) -> np.ndarray:
    """The Gram matrix of the rows that ``turned`` makes of the fit list: one row of cells leaves each task for each matrix row, and Spark adds these up."""

    def add(batches):
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                rows = turned(_matrix(batch.column("x"), dim))
                total += rows.T @ rows
        at = np.triu_indices(width)
        yield pa.RecordBatch.from_pydict({"i": at[0], "j": at[1], "value": total[at]})

    cells = fit.mapInArrow(add, "i long, j long, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect()  # half a square of the dimension
    out = np.zeros((width, width))
    for c in cells:
        out[c["i"], c["j"]] = out[c["j"], c["i"]] = c["value"]
    return out


def shifted_factor(gram: np.ndarray, n: int, first: bool) -> np.ndarray:
    """The upper Cholesky factor of a Gram matrix of ``n`` rows, shifted in the first pass and where the matrix is singular to rounding.

    The shift, 11 (n d + d (d + 1)) u |A|^2, keeps the factor real. Sums over tasks are summed in blocks, so n counts as a million at most.
    """
    d = len(gram)
    if not first:
        try:
            r = np.linalg.cholesky(gram).T
            if np.diag(r).min() > 1e-8 * np.sqrt(np.trace(gram) / d):
                return r
        except np.linalg.LinAlgError:
            pass
    shift = 11 * (min(n, 1 << 20) * d + d * (d + 1)) * np.finfo(float).eps / 2 * np.trace(gram)
    return np.linalg.cholesky(gram + shift * np.eye(d)).T


def fit_components(fit: DataFrame, dim: int, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as rows) of the covariance of the fit list.

    Each pass multiplies the rows, turned by all factors so far, with themselves and takes a Cholesky factor, until the
    turned rows are orthonormal to rounding. The factors' product R has R'R = A'A for the centred rows A, without
    the loss of squaring A, so R's singular values and right vectors give the components.
    """
    factors: list[np.ndarray] = []
    whole = np.eye(dim)
    for _ in range(PASSES):

        def turned(x, factors=tuple(factors)):
            rows = centred(x, n, sums)[0]
            for r in factors:
                rows = triangular_solve(rows, r)
            return rows

        gram = _gram(fit, dim, dim, turned)
        if not np.trace(gram) > 0:
            return np.zeros(0), np.zeros((0, dim))
        if factors and np.abs(gram - np.eye(dim)).max() < 1e-14 * dim:
            break
        r = shifted_factor(gram, n, not factors)
        factors.append(r)
        whole = r @ whole
    values, vectors = np.linalg.svd(whole)[1:]
    return values**2 / n, vectors


def whiten(vectors: DataFrame, *, most: int = 16, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Project each vector on the leading principal components, each scaled to variance one.

    Vectors that are null, or hold a null, NaN or infinite entry, are dropped. All must have one length; where lengths differ, the one that most vectors have
    counts (the smaller on ties) and the others are dropped. Entries become whole numbers x = floor(64 * c) + 1000000; those beyond 2^62 are cut
    there. The fit list is each distinct x vector once, n of them. Rows repeat as they are given; an id may be null.

    Returns id_col, component (from 1, by falling eigenvalue), n, deviation (sum over dimensions of (n * x - S)^2, exact; null if it exceeds
    a long), whitened, explained (share of the whole variance) and identity_error (how far the whitened fit list's
    covariance is from the identity), one row for each vector and each of the first ``most`` components. A direction without variance is no component; an empty table,
    or one of a single distinct vector, gives no rows. Only the two columns are read.
    """
    schema = f"{id_col} long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    rows = rows.where(F.col("vec").isNotNull() & (F.size("vec") > 0) & ~F.exists("vec", bad))
    length = rows.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("dim", F.struct("n", -F.col("dim")))).first()[0]
    if length is None:
        return spark.createDataFrame([], schema)
    dim = int(length)
    whole = written(_whole(rows.where(F.size("vec") == dim), dim))
    fit = written(whole.select("x").distinct())
    n, sums = _summed(fit, dim)
    values, axes = fit_components(fit, dim, n, sums)
    total = float(values.sum())
    k = min(most, int((values > NO_VARIANCE * total).sum())) if total > 0 else 0
    if not k:
        return spark.createDataFrame([], schema)
    sign = np.where(np.take_along_axis(axes, np.abs(axes).argmax(axis=1)[:, None], 1) < 0, -1.0, 1.0)
    basis = ((axes * sign)[:k] / np.sqrt(values[:k])[:, None]).T  # one column a component
    explained = values[:k] / total
    # a column of ones beside the whitened rows gives their sums; their covariance is taken of rows centred by these
    mean = _gram(fit, dim, k + 1, lambda x: np.column_stack([centred(x, n, sums)[0] @ basis, np.ones(len(x))]))[k, :k] / n
    error = float(np.abs(_gram(fit, dim, k, lambda x: centred(x, n, sums)[0] @ basis - mean) / n - np.eye(k)).max())

    def project(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            offset, deviation = centred(_matrix(batch.column("x"), dim), n, sums)
            m = batch.num_rows
            exact = [int(v) if v < 1 << 63 else None for v in deviation.tolist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                pa.array(exact, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array((offset @ basis).reshape(-1)), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
            ], names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return whole.mapInArrow(project, schema)
