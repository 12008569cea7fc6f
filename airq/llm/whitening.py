"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Spark sums the scatter and projects the vectors. What reaches the driver is one square matrix of the vectors' length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from airq.llm.common import scratch, store

#: An entry c becomes floor(SCALE * c) + SHIFT; beyond LARGEST that has no exact double any more.
SCALE, SHIFT, LARGEST = 1024, 100_000, float(1 << 42)
#: A column of the factor ends the factorization when its square is this share of the trace; Jacobi ends at this cosine.
RANK_SHARE, COSINE = 1e-12, 1e-15
SWEEPS = 40
#: Sums of products below this are exact as doubles; integers of 64 bits; deviations that a long surely holds.
EXACT, WRAP, FITS = 1 << 53, 1 << 64, 9.2e18


def usable(vector: Column) -> Column:
    """Whether a vector is not null and holds numbers only, none of them beyond exact integers."""
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) <= LARGEST))


def fit_list(rows: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """The rows with usable vectors of the most frequent length (of equal ones the greatest), and that length."""
    good = rows.where(F.coalesce(usable(F.col(vector)), F.lit(False)))
    sizes = good.groupBy(F.size(vector).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.max(F.struct("n", "d")).alias("x")).first()["x"]
    dims = most["d"] if most else 0
    return good.where(F.size(vector) == dims), dims


def _integers(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.floor(SCALE * flat).astype(np.int64) + SHIFT).reshape(-1, dims)


def _products(x: np.ndarray) -> np.ndarray:
    """Exact products of all pairs of columns, as Python integers."""
    largest = int(np.abs(x).max(initial=0))
    if largest * largest * len(x) < EXACT:
        y = x.astype(np.float64)
        return (y.T @ y).astype(np.int64).astype(object)
    return x.astype(object).T @ x.astype(object)


def _sums(rows: DataFrame, vector: str, dims: int) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each dimension."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims, object)
        for batch in batches:
            x = _integers(batch.column(0), dims)
            if len(x):
                small = int(np.abs(x).max()) * len(x) < WRAP // 4
                n, total = n + len(x), total + (x if small else x.astype(object)).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([[str(v) for v in total]])], ["n", "total"])

    parts = rows.select(vector).mapInArrow(task, "n long, total array<string>")
    each = parts.select("n", F.posexplode("total").alias("d", "v")).groupBy("d").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
    found = {r["d"]: r for r in each.collect()}
    return (int(found[0]["n"]), [int(found[d]["s"]) for d in range(dims)]) if found else (0, [])


def _covariance(rows: DataFrame, vector: str, n: int, sums: list[int]) -> np.ndarray:
    """The covariance, divisor n, from exact sums over vectors that are centred at the nearest integers to the means.

    The rest of the centring, less than one half per dimension, is exact too, so the result does not depend on the order
    in which tasks end.
    """
    dims = len(sums)
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    upper = np.triu_indices(dims)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims), object)
        for batch in batches:
            if batch.num_rows:
                total = total + _products(_integers(batch.column(0), dims) - middle)
        yield pa.RecordBatch.from_arrays([pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), pa.array([str(v) for v in total[upper]])],
                                         ["i", "j", "v"])

    parts = rows.select(vector).mapInArrow(task, "i int, j int, v string")
    found = parts.groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    out = np.zeros((dims, dims))
    left = [s - n * int(m) for s, m in zip(sums, middle)]
    for r in found:
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = (n * int(r["v"]) - left[r["i"]] * left[r["j"]]) / (n * n)
    return out


def pivoted_cholesky(matrix: np.ndarray) -> np.ndarray:
    """Columns L with matrix = L L', each from the largest diagonal entry that is left, until nothing is left.

    Rows keep the order of the matrix; put in the order of the pivots they are a lower triangle.
    """
    left, columns = matrix.astype(float).copy(), []
    end = RANK_SHARE * max(float(np.trace(matrix)), 0.0)
    for _ in range(len(matrix)):
        pivot = int(np.argmax(np.diag(left)))
        if left[pivot, pivot] <= end:
            break
        column = left[:, pivot] / np.sqrt(left[pivot, pivot])
        left -= np.outer(column, column)
        left[pivot, :] = left[:, pivot] = 0
        columns.append(column)
    return np.array(columns).T if columns else np.zeros((len(matrix), 0))


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of factor factor', as columns.

    Pairs of columns are rotated until all are at right angles; a round turns disjoint pairs at once. The squares of the
    rotated columns' norms are the eigenvalues, the normalised columns the vectors.
    """
    a = np.array(factor, float)
    m = a.shape[1]
    seats = list(range(m + m % 2))
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            pairs = [(min(p, q), max(p, q)) for p, q in zip(seats[:half], seats[::-1][:half]) if max(p, q) < m]
            seats = [seats[0], seats[-1], *seats[1:-1]]
            if not pairs:
                continue
            p, q = np.array(pairs).T
            left, right = a[:, p], a[:, q]
            alpha, beta, gamma = (left * left).sum(0), (right * right).sum(0), (left * right).sum(0)
            size = np.sqrt(alpha * beta)
            cosine = np.abs(gamma) / np.where(size > 0, size, 1)
            worst = max(worst, float(cosine.max()))
            turn = cosine > COSINE
            zeta = (beta - alpha) / np.where(turn, 2 * gamma, 1)
            t = np.where(turn, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta)), 0)
            c = 1 / np.sqrt(1 + t * t)
            a[:, p], a[:, q] = c * left - c * t * right, c * t * left + c * right
        if worst <= COSINE * max(1.0, np.sqrt(len(a))):
            break
    values = (a * a).sum(0)
    order = np.argsort(-values, kind="stable")
    values, a = values[order], a[:, order]
    vectors = a / np.sqrt(np.where(values > 0, values, 1))
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(m)]) if m else np.ones(0)
    return values, vectors * signs


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """(key, n, deviation, whitened, explained, eigenvalues, vectors, means, identity_error), one row per fitted vector.

    An entry c becomes the integer x = floor(1024 c) + 100000. ``whitened`` has (x - mean) on each of the first
    ``components`` eigenvectors of the covariance, over the root of its eigenvalue; ``explained`` has the eigenvalues as
    shares of the trace. ``deviation`` is the exact squared length of n x - sum. ``identity_error`` is the largest entry of
    the covariance of all whitened vectors minus the identity; it is measured in a pass of its own.

    Rows are left out whose vector is null or holds null, NaN, infinite entries or ones beyond 2^42, or whose length is
    not the most frequent one (of equally frequent ones the greatest). A vector of length 0 has no components. Where
    fewer eigenvalues than components are positive (constant or dependent dimensions, few vectors), the others are 0:
    their ``whitened`` is null and they are not in the identity error. A deviation that no long can hold is null. Null
    and repeated keys are rows of their own. An empty table gives no rows. Further columns are not read. Executors see
    one batch of vectors at a time and hold one matrix of the vectors' length, and so does the driver.
    """
    with scratch(rows.sparkSession) as kept:
        fitted, dims = fit_list(rows.select(F.col(key).alias("key"), F.col(vector).alias("v")), "v")
        schema = f"key {fitted.schema['key'].dataType.simpleString()}, n long, deviation long, whitened array<double>"
        n, sums = _sums(fitted, "v", dims) if dims else (0, [])
        if not n:
            values, vectors, trace = np.zeros(0), np.zeros((dims, 0)), 0.0
        else:
            covariance = _covariance(fitted, "v", n, sums)
            trace = float(np.trace(covariance))
            values, vectors = one_sided_jacobi(pivoted_cholesky(covariance))
        wanted = min(components, dims)
        values, vectors = np.pad(values[:wanted], (0, max(0, wanted - len(values)))), vectors[:, :wanted]
        full = int((values > 0).sum())
        means = np.array([s / n for s in sums]) if n else np.zeros(dims)
        middle = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64) if n else np.zeros(dims, np.int64)
        left = np.array([(s - n * int(m)) / n for s, m in zip(sums, middle)]) if n else means
        onto = vectors[:, :full] / np.sqrt(values[:full])
        # Integers wrap modulo 2^64, so the difference is exact wherever it fits.
        wrapped = np.array([(s + WRAP // 2) % WRAP - WRAP // 2 for s in sums], np.int64)

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _integers(batch.column(1), dims)
                far, exact = n * (x - means), np.int64(n) * x - wrapped
                deviation = pa.array((exact * exact).sum(axis=1), mask=(far * far).sum(axis=1) >= FITS)
                w = np.full((len(x), wanted), np.nan)
                w[:, :full] = ((x - middle) - left) @ onto
                flat = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * wanted), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(x), n)), deviation, lists], ["key", "n", "deviation", "whitened"])

        if not n or not wanted:
            out, seen = store(fitted.select("key", F.lit(fitted.count()).alias("n"), F.lit(0).cast("long").alias("deviation"),
                                            F.array().cast("array<double>").alias("whitened")), "whitened")
        else:
            out, seen = store(fitted.mapInArrow(task, schema), "whitened")
        kept.append(seen["path"])
        error = identity_error(out, full, n)
    share = [float(v / trace) if trace > 0 else 0.0 for v in values]

    def doubles(x: list[float]) -> Column:
        return F.array(*map(F.lit, x)).cast("array<double>")
    return out.select(F.col("key").alias(key), "n", "deviation", "whitened", doubles(share).alias("explained"), doubles(values.tolist()).alias("eigenvalues"),
                      F.array(*[doubles(c) for c in vectors.T.tolist()]).cast("array<array<double>>").alias("vectors"), doubles(means.tolist()).alias("means"),
                      F.lit(error).cast("double").alias("identity_error"))


def identity_error(whitened: DataFrame, full: int, n: int) -> float:
    """Largest absolute entry of the covariance of the whitened vectors' first ``full`` entries minus the identity."""
    if not full:
        return 0.0
    entries = [F.element_at("whitened", i + 1) for i in range(full)]
    mean = whitened.agg(*[F.avg(e).alias(f"m{i}") for i, e in enumerate(entries)]).first()
    centred = [e - F.lit(mean[f"m{i}"]) for i, e in enumerate(entries)]
    pairs = [(i, j) for i in range(full) for j in range(i, full)]
    found = whitened.agg(*[(F.sum(centred[i] * centred[j]) / n).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
