"""Whitening of embeddings through Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

A is the matrix of the fit list's rows, less their means. A step multiplies A by a right vector v, makes the left vector
orthogonal to all former ones, and multiplies the transposed A by it; the new right vector is made orthogonal to all
former ones twice. Left vectors have an entry for each row, so they are never stored: each is A w for a w as short as a
row, and each task makes what it needs of them from its own rows. One job makes a step: of each partition it sums
Au . Av for all former left vectors u, the square of Av, and A'(Av). A vector that is not yet orthogonal enough goes
through a second job. The SVD of the small bidiagonal matrix gives the components and their deviations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, scratch

COMPONENTS, FACTOR = 4, 256
#: Up to so many dimensions all steps are made, so that no repeated eigenvalue is missed; beyond, they end when the components stand.
ALL_STEPS = 512
#: Entries of larger size than this, times FACTOR, are no 64-bit numbers.
_LARGEST = float(1 << 62)


def packed(vectors: DataFrame, key: str, vector: str, factor: int) -> DataFrame:
    """(key, x): the entries times factor, rounded down, of vectors whose entries all are finite numbers.

    x is the width of an entry (2, 4 or 8 bytes, the least that will do) and the entries but for zeros at the end, so
    that equal vectors have equal bytes. A shorter vector counts as one that ends in zeros.
    """
    v = F.col(vector).cast("array<double>")
    good = v.isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) * factor >= F.lit(_LARGEST)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.column("v"):
                x = np.floor(factor * row.values.to_numpy(zero_copy_only=False)).astype(np.int64)
                x = x[: np.flatnonzero(x)[-1] + 1] if x.any() else x[:0]
                most = max(-int(x.min()) - 1, int(x.max())) if len(x) else 0
                width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
                out.append(bytes([width]) + x.astype(f"<i{width}").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(out, pa.binary())], names=["k", "x"])

    return vectors.where(good).select(F.col(key).cast("long").alias("k"), v.alias("v")).mapInArrow(run, "k long, x binary")


def unpacked(column: pa.Array, d: int) -> np.ndarray:
    """The integers of packed rows, d for each."""
    data = column.to_pylist()
    out = np.zeros((len(data), d), np.int64)
    by: dict[tuple[int, int], list[int]] = {}
    for i, x in enumerate(data):
        by.setdefault((x[0], len(x)), []).append(i)
    for (width, size), at in by.items():
        if size > 1:
            rows = np.frombuffer(b"".join([data[i][1:] for i in at]), f"<i{width}").reshape(len(at), -1)
            out[at, : rows.shape[1]] = rows
    return out


def _sums(fit: DataFrame, part: Callable[[np.ndarray], np.ndarray], size: int, d: int) -> np.ndarray:
    """The sums over all batches of a vector of `size` numbers that `part` makes of a batch of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += part(unpacked(batch.column("x"), d))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], names=["i", "v"])

    out = np.zeros(size)
    for r in fit.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out


def totals(fit: DataFrame, d: int) -> tuple[int, int, list[int]]:
    """The number of rows, the largest size of an entry, and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, most, high, low = 0, 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            x = unpacked(batch.column("x"), d)
            n += len(x)
            most = max(most, int(np.abs(x).max())) if x.size else most
            high += (x >> 31).sum(axis=0)
            low += (x & (1 << 31) - 1).sum(axis=0)
        columns = [np.arange(d + 1), np.append(high, n), np.append(low, 0), np.full(d + 1, most)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["i", "high", "low", "most"])

    found = fit.mapInArrow(run, "i long, high long, low long, most long").groupBy("i")
    rows = {r["i"]: r for r in found.agg(F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"), F.max("most").alias("most")).collect()}
    if d not in rows:
        return 0, 0, [0] * d
    return int(rows[d]["high"]), rows[d]["most"], [(int(rows[i]["high"]) << 31) + int(rows[i]["low"]) for i in range(d)]


def _orthogonal(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
    for _ in range(2):
        v = v - basis.T @ (basis @ v)
    return v


def bidiagonalise(product: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, float, np.ndarray]], d: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(deviations times the root of the number of rows, falling; components as rows).

    product(w, W) gives, of y = A w, the products of A W' with y, y . y, and A' y.
    """
    random = np.random.default_rng(12)
    v = random.standard_normal(d)
    v /= np.linalg.norm(v)
    right, left, images = np.zeros((0, d)), np.zeros((0, d)), np.zeros((0, d))  # v; w of u = A w; A' u
    alphas: list[float] = []
    betas: list[float] = []  # between a vector and the next one
    of: list[int] = []  # which of `left` belongs to a right vector; -1: its product is 0
    scale = 0.0
    while True:
        k = len(alphas)
        right = np.vstack((right, v))
        w = v.copy()
        if k and betas[-1] and of[-1] >= 0:
            w -= betas[-1] * left[of[-1]]
        c, square, back = product(w, left)
        scale = max(scale, np.sqrt(square))
        for _ in range(3):
            if c @ c <= 1e-20 * square:
                break
            w = w - c @ left  # a second job: what was left of former vectors was too much for one
            c, square, back = product(w, left)
        alpha = np.sqrt(max(square - c @ c, 0.0))
        if alpha <= 1e-13 * scale or not scale:
            alphas.append(0.0)
            of.append(-1)
            rest = np.zeros(d)
        else:
            of.append(len(left))
            left = np.vstack((left, (w - c @ left) / alpha))
            images = np.vstack((images, (back - c @ images) / alpha))
            alphas.append(alpha)
            rest = _orthogonal(images[-1] - alpha * v, right)
        beta = float(np.linalg.norm(rest))
        if len(alphas) == d:
            beta = 0.0
        if len(alphas) == d or d > ALL_STEPS and k > 2 * wanted:
            p, s, q = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1) if k else np.array([alphas]))
            if len(alphas) == d or (beta * np.abs(p[-1, :wanted]) <= 1e-15 * s[0]).all():
                return s[:wanted], q[:wanted] @ right
        if beta > 1e-13 * scale:
            v = rest / beta
        else:  # what v reaches is complete: go on with another direction
            beta = 0.0
            v = _orthogonal(random.standard_normal(d), right)
            v /= np.linalg.norm(v)
        betas.append(beta)


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, factor: int = FACTOR) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each row that counts and each component.

    Rows whose vector is null, or holds a null, NaN, infinity or an entry of 2^62 / factor or more, are left out; a row
    without a key stays. Vectors that are shorter than others count as if they ended in zeros. Repeated rows each give
    their rows, but enter the fit once. Only components with a deviation above 0 exist: an empty table, equal vectors
    or empty vectors give no rows. deviation is null where it exceeds 64 bits. Other columns are not read.
    """
    spark = df.sparkSession
    rows = scratch(packed(df, key, vector, factor), "integers")
    d = _width(rows)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not d:
        return spark.createDataFrame([], schema)
    fit = scratch(rows.select("x").distinct(), "fit")
    n, most, sums = totals(fit, d)
    mean = np.array([s / n for s in sums])

    def product(w: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        k = len(left)

        def part(x: np.ndarray) -> np.ndarray:
            a = x - mean
            y = a @ w
            return np.concatenate(((a @ left.T).T @ y, [y @ y], y @ a))

        out = _sums(fit, part, k + 1 + d, d)
        return out[:k], out[k], out[k + 1 :]

    deviations, found = bidiagonalise(product, d, min(components, d))
    many = int((deviations > 1e-12 * max(deviations[0], 1e-300)).sum()) if deviations[0] > 0 else 0
    if not many:
        return spark.createDataFrame([], schema)
    found, deviations = found[:many], deviations[:many]
    # scaled to unit variance: deviations of the rows' projections are deviations / sqrt(n)
    project = (found / (deviations / np.sqrt(n))[:, None]).T

    def spread(x: np.ndarray) -> np.ndarray:
        a = x - mean
        y = a @ project
        return np.concatenate(((y.T @ y).ravel(), y.sum(axis=0), [(a * a).sum()]))

    out = _sums(fit, spread, many * many + many + 1, d)
    centre = out[many * many : -1] / n
    covariance = out[: many * many].reshape(many, many) / n - np.outer(centre, centre)
    error = float(np.abs(covariance - np.eye(many)).max())
    explained = deviations**2 / out[-1]
    narrow = (n * most + max(map(abs, sums))) ** 2 * d < 1 << 63
    exact = np.array(sums, np.int64 if narrow else object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unpacked(batch.column("x"), d)
            y = ((x - mean) @ project).ravel()
            far = n * (x if narrow else x.astype(object)) - exact
            far = (far * far).sum(axis=1)
            far = far.tolist() if narrow else [f if f < 1 << 63 else None for f in far]
            m = len(x)
            every = [
                batch.column("k").take(pa.array(np.repeat(np.arange(m), many))),
                pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), m)),
                pa.array(np.full(m * many, n)),
                pa.array([f for f in far for _ in range(many)], pa.int64()),
                pa.array(y),
                pa.array(np.tile(explained, m)),
                pa.array(np.full(m * many, error)),
            ]
            yield pa.RecordBatch.from_arrays(every, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    drop(fit)
    return rows.mapInArrow(run, schema)


def _width(rows: DataFrame) -> int:
    """The largest number of entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 0
        for batch in batches:
            most = max([most, *((len(x) - 1) // x[0] for x in batch.column("x").to_pylist())])
        yield pa.RecordBatch.from_arrays([pa.array([most])], names=["d"])

    return rows.select("x").mapInArrow(run, "d long").agg(F.max("d")).first()[0] or 0
