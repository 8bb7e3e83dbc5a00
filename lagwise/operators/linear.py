"""Linear fits on lagged values: one pass over the series builds each one's Gram matrix, all else works on that.

The Gram matrix is (tau_max + 1) * N + 1 numbers square, whatever the series' length; partial ones are summed before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .edge_arrays import lag_values


def lag_frames(series: DataFrame, by: list[str], tau_max: int, n_vars: int, value: str = "z") -> DataFrame:
    """(by, t, x): x holds the n_vars values at t, then those at t - 1, ..., t - tau_max; series are cut into blocks."""
    return lag_values(series, by, tau_max, value).where(F.size("x") == n_vars * (tau_max + 1))


def gram(frames: DataFrame, by: list[str], size: int) -> DataFrame:
    """(by, i, j, g): sums of products of the values, a constant 1 last."""
    schema = ", ".join([*[f"{k} {frames.schema[k].dataType.simpleString()}" for k in by], "i int, j int, g double"])

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, np.ndarray] = {}
        for part in parts:
            for key, rows in part.groupby(by, sort=False):
                x = np.vstack(rows["x"].to_numpy())
                x = np.hstack((x, np.ones((len(x), 1))))
                total[key] = total.get(key, 0) + x.T @ x
        for key, g in total.items():
            i, j = np.indices(g.shape)
            yield pd.DataFrame({**dict(zip(by, key, strict=True)), "i": i.ravel(), "j": j.ravel(), "g": g.ravel()})

    return frames.mapInPandas(partial, schema).groupBy(*by, "i", "j").agg(F.sum("g").alias("g"))


def _square(rows: pd.DataFrame) -> np.ndarray:
    n = int(rows["i"].max()) + 1
    g = np.zeros((n, n))
    g[rows["i"], rows["j"]] = rows["g"]
    return g


def _per_series(table: DataFrame, by: list[str], schema: str, of: Callable[[np.ndarray], list[tuple]]) -> DataFrame:
    """Rows of `schema` from each series' Gram matrix."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(of(_square(rows)), columns=names)
        for k, v in zip(by, key, strict=True):
            out[k] = v
        return out

    keys = ", ".join(f"{k} {table.schema[k].dataType.simpleString()}" for k in by)
    return table.groupBy(*by).applyInPandas(run, f"{schema}, {keys}")


def ridge(series: DataFrame, by: list[str], tau_max: int, n_vars: int, penalty: float = 1.0) -> DataFrame:
    """(by, tau, src, tgt, value): coefficients of each target's regression on all lagged values."""

    def solve(g: np.ndarray) -> list[tuple]:
        lagged = np.arange(n_vars, n_vars * (tau_max + 1))
        keep = np.append(lagged, len(g) - 1)
        a = g[np.ix_(keep, keep)] + np.diag([penalty] * len(lagged) + [0.0])
        beta = np.linalg.solve(a + 1e-12 * np.eye(len(a)), g[np.ix_(keep, np.arange(n_vars))])
        return [(int(i // n_vars), int(i % n_vars), t, float(beta[k, t])) for k, i in enumerate(lagged) for t in range(n_vars)]

    return _per_series(gram(lag_frames(series, by, tau_max, n_vars), by, n_vars * (tau_max + 1) + 1), by, "tau int, src int, tgt int, value double", solve)


def weighted_ridge(series: DataFrame, weights: DataFrame, by: list[str], tau_max: int, n_vars: int, penalty: float = 1.0) -> DataFrame:
    """(by, tau, src, tgt, value): coefficients of each target's regression on its lagged inputs times their weights.

    weights are (by, tau, src, tgt, weight). All targets share the series' Gram matrix G of the plain inputs: target i
    solves with D G D, where D holds its weights. An edge without weight has value 0.
    """

    def solve(key: tuple, sums: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        if not len(sums):
            return pd.DataFrame({c: [] for c in ("tau", "src", "tgt", "value", *by)})
        g, lagged = _square(sums), np.arange(n_vars, n_vars * (tau_max + 1))
        keep = np.append(lagged, len(g) - 1)
        w = np.zeros((n_vars, len(lagged)))
        w[edges["tgt"], (edges["tau"] - 1) * n_vars + edges["src"]] = edges["weight"]
        rows = []
        for t in range(n_vars):
            d = np.append(w[t], 1.0)
            a = d[:, None] * g[np.ix_(keep, keep)] * d + np.diag([penalty] * len(lagged) + [0.0])
            beta = np.linalg.solve(a + 1e-12 * np.eye(len(a)), d * g[keep, t])
            rows += [(int(k // n_vars) + 1, int(k % n_vars), t, float(beta[k]) if w[t, k] else 0.0, *key) for k in range(len(lagged))]
        return pd.DataFrame(rows, columns=["tau", "src", "tgt", "value", *by])

    sums = gram(lag_frames(series, by, tau_max, n_vars), by, n_vars * (tau_max + 1) + 1)
    kinds = ", ".join(f"{k} {series.schema[k].dataType.simpleString()}" for k in by)
    edges = weights.select(*by, "tau", "src", "tgt", "weight")
    return sums.groupBy(*by).cogroup(edges.groupBy(*by)).applyInPandas(solve, f"tau int, src int, tgt int, value double, {kinds}")


def _partial(c: np.ndarray, i: int, j: int, given: list[int]) -> float:
    """Correlation of i and j given others, from a covariance matrix."""
    keep = [i, j, *given]
    p = np.linalg.pinv(c[np.ix_(keep, keep)])
    d = p[0, 0] * p[1, 1]
    return float(np.clip(-p[0, 1] / math.sqrt(d), -1, 1)) if d > 0 else 0.0


def _chance(r: float, n: float, given: int) -> float:
    """Two-sided probability of so large a correlation by chance (Fisher's z)."""
    if abs(r) >= 1 or n - given - 3 <= 0:
        return 0.0 if abs(r) >= 1 else 1.0
    return math.erfc(abs(math.atanh(r)) * math.sqrt(n - given - 3) / math.sqrt(2))


def lag_graph(series: DataFrame, by: list[str], tau_max: int, n_vars: int, alpha: float = 0.05, most: int = 3) -> DataFrame:
    """(by, lag, src, tgt, edge_type, val, p): lagged edges that conditional-independence tests leave standing.

    First each target's candidate parents are pruned by tests given up to `most` of the strongest other candidates; then
    every remaining edge is tested given the target's other parents and the source's own, as far as these lie in the lags.
    """

    def find(g: np.ndarray) -> list[tuple]:
        n = g[-1, -1]
        mean = g[:-1, -1] / n
        c = g[:-1, :-1] / n - np.outer(mean, mean)
        parents: dict[int, list[int]] = {}
        for tgt in range(n_vars):
            left = list(range(n_vars, n_vars * (tau_max + 1)))
            size = {i: abs(_partial(c, i, tgt, [])) for i in left}
            for k in range(most + 1):
                left.sort(key=lambda i: (-size[i], i))
                for i in list(left):
                    given = [x for x in left if x != i][:k]
                    if len(given) < k:
                        continue
                    r = _partial(c, i, tgt, given)
                    size[i] = min(size[i], abs(r))
                    if _chance(r, n, k) > alpha:
                        left.remove(i)
            parents[tgt] = left
        out = []
        for tgt, left in parents.items():
            for i in left:
                tau, src = divmod(i, n_vars)
                shifted = [x + tau * n_vars for x in parents[src] if x + tau * n_vars < len(c)]
                given = sorted({*[x for x in left if x != i], *[x for x in shifted if x != i]})
                r = _partial(c, i, tgt, given)
                p = _chance(r, n, len(given))
                if p <= alpha:
                    out.append((tau, src, tgt, "-->", r, p))
        return out

    return _per_series(gram(lag_frames(series, by, tau_max, n_vars), by, n_vars * (tau_max + 1) + 1), by, "lag int, src int, tgt int, edge_type string, val double, p double", find)


def apply_model(frames: DataFrame, by: list[str], model: Callable[[np.ndarray], np.ndarray], n_vars: int) -> DataFrame:
    """(by, t, tgt, predicted) by a fitted model that maps a batch of lag frames (rows x values) to targets (rows x n_vars)."""
    schema = ", ".join([*[f"{k} {frames.schema[k].dataType.simpleString()}" for k in by], "t long, tgt int, predicted double"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                y = np.asarray(model(np.vstack(part["x"].to_numpy())), float)
                out = part.loc[part.index.repeat(n_vars), [*by, "t"]].reset_index(drop=True)
                yield out.assign(tgt=np.tile(np.arange(n_vars), len(part)), predicted=y.ravel())

    return frames.mapInPandas(run, schema)
