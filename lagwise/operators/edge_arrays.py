"""Edges as arrays: one row for a time and target, its edges in arrays; never a row for an edge and time.

Place (tau - 1) * n + src of an array is the edge from src, tau rows before. The values of the last rows, newest first, lie
in the same order, so an edge's input is the value at its place. Series are (by, var, t, z); edge rows are
(by, t, tgt, w, v, actual): weights, inputs and what is to be forecast. Sums over edges stay within a row, sums over
targets are as many columns as there are edges of one target, and sums over time are made of arrays in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks

EDGES = ["tau", "src", "tgt"]


def lag_values(series: DataFrame, by: list[str], depth: int, value: str = "z", size: int = blocks.SIZE) -> DataFrame:
    """(by, t, x): the values at t, then those at each of up to `depth` rows before, newest first."""
    frames = series.groupBy(*by, "t").agg(F.expr(f"transform(array_sort(collect_list(struct(var, {value} as v))), s -> s.v)").alias("xs"))
    rows, keys = blocks.with_halo(frames, by, depth, size=size)
    last = Window.partitionBy(*keys).orderBy("t").rowsBetween(-depth, 0)
    return rows.withColumn("x", F.collect_list("xs").over(last)).where("_own").select(*by, "t", F.flatten(F.reverse("x")).alias("x"))


def packed(edges: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by, tgt, columns as arrays) of an edge table."""
    rows = edges.groupBy(*by, "tgt").agg(F.array_sort(F.collect_list(F.struct("tau", "src", *columns))).alias("_e"))
    return rows.select(*by, "tgt", *[F.col(f"_e.{c}").alias(c) for c in columns])


def unpacked(rows: DataFrame, keep: list[str], columns: list[str], n: int) -> DataFrame:
    """A row for each edge, for results: (keep, tau, src, columns)."""
    at = rows.select(*keep, F.posexplode(F.arrays_zip(*columns)).alias("_i", "_e"))
    return at.select(*keep, (F.floor(F.col("_i") / n) + 1).cast("int").alias("tau"), (F.col("_i") % n).cast("int").alias("src"), *[F.col(f"_e.{c}").alias(c) for c in columns])


def softmax(logit: str, gate: str, temperature: float = 1.0) -> str:
    """Weights of one target from arrays: exp of the logits, times the gates, over their sum."""
    # transform(array(a), x -> ...)[0] names a value that a lambda uses more than once
    e = f"transform(array(array_max({logit})), m -> zip_with({logit}, {gate}, (l, g) -> exp((l - m) / {temperature!r}D) * g))[0]"
    return f"transform(array({e}), e -> transform(array(aggregate(e, 0D, (s, y) -> s + y) + 1e-12D), m -> transform(e, x -> x / m))[0])[0]"


def normal(a: str, own: str) -> str:
    """Shares of the positive parts; without any, all on the place `own`."""
    p = f"transform({a}, x -> greatest(x, 0D))"
    return f"transform(array({p}), p -> transform(array(aggregate(p, 0D, (s, y) -> s + y)), m -> transform(p, (x, i) -> case when m > 1e-12D then x / m when i = {own} then 1D else 0D end))[0])[0]"


def similarity(series: DataFrame, by: list[str], n: int, tau_max: int, width: int, size: int = blocks.SIZE) -> DataFrame:
    """(by, t, tgt, similarity): products of source and target over the `width` rows that end tau before t; null where there are none."""
    rows = lag_values(series, by, tau_max + width - 1, size=size).select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("tgt"))
    far = f"(i div {n} + 1 + k) * {n}"
    one = f"aggregate(sequence(0, {width - 1}), 0D, (s, k) -> s + coalesce(get(x, cast({far} + i % {n} as int)) * get(x, cast({far} + tgt as int)), 0D))"
    some = f"transform(sequence(0, {tau_max * n - 1}), i -> case when size(x) > (i div {n} + 1) * {n} then {one} / sqrt({width}D) end)"
    return rows.select(*by, "t", "tgt", F.expr(some).alias("similarity"))


def weights_at(similar: DataFrame, parameters: DataFrame, by: list[str]) -> DataFrame:
    """(by, t, tgt, w): weights at each time; parameters are (by, tgt, logit, gate) in arrays. No similarity yet counts as 0."""
    rows = similar.join(parameters, [*by, "tgt"]).withColumn("l", F.expr("zip_with(logit, similarity, (l, s) -> l + coalesce(s, 0D))"))
    return rows.select(*by, "t", "tgt", F.expr(softmax("l", "gate")).alias("w"))


def edge_rows(series: DataFrame, weights: DataFrame, by: list[str], n: int, tau_max: int, size: int = blocks.SIZE) -> DataFrame:
    """(by, t, tgt, w, v, actual) at the times that have all lags; weights are (by, tgt, w)."""
    rows = lag_values(series, by, tau_max, size=size).where(F.size("x") == n * (tau_max + 1))
    return rows.join(weights, by).select(*by, "t", "tgt", "w", F.slice("x", n + 1, n * tau_max).alias("v"), F.expr("x[tgt]").alias("actual"))


EFFECT = "zip_with(w, v, (a, b) -> a * b)"
STRENGTH = "zip_with(w, v, (a, b) -> a * abs(b))"


def forecasts(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, t, tgt, actual, predicted, err, w, v)"""
    out = rows.withColumn("predicted", F.expr(f"aggregate({EFFECT}, 0D, (s, y) -> s + y)"))
    return out.withColumn("err", F.col("actual") - F.col("predicted")).select(*by, "t", "tgt", "actual", "predicted", "err", "w", "v")


def means(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, columns): the mean over rows of each place of the arrays; partial sums are made in Arrow batches."""
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            named = list(zip(*[batch.column(k).to_pylist() for k in keys], strict=True))
            found: dict[tuple, int] = {}
            group = np.array([found.setdefault(k, len(found)) for k in named])
            for c, column in enumerate(columns):
                a = batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                sums = np.zeros((len(found), a.shape[1]))
                np.add.at(sums, group, a)
                for k, i in found.items():
                    state = total.setdefault(k, [0, *[0.0] * len(columns)])
                    state[c + 1] = state[c + 1] + sums[i]
            for k, n in zip(found, np.bincount(group), strict=True):
                total[k][0] += int(n)
        rows_ = [(*k, n, i, *[float(a[i]) for a in arrays]) for k, (n, *arrays) in total.items() for i in range(len(arrays[0]))]
        columns_ = list(zip(*rows_, strict=True)) or [[] for _ in range(len(keys) + 2 + len(columns))]
        types = [*[rows_schema[k] for k in keys], pa.int64(), pa.int32(), *[pa.float64()] * len(columns)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns_, types, strict=True)], names=[*keys, "_n", "_i", *columns])

    from pyspark.sql.pandas.types import to_arrow_type

    rows_schema = {k: to_arrow_type(rows.schema[k].dataType) for k in keys}
    sums = rows.select(*keys, *columns).mapInArrow(partial, f"{kinds}, _n long, _i int, {', '.join(f'{c} double' for c in columns)}")
    each = sums.groupBy(*keys, "_i").agg(F.sum("_n").alias("_n"), *[F.sum(c).alias(c) for c in columns])
    each = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", *[(F.col(c) / F.col("_n")).alias(c) for c in columns]))).alias("_e"))
    return each.select(*keys, *[F.col(f"_e.{c}").alias(c) for c in columns])


def contributions(found: DataFrame, by: list[str], fill: str = "0D") -> DataFrame:
    """(by, tgt, raw_delta, positive_delta): what each edge's error grows by, in the mean, when its input is `fill`; found are forecasts()."""
    deltas = found.withColumn("d", F.expr(f"zip_with(w, v, (a, b) -> abs(err + a * b - a * {fill}) - abs(err))"))
    return means(deltas.select(*by, "tgt", F.col("d").alias("raw_delta"), F.expr("transform(d, x -> greatest(x, 0D))").alias("positive_delta")), [*by, "tgt"], ["raw_delta", "positive_delta"])


def deviations(rows: DataFrame, reference: DataFrame, by: list[str], n: int, tau_max: int, top: int, runs: list[str] = ()) -> DataFrame:
    """(by, runs, t, c_mean, c_max, row_mean, top_mean) of (by, t, tgt, a) from (by, runs, tgt, ref).

    Each lag's deviation is the root mean square over its edges, then the mean and the largest over lags; a lag's rows
    are sources with their mean deviation over targets, of which the largest and the `top` largest count.
    """
    size = n * tau_max
    d = rows.join(reference, [*by, "tgt"]).select(*by, *runs, "t", F.expr("zip_with(a, ref, (x, y) -> x - y)").alias("d"))
    squares = [F.sum(F.expr(f"aggregate(slice(d, {u * n + 1}, {n}), 0D, (s, x) -> s + x * x)")).alias(f"_s{u}") for u in range(tau_max)]
    sizes = [F.sum(F.abs(F.col("d")[i])).alias(f"_r{i}") for i in range(size)]
    sums = d.groupBy(*by, *runs, "t").agg(*squares, *sizes)
    fro = F.array(*[F.sqrt(F.col(f"_s{u}") / (n * n) + 1e-12) for u in range(tau_max)])
    by_lag = [F.sort_array(F.array(*[F.col(f"_r{u * n + s}") / n for s in range(n)]), asc=False) for u in range(tau_max)]
    mean = lambda a, k: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / k
    rows_ = F.array(*[F.struct(r[0].alias("max"), mean(F.slice(r, 1, top), min(top, n)).alias("top")) for r in by_lag])
    out = sums.select(*by, *runs, "t", fro.alias("_f"), rows_.alias("_l"))
    return out.select(*by, *runs, "t", mean(F.col("_f"), tau_max).alias("c_mean"), F.array_max("_f").alias("c_max"), mean(F.col("_l.max"), tau_max).alias("row_mean"), mean(F.col("_l.top"), tau_max).alias("top_mean"))


def error_scores(found: DataFrame, by: list[str], top: int) -> DataFrame:
    """(by, t, p_mean, p_max, p_top): mean, largest and mean of the `top` largest errors of a time; found are forecasts()."""
    sizes = found.groupBy(*by, "t").agg(F.sort_array(F.collect_list(F.abs("err")), asc=False).alias("e"))
    mean = "aggregate({a}, 0D, (s, x) -> s + x) / size({a})"
    return sizes.selectExpr(*by, "t", mean.format(a="e") + " as p_mean", "e[0] as p_max", mean.format(a=f"slice(e, 1, {top})") + " as p_top")


def fold(batches: DataFrame, by: list[str], beta: float, normalised: bool, own: str = "tgt") -> DataFrame:
    """(by, tgt, epoch, ref): the reference after each epoch's batch, in order.

    batches are (by, tgt, start, steps): steps is an array of structs (epoch, a), a null where a batch knows nothing of
    an edge: there the reference before stays, at first `start`. The first batch is taken whole; each further one
    enters with the share 1 - beta (all, if beta is 0 or less). With `normalised`, shares are taken before and after.
    """
    shares = (lambda a: normal(a, own)) if normalised else (lambda a: a)
    new = shares("zip_with(b.a, last, (g, l) -> coalesce(g, l))")
    keep = max(beta, 0.0)
    mixed = shares(f"zip_with(last, new, (l, m) -> {keep!r}D * l + {1 - keep!r}D * m)")
    step = f"transform(array(element_at(acc, -1)), last -> transform(array({new}), new -> case when size(acc) = 1 then new else {mixed} end)[0])[0]"
    refs = f"aggregate(array_sort(steps), array(start), (acc, b) -> array_append(acc, {step}))"
    out = batches.select(*by, "tgt", F.expr("transform(array_sort(steps), s -> s.epoch)").alias("_n"), F.expr(refs).alias("_r"))
    out = out.select(*by, "tgt", F.explode(F.arrays_zip(F.col("_n").alias("epoch"), F.slice("_r", F.lit(2), F.size("_n")).alias("ref"))).alias("_x"))
    return out.select(*by, "tgt", F.col("_x")["epoch"].alias("epoch"), F.col("_x")["ref"].alias("ref"))
