"""Scans, halos, stitched runs and level segments in small blocks, against one pass over each whole series."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagwise.operators import blocks, draws, edge_arrays, ingest, levels, linear, quality, segments, windows

BY = ["k"]


@pytest.fixture(scope="module")
def series():
    """Per key: times with gaps, values with nulls; one key of a single row, one of nulls only."""
    r = random.Random(3)
    out = {}
    for k, n in (("a", 137), ("b", 40), ("c", 1), ("d", 12)):
        t, rows = -7, []
        for _ in range(n):
            t += r.choice([1, 1, 1, 2, 9])
            rows.append((t, None if k == "d" or r.random() < 0.4 else r.randint(0, 9)))
        out[k] = rows
    return out


@pytest.fixture(scope="module")
def frame(spark, series):
    rows = [(k, t, x) for k, s in series.items() for t, x in s]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "k string, t long, x long").repartition(3).cache()


@pytest.mark.parametrize("size", [1, 5, 64, 1 << 16])
def test_windows_do_not_depend_on_blocks(frame, series, size):
    got = {(r["k"], r["t_end"]): r["xs"] for r in windows.sliding(frame.fillna(-1), BY, 4, "x", size).collect()}
    want = {(k, s[i][0]): [-1 if x is None else x for _, x in s[i - 3 : i + 1]] for k, s in series.items() for i in range(3, len(s))}
    assert got == want
    got = {(r["k"], r["t"]): r["xs"] for r in windows.lag_windows(frame, BY, 2, 3, 10, size).collect()}
    assert got == {(k, s[i][0]): [x for _, x in s[max(0, i - 4) : max(0, i - 1)] if x is not None] for k, s in series.items() for i in range(len(s))}
    pairs = windows.lagged_pairs(frame.withColumn("var", F.lit(0)), BY, 3, size)
    got = sorted((r["k"], r["t"], r["tau"], -1 if r["y"] is None else r["y"], r["x"]) for r in pairs.collect())
    assert got == sorted((k, s[i][0], u, -1 if s[i][1] is None else s[i][1], s[i - u][1]) for k, s in series.items() for u in (1, 2, 3) for i in range(u, len(s)) if s[i - u][1] is not None)


@pytest.mark.parametrize("size", [1, 5, 1 << 16])
def test_values_are_carried_over_blocks(frame, series, size):
    got = {(r["k"], r["t"]): float(r["x"]) for r in ingest.interpolate(frame, BY, size=size).collect()}
    for k, s in series.items():
        known = [(t, x) for t, x in s if x is not None]
        for t, x in s:
            a, b = ([p for p in known if p[0] <= t] or [None])[-1], ([p for p in known if p[0] >= t] or [None])[0]
            want = x if x is not None else 0 if not known else a[1] if b is None else b[1] if a is None else a[1] + (b[1] - a[1]) * (t - a[0]) / (b[0] - a[0])
            assert got[k, t] == pytest.approx(want)


@pytest.mark.parametrize("size", [1, 4, 1 << 16])
def test_runs_are_stitched(frame, series, size):
    labels = frame.withColumn("y", (F.coalesce("x", F.lit(0)) > 2).cast("int"))
    got = sorted((r["k"], r["seg_id"], r["s"], r["e"]) for r in segments.runs(labels, BY, size=size).collect())
    want = []
    for k, s in series.items():
        found = []
        for t in [t for t, x in s if (x or 0) > 2]:
            if found and found[-1][1] == t - 1:
                found[-1][1] = t
            else:
                found.append([t, t])
        want += [(k, i + 1, *f) for i, f in enumerate(found)]
    assert got == sorted(want)


@pytest.mark.parametrize("size", [3, 1 << 16])
def test_running_sums_by_value_and_neighbours(frame, series, size):
    given = frame.where("x is not null").groupBy("k", "x").agg(F.count(F.lit(1)).alias("n"))
    cut = blocks.by_value(given, BY, "x", size)
    got = {(r["k"], r["x"]): (r["at"], r["all"]) for r in blocks.running(cut, BY, [F.col("x").desc()], {"at": F.col("n")}, {"all": "at"}).collect()}
    for k, s in series.items():
        xs = [x for _, x in s if x is not None]
        assert all(got[k, x] == (sum(y >= x for y in xs), len(xs)) for x in xs)
    near = {(r["k"], r["t"]): (r["p"], r["q"]) for r in blocks.beside(frame, BY, "t", {"p": ("x", -1), "q": ("x", 1)}, size).collect()}
    for k, s in series.items():
        for i, (t, _) in enumerate(s):
            assert near[k, t] == (s[i - 1][1] if i else None, s[i + 1][1] if i + 1 < len(s) else None)


@pytest.mark.parametrize("size", [1, 4, 7, 1 << 16])
def test_level_segments(spark, size):
    r = random.Random(size)
    series = {k: [(r.choice([0, 1, 2, 50, 99, 100]) if r.random() < 0.7 else 100, int(r.random() < 0.4)) for _ in range(n)] for k, n in (("a", 1), ("b", 30), ("c", 61))}
    rows = [(k, i, y, v) for k, s in series.items() for i, (v, y) in enumerate(s)]
    pts = spark.createDataFrame(rows, "k string, i long, y int, nb int")
    got = set()
    for x in levels.levels(pts, BY, ("run", "gap"), size).collect():
        for th in range(x["lo"], x["hi"] + 1):
            key = (x["k"], x["kind"], th, x["s"], x["e"], *((x["hits"], x["card"]) if x["kind"] == 0 else ()))
            assert key not in got
            got.add(key)
    want = set()
    for k, s in series.items():
        for th in range(100):
            for kind in (0, 1):
                on = [(v > th) == (kind == 0) for v, _ in s]
                i = 0
                while i < len(s):
                    j = i
                    while j < len(s) and on[j]:
                        j += 1
                    if j > i:
                        ys = [y for _, y in s[i:j]]
                        want.add((k, kind, th, i, j - 1, *((sum(ys), sum(y and not (n and ys[n - 1]) for n, y in enumerate(ys))) if kind == 0 else ())))
                    i = max(j, i + 1)
    assert got == want


def test_quality_does_not_depend_on_blocks(spark):
    r = random.Random(8)
    rows = []
    for k, n in (("a", 90), ("b", 33), ("c", 5)):
        y = 0
        for t in range(n):
            y = y if r.random() < 0.7 else 1 - y
            rows.append((k, t, y if k != "c" else 0, round(r.random() * (1 + y), 2)))
    scores = spark.createDataFrame(rows, "k string, t long, y int, score double").cache()
    for f in (quality.rank_metrics, quality.sweep, quality.range_scores, quality.affiliation_zones):
        small, whole = ([{c: v for c, v in x.asDict().items()} for x in f(scores, BY, s).collect()] for s in (7, 1 << 16))
        key = lambda d: (d["k"], d.get("th", 0), d.get("seg") or 0)
        small, whole = sorted(small, key=key), sorted(whole, key=key)
        assert len(small) == len(whole) > 0
        for a, b in zip(small, whole, strict=True):
            assert a.keys() == b.keys() and all(a[c] == b[c] or a[c] == pytest.approx(b[c], abs=1e-9) for c in a)


def test_one_long_series_uses_all_tasks(spark):
    rows = spark.range(200_000).selectExpr("'a' as k", "id as t", "id % 7 as x")
    out = windows.sliding(rows, BY, 3, "x", size=4096)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table would be put into one
    try:
        parts = out.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) == 4 and max(r["count"] for r in parts) < 120_000 and sum(r["count"] for r in parts) == 199_998


def test_weighted_fit_against_least_squares(spark):
    r = np.random.default_rng(4)
    x = r.standard_normal((60, 2))
    series = spark.createDataFrame([("a", v, t, float(x[t, v])) for t in range(60) for v in (0, 1)], "k string, var int, t long, z double")
    w = {(u, s, g): float(r.random()) for u in (1, 2) for s in (0, 1) for g in (0, 1)}
    w[2, 1, 0] = 0.0
    edges = spark.createDataFrame([("a", *e, v) for e, v in w.items()], "k string, tau int, src int, tgt int, weight double")
    got = {(e["tau"], e["src"], e["tgt"]): e["value"] for e in linear.weighted_ridge(series, edges, BY, 2, 2).collect()}
    places = [(1, 0), (1, 1), (2, 0), (2, 1)]
    for g in (0, 1):
        a = np.column_stack([*[w[u, s, g] * x[2 - u : 60 - u, s] for u, s in places], np.ones(58)])
        beta = np.linalg.solve(a.T @ a + np.diag([1.0] * 4 + [0.0]), a.T @ x[2:, g])
        assert all(got[u, s, g] == pytest.approx(beta[i] if w[u, s, g] else 0, abs=1e-8) for i, (u, s) in enumerate(places))


def test_references_fold_over_ten_batches(spark):
    r = np.random.default_rng(7)
    steps = [[None if r.random() < 0.3 else float(r.random()) for _ in range(4)] for _ in range(10)]
    start = [0.1, 0.2, 0.3, 0.4]
    df = spark.createDataFrame([("a", 1, start, [(e + 1, a) for e, a in reversed(list(enumerate(steps)))])], "k string, tgt int, start array<double>, steps array<struct<epoch:int,a:array<double>>>")
    share = lambda a: np.maximum(a, 0) / np.maximum(a, 0).sum()
    for normalised in (False, True):
        got = {x["epoch"]: x["ref"] for x in edge_arrays.fold(df, BY, 0.9, normalised).collect()}
        ref = np.array(start)
        for e, a in enumerate(steps):
            new = np.array([o if b is None else b for o, b in zip(ref, a, strict=True)])
            new = share(new) if normalised else new
            ref = new if e == 0 else 0.9 * ref + 0.1 * new
            ref = share(ref) if normalised and e else ref
            assert got[e + 1] == pytest.approx(ref.tolist())


def test_draws_follow_the_gates(spark):
    prior = spark.createDataFrame([("a", 1, 0, 0, 0.6), ("a", 1, 1, 0, 0.3), ("a", 2, 0, 0, 0.0), ("a", 2, 1, 0, 0.1), ("b", 1, 0, 0, 0.0), ("b", 1, 1, 0, 0.0)], "k string, tau int, src int, tgt int, gate double")
    runs = spark.createDataFrame([("a", 1), ("b", 1)], "k string, seed int")
    got = [(x["k"], x["tau"], x["src"]) for x in draws.sampled_edges(prior, runs, BY, ["seed"], 4000).collect()]
    rate = lambda *e: got.count(e) / 4000
    assert abs(rate("a", 1, 0) - 0.6) < 0.04 and abs(rate("a", 1, 1) - 0.3) < 0.04 and abs(rate("a", 2, 1) - 0.1) < 0.03 and rate("a", 2, 0) == 0
    assert abs(rate("b", 1, 0) - 0.5) < 0.04
    series = spark.createDataFrame([("a", t, float(t)) for t in range(23)], "k string, t long, z double")
    out = sorted((x["t"], x["before"], x["after"]) for x in draws.permuted(series, BY, 10, 5, size=4).collect())
    assert [b for _, b, _ in out] == list(range(23)) and out != [(t, t, t) for t in range(23)]
    assert all(sorted(a for t, _, a in out if t // 10 == k) == [t for t in range(23) if t // 10 == k] for k in range(3))
