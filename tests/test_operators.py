"""Hand-checked cases and invariants."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagwise.operators import edges, ingest, linear, prior, report, segments, windows
from lagwise.operators import quality as ql

BY = ["entity"]


def labels(spark, *series):
    return spark.createDataFrame([(e, t, y) for e, ys in enumerate(series) for t, y in enumerate(ys)], "entity int, t long, y int")


def scored(spark, *series):
    return spark.createDataFrame([(e, t, y, float(s)) for e, (ys, ss) in enumerate(series) for t, (y, s) in enumerate(zip(ys, ss, strict=True))], "entity int, t long, y int, score double")


def test_segments_by_hand(spark):
    runs = segments.runs(labels(spark, [0, 1, 1, 0, 0, 1, 0], [1, 1, 1], [0, 0], [1, 0, 1]), BY)
    assert sorted((r["entity"], r["s"], r["e"], r["e_excl"]) for r in runs.collect()) == [(0, 1, 2, 3), (0, 5, 5, 6), (1, 0, 2, 3), (3, 0, 0, 1), (3, 2, 2, 3)]
    entities = spark.createDataFrame([(0,), (2,)], "entity int")
    assert {r["entity"]: r["width"] for r in segments.median_length(runs, entities, BY).collect()} == {0: 1, 2: 100}


def test_environments_are_not_ntile(spark):
    w = spark.createDataFrame([(0, i) for i in range(10)], "entity int, win long")
    assert [r["env"] for r in windows.environments(w, BY, 4).orderBy("win").collect()] == [0, 0, 0, 1, 1, 2, 2, 2, 3, 3]
    assert {r["env"] for r in windows.environments(w, BY, 1).collect()} == {0}


def test_sliding_windows(spark):
    df = spark.createDataFrame([(e, t, float(t)) for e, n in ((0, 5), (1, 2)) for t in range(n)], "entity int, t long, xs double")
    assert [(r["win"], r["t_end"], r["xs"]) for r in windows.sliding(df, BY, 3).orderBy("win").collect()] == [(0, 2, [0.0, 1.0, 2.0]), (1, 3, [1.0, 2.0, 3.0]), (2, 4, [2.0, 3.0, 4.0])]


def test_first_point_keeps_its_own_prediction(spark):
    df = spark.createDataFrame([(0, t, y, p) for t, (y, p) in enumerate([(1, 0), (1, 1), (0, 0), (1, 0), (1, 1)])], "entity int, t long, y int, pred int")
    assert [r["adjusted"] for r in ql.adjust(df, BY).orderBy("t").collect()] == [0, 1, 0, 1, 1]


def brute_rank(y, s):
    pos, neg = [b for a, b in zip(y, s, strict=True) if a], [b for a, b in zip(y, s, strict=True) if not a]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap, last, best = 0.0, 0, 0.0
    for c in sorted(set(s), reverse=True):
        tp, n = sum(a for a, b in zip(y, s, strict=True) if b >= c), sum(b >= c for b in s)
        p, r = tp / n, tp / len(pos)
        ap, last, best = ap + (tp - last) / len(pos) * p, tp, max(best, 2 * p * r / (p + r + 1e-5))
    return auc, ap, best


def brute_adjusted(y, s):
    best, lo, hi = 0.0, min(s), max(s)
    for i in range(100):
        thr = hi if i == 99 else lo + i * ((hi - lo) / 99)
        pred, t = [v > thr for v in s], 0
        while t < len(y):
            if y[t]:
                e = t
                while e + 1 < len(y) and y[e + 1]:
                    e += 1
                if any(pred[t : e + 1]):
                    for j in range(max(t, 1), e + 1):
                        pred[j] = True
                t = e
            t += 1
        tp = sum(p and a for p, a in zip(pred, y, strict=True))
        best = max(best, 2 * tp / (sum(pred) + sum(y)))
    return best


def test_metrics_against_brute_force(spark):
    r = random.Random(1)
    series = []
    for _ in range(6):
        y = [int(r.random() < 0.3) for _ in range(60)]
        y[r.randrange(60)] = 1
        series.append((y, [round(r.random() + 0.5 * a, 1) for a in y]))
    df = scored(spark, *series).cache()
    rank = {x["entity"]: x for x in ql.rank_metrics(df, BY).collect()}
    adjusted = {x["entity"]: x["pa_f1"] for x in ql.adjusted_f1(df, BY).collect()}
    for e, (y, s) in enumerate(series):
        want = brute_rank(y, s)
        assert all(math.isclose(rank[e][k], w, abs_tol=1e-12) for k, w in zip(("auc_roc", "auc_pr", "f1"), want, strict=True))
        assert math.isclose(adjusted[e], brute_adjusted(y, s), abs_tol=1e-12)


def test_perfect_constant_and_unlabelled_scores(spark):
    y = [0] * 20 + [1] * 5 + [0] * 20 + [1] * 3 + [0] * 10
    df = scored(spark, (y, y), (y, [1.0] * len(y)), ([0] * 10, range(10))).cache()
    rank = {x["entity"]: x for x in ql.rank_metrics(df, BY).collect()}
    assert rank[0]["auc_roc"] == 1 and rank[0]["auc_pr"] == 1 and rank[2]["auc_roc"] is None and rank[2]["auc_pr"] is None
    aff = [x for x in ql.affiliation(df, BY).collect() if x["entity"] == 0]
    assert aff and all(math.isclose(x["aff_precision"], 1) and math.isclose(x["aff_recall"], 1) for x in aff)
    assert {x["entity"] for x in ql.affiliation_f(df, BY).collect()} == {0}
    vus = {x["entity"]: x for x in ql.vus(df, BY, 6).collect()}
    assert 0.9 < vus[0]["vus_roc"] <= 1 and 2 not in vus


def test_affiliation_by_integration(spark):
    y = [0, 0, 1, 1, 1, 0, 0, 0, 0, 1, 1, 0, 0, 0]
    p = [1, 0, 0, 1, 0, 0, 1, 1, 0, 0, 0, 0, 0, 1]
    got = {x["seg"]: x for x in ql.affiliation_zones(scored(spark, (y, p)), BY).where("th = 0").collect()}
    events, preds, n = [(2, 5), (9, 11)], [(0, 1), (3, 4), (6, 8), (13, 14)], len(y)
    step = 1e-3
    for (js, je), (e0, e1), seg in zip(events, [(0, 7), (7, n)], sorted(got), strict=True):
        clipped = [(max(a, e0), min(b, e1)) for a, b in preds if max(a, e0) < min(b, e1)]
        zone = np.arange(e0 + step / 2, e1, step)
        d = np.maximum(0, np.maximum(js - zone, zone - je))
        points = np.concatenate([np.arange(a + step / 2, b, step) for a, b in clipped])
        own = np.sort(d)
        dist = np.maximum(0, np.maximum(js - points, points - je))
        assert abs((1 - np.searchsorted(own, dist) / len(own)).mean() - got[seg]["precision_p"]) < 2e-2 or dist.max() == 0
        inside = np.arange(js + step / 2, je, step)
        near = np.min([np.maximum(0, np.maximum(a - inside, inside - b)) for a, b in clipped], axis=0)
        far = [(np.abs(zone - x) >= q - 1e-9).mean() for x, q in zip(inside[::50], near[::50], strict=True)]
        assert abs(np.mean(far) - got[seg]["recall_p"]) < 3e-2


def cells(spark, make, n=1500, seed=0):
    r = np.random.default_rng(seed)
    x = make(r, n)
    return spark.createDataFrame([(0, t, v, float(x[t, v])) for t in range(n) for v in range(x.shape[1])], "entity int, t long, var int, x double")


def driven(r, n):
    x = r.normal(size=(n, 3))
    for t in range(2, n):
        x[t, 1] += 0.8 * x[t - 2, 0]
    return x


def test_transfer_entropy_peaks_at_the_lag(spark):
    bins = prior.digitise(cells(spark, driven), BY, 4).withColumn("chunk", F.lit(0))
    te = {(x["tau"], x["src"], x["tgt"]): x["te"] for x in prior.transfer_entropy(bins, BY, 3).collect()}
    assert max(te, key=te.get) == (2, 0, 1) and all(v >= 0 for v in te.values()) and te[(2, 0, 1)] > 5 * te[(1, 2, 0)]
    rows = prior.build("te", bins, BY, 3).collect()
    mass = {}
    for x in rows:
        mass[x["tgt"]] = mass.get(x["tgt"], 0) + x["weight"]
        assert 0 <= x["gate"] <= 1
    assert all(math.isclose(m, 1) for m in mass.values()) and len(rows) == 27


def test_lag_graph_and_ridge_find_the_driver(spark):
    series = cells(spark, driven).withColumnRenamed("x", "z")
    edges = [x for x in linear.lag_graph(series, BY, 3, 3).collect() if abs(x["val"]) > 0.2]
    assert [(x["lag"], x["src"], x["tgt"]) for x in edges] == [(2, 0, 1)]
    values = {(x["tau"], x["src"], x["tgt"]): x["value"] for x in linear.ridge(series, BY, 3, 3).collect()}
    assert abs(values[(2, 0, 1)] - 0.8) < 0.1


def test_ingest_edges(spark):
    c = spark.createDataFrame([(0, 0, 1.0), (0, 1, None), (0, 2, 3.0), (0, 3, None), (1, 0, None), (1, 1, None)], "entity int, t long, x double")
    assert [r["x"] for r in ingest.interpolate(c, BY).orderBy("entity", "t").collect()] == [1.0, 2.0, 3.0, 3.0, 0.0, 0.0]
    z = ingest.standardise(c, BY, "t < 3").orderBy("entity", "t").collect()
    assert z[4]["z"] == 0 and math.isclose(z[1]["z"], 0)
    raw = [("Attack", 1), ("abnormal", 1), ("Normal", 0), ("0", 0), ("1", 1), ("2", 1), ("20", 0), ("0.10", 1), ("nan", 1), ("", 0), (None, 0)]
    got = spark.createDataFrame([(r,) for r, _ in raw], "raw string").select(ingest.text_label(F.col("raw")).alias("y")).collect()
    assert [r["y"] for r in got] == [y for _, y in raw]
    df = spark.createDataFrame([(1, 2.0, "x", 3)], "timestamp int, ` a ` double, note string, `Unnamed: 0` int")
    assert ingest.numeric_columns(df).columns == ["a"] and ingest.drop_time_columns(df).columns == [" a ", "note", "Unnamed: 0"]
    assert ingest.label_column(spark.createDataFrame([(1, 2, 3)], "y int, ` Normal_Attack ` int, label int")) == " Normal_Attack "
    with pytest.raises(ValueError):
        ingest.label_column(spark.createDataFrame([(1,)], "y int"))
    with pytest.raises(ValueError):
        ingest.scaler(c, BY, "true", "other")
    with pytest.raises(ValueError):
        report.require(c)


def confounded(r, n):
    x = r.normal(size=(n, 4))
    for t in range(2, n):
        x[t, 0] += 1.5 * x[t - 1, 2]
        x[t, 1] += 1.5 * x[t - 2, 2]
    return x


def test_confounder_is_found_and_explains_the_edge(spark):
    bins = prior.digitise(cells(spark, confounded, 3000), BY, 4).withColumn("chunk", F.lit(0)).cache()
    te = prior.transfer_entropy(bins, BY, 2).cache()
    found = prior.confounders(te, BY)
    assert (0, 1, 2) in {(x["src"], x["tgt"], x["z"]) for x in found.collect()}
    plain = {(x["tau"], x["src"], x["tgt"]): x["te"] for x in te.collect()}
    given = {(x["tau"], x["src"], x["tgt"]): x["te"] for x in prior.conditional_entropy(bins, found, BY, 2, 4).collect()}
    assert set(given) == {(t, x["src"], x["tgt"]) for t in (1, 2) for x in found.collect()}
    assert plain[(1, 0, 1)] > 0.05
    two = {(x["tau"], x["src"], x["tgt"]): x["raw"] for x in prior.build("cte", bins, BY, 2, 4).collect()}
    assert all(math.isclose(two[k], v) for k, v in given.items()) and math.isclose(two[(2, 2, 1)], plain[(2, 2, 1)])


def test_graph_priors_keep_the_edges_gates(spark):
    edges = [(0, 0, 1, 1, "-->", -0.2), (0, 1, 2, 2, "o-o", 0.9), (0, 2, 0, 0, "-->", 0.3), (0, 0, 2, 0, "o-o", 0.8), (0, 1, 0, 1, "", 0.7)]
    rows = prior.build("graph", spark.createDataFrame(edges, "entity int, src int, tgt int, lag int, edge_type string, val double"), BY, 2)
    got = {(r["tau"], r["src"], r["tgt"]): (r["raw"], round(r["weight"], 6), r["gate"]) for r in rows.collect()}
    assert got[(1, 0, 1)] == (0.2, round(0.2 / 0.45, 6), 1.0) and got[(2, 1, 2)] == (0.45, round(0.45 / 0.7, 6), 0.5)
    assert got[(1, 2, 0)][2] == 1.0 and got[(1, 0, 2)] == (0.0, 0.0, 0.0) and got[(1, 1, 0)][2] == 0.0
    assert all(got[(1, v, v)][2] == 1.0 and got[(2, v, v)][2] == 0.0 for v in range(3)) and len(got) == 18
    d = prior.density(rows, BY).first()
    assert (d["directed"], d["ambiguous"], d["empty"]) == (5, 1, 12)


def test_prior_keys_follow_every_cell(spark):
    base = [(0, t, v, 10 * t + v) for t in range(6) for v in range(2)]
    other = [(e, t, v, x + {1: 1, 2: -2, 3: 1}.get(t, 0) if v == 0 else x) for e, t, v, x in base]  # count, sum and first moments stay
    keys = [prior.fingerprints(spark.createDataFrame(rows, "entity int, t long, var int, x long"), BY, "p").first()["key"] for rows in (base, other, base[::-1])]
    assert keys[0] != keys[1] and keys[0] == keys[2]


def test_results_use_finite_values_only(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([("m", s, 1, *[x] * 9) for s, x in enumerate((0.5, nan, inf, None, 0.7))], "entity string, seed int, epoch int, " + ", ".join(f"{m} double" for m in report.METRICS))
    row = report.over_seeds(df).first()
    assert math.isclose(row["auc_pr_mean"], 0.6) and math.isclose(row["vus_pr_std"], 0.1)
    assert math.isclose(report.best(df).first()["total"], 3.6)


def test_evaluation_slice_and_windows(spark):
    y = [1, 1, 0, 1, 1, 1, 0, 0, 1, 0]
    s = [0.5, 0.5, float("nan"), 1.0, 2.0, float("inf"), 0.1, None, 0.9, 0.2]
    df = spark.createDataFrame([(0, t, a, b) for t, (a, b) in enumerate(zip(y, s, strict=True))] + [(1, 0, 0, 1.0)], "entity int, t long, y int, score double")
    part = ql.evaluation_slice(df, BY, 1)
    assert sorted(r["t"] for r in part.collect()) == [1, 3, 4, 6, 8, 9]
    # by place in the slice: segments of 3 and 1 points
    assert {r["entity"]: r["win"] for r in ql.evaluation_windows(ql.evaluation_slice(df, BY), BY).collect()} == {0: 2, 1: 100}
    whole = {r["entity"]: r for r in ql.report(df, BY).collect()}
    assert whole[0]["auc_roc"] is not None and whole[0]["vus_roc"] is not None and whole[1]["auc_roc"] is None


def test_a_gate_that_falls_with_the_lag_is_monotone(spark):
    rows = [(0, tau, 0, 0, 0.5, g) for tau, g in ((1, 0.9), (2, 0.5), (3, 0.7))]
    df = spark.createDataFrame(rows, "entity int, tau int, src int, tgt int, weight double, gate double")
    assert math.isclose(edges.run(edges.MONITORS, BY, {"weights": df, "prior": df}).first()["monotone"], 0.1)
