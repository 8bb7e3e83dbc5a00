"""Queries of linear fits, graph discovery, applied models and the remaining reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import scratch, sql
from ..operators import linear
from ..operators import quality as ql
from ..operators import report as rp
from . import fixtures as fx
from . import forecasts as fc
from . import quality as qq

BY, TAU = ["entity"], 3
Q, O = {}, {}


def ridge(spark: SparkSession, d: str) -> DataFrame:
    return linear.ridge(fx.scaled(spark, d), BY, TAU, fx.VARS)


def weighted_ridge(spark: SparkSession, d: str) -> DataFrame:
    """Values of the edges' inputs times their weights."""
    t = fc.Tables(spark, d)
    return linear.weighted_ridge(t.series, t.weights, BY, TAU, fx.VARS)


def lag_graph(spark: SparkSession, d: str) -> DataFrame:
    return linear.lag_graph(fx.scaled(spark, d), BY, TAU, fx.VARS)


def applied(spark: SparkSession, d: str) -> DataFrame:
    """A model that expects the mean of the lags, on every window."""
    frames = linear.lag_frames(fx.scaled(spark, d), BY, TAU, fx.VARS)
    return linear.apply_model(frames, BY, lambda x: x.reshape(len(x), TAU + 1, fx.VARS)[:, 1:].mean(axis=1), fx.VARS).select("entity", "t", "tgt", (F.round("predicted", 6) + 0.0).alias("predicted"))


Q["f06_weighted_values"] = weighted_ridge
Q["f06_ridge_values"], Q["p12_lag_graph"], Q["u01_applied_model"] = ridge, lag_graph, applied
O["u01_applied_model"] = f"with {fx.SCALED}, w as (select entity, t, var as tgt, avg(z) over v as predicted, count(*) over v as n from scaled window v as (partition by entity, var order by t rows between {TAU} preceding and 1 preceding)) select entity, t, tgt, round(predicted, 6) + 0.0 as predicted from w where n = {TAU}"

#: Draws of edges in proportion to their gates, at even places of the running sum.
DRAWS = {
    "g": "select $k, tau, src, sum(gate) as mass from {prior} group by $k, tau, src",
    "m": "select $k, tau, src, case when sum(mass) over (partition by $k) > 0 then mass else 1e0 end as mass from {g} g",
    "c": "select $k, tau, src, round(sum(mass) over (partition by $k order by tau, src) / sum(mass) over (partition by $k), 10) as hi, round((sum(mass) over (partition by $k order by tau, src) - mass) / sum(mass) over (partition by $k), 10) as lo from {m} m",
    "result": "select $k, cast(draw as bigint) as draw, cast(tau as bigint) as tau, cast(src as bigint) as src from {c} c join range(64) r(draw) on (draw + 0.5e0) / 64e0 >= lo and (draw + 0.5e0) / 64e0 < hi",
}
Q["i03_sampled_edges"] = lambda s, d: sql(ql.text(DRAWS, BY), prior=fc.Tables(s, d).prior.withColumn("gate", F.round("gate", 10)))

#: Recall of true segments whose points count by their place: more in front, at the back or in the middle.
BIAS = {
    "w": "select $k, seg, nb, i - s + 1 as q, len from {points} p join (select $k, seg, min(i) as s, count(*) as len from {points} where y > 0 group by $k, seg) g using ($k, seg)",
    "b": "select *, len - q + 1e0 as front, q * 1e0 as back, case when q <= len / 2e0 then q * 1e0 else len - q + 1e0 end as middle from {w} w",
    "result": "select $k, seg, nb - 1 as th, sum(front) / (len * (len + 1) / 2e0) as front, sum(back) / (len * (len + 1) / 2e0) as back, sum(middle) as middle, sum(middle) / max(total) as part from {b} b join (select $k, seg, sum(middle) as total from {b} b group by $k, seg) t using ($k, seg) group by $k, seg, nb, len",
}


def biased_recall(scores: DataFrame, by: list[str]) -> DataFrame:
    """(by, th, front, back, middle): means over the true segments."""
    pts = scratch(ql.points(scores, by).where("y > 0"))
    sums = ql.at_thresholds(sql(ql.text(BIAS, by), points=pts).drop("middle").withColumnRenamed("part", "middle"), by, qq_cols)
    n = pts.groupBy(*by).agg(F.countDistinct("seg").alias("n_true"))
    return sums.join(n, by).select(*by, "th", *[(F.col(c) / F.col("n_true")).alias(c) for c in qq_cols])


qq_cols = ["front", "back", "middle"]
F_PLAIN = "select $k, th, 2e0 * aff_precision * aff_recall / nullif(aff_precision + aff_recall, 0e0) as f from {affiliation}"


def query(name: str, keys: list[str], columns: list[str], run, body: str) -> None:
    Q[name] = lambda s, d: run(s, d).select(*keys, *[F.round(F.col(c).cast("double"), 8).alias(c) for c in columns])
    O[name] = f"with {fx.SCORES} select {', '.join(keys)}, {', '.join(f'round(cast({c} as double), 8) as {c}' for c in columns)} from ({body}) res"


query("q09_biased_recall", [*BY, "th"], qq_cols, lambda s, d: biased_recall(fx.scores(s, d), BY), "select null")
query("q23_classic_report", BY, ql.CLASSIC, lambda s, d: ql.classic_report(fx.scores(s, d), BY), "select null")
query("q28_plain_f", [*BY, "th"], ["f"], lambda s, d: sql(ql.text(F_PLAIN, BY), affiliation=ql.affiliation(fx.scores(s, d), BY)), ql.text(F_PLAIN, BY).format(affiliation=f"({qq.AFF})"))


def diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """The nine metrics of each component by itself, and of both products."""
    c = fc.combined(fc.Tables(spark, d)).select("entity", "t", F.expr("stack(5, 'P', p, 'C', c, 'G', g, 'S', s, 'A', a) as (component, score)"))
    scores = scratch(c.withColumn("score", F.round("score", 5)).join(fx.labels(spark, d), ["entity", "t"]))
    m = ql.report(scores, ["entity", "component"])
    return m.select("entity", "component", *[F.round(x, 6).alias(x) for x in rp.METRICS])


Q["q27_component_quality"] = diagnostics
