"""Queries of edge forecasts, monitors, interventions, scores and results."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import scratch
from ..operators import draws
from ..operators import edge_arrays as ea
from ..operators import edges as ed
from ..operators import prior as pr
from ..operators import quality as ql
from ..operators import report as rp
from ..operators import scoring as sc
from . import fixtures as fx
from . import priors as pq

BY, TAU = ["entity"], pq.TAU
RUN, SEEDS, EPOCHS, DRAWS = ["seed", "epoch"], 3, 3, 16
#: The epoch that a training hour belongs to.
EPOCH = f"cast(t * {EPOCHS} div {fx.SPLIT} + 1 as int)"
_EDGE = ["entity", "tau", "src", "tgt"]
Q, O = {}, {}

_NO = "select null"


def d_(template: str, **numbers: object) -> str:
    return pr.fill(template, BY, pr.DUCK, **{**ed.RUN, **numbers})


class Tables:
    """The chain of tables. Each that others read is written once a query."""

    def __init__(self, spark: SparkSession, d: str) -> None:
        self.spark, self.dir = spark, d

    @cached_property
    def series(self) -> DataFrame:
        return scratch(fx.scaled(self.spark, self.dir))

    @cached_property
    def prior(self) -> DataFrame:
        bins = pr.digitise(fx.cells(self.spark, self.dir).fillna({"x": 0}), BY, pq.BINS).withColumn("chunk", F.lit(0))
        return scratch(pr.prior(pr.transfer_entropy(bins, BY, TAU), bins.select("entity", "var").distinct(), BY, TAU, 0.0, 0.25))

    @cached_property
    def weights(self) -> DataFrame:
        return scratch(ed.weights(self.prior, BY))

    @cached_property
    def similarity(self) -> DataFrame:
        return ea.similarity(self.series, BY, fx.VARS, TAU, 4)

    @cached_property
    def weights_at(self) -> DataFrame:
        """(entity, t, tgt, w)"""
        parameters = ed.run(ed.LOGITS, BY, {"prior": self.prior}).drop("gate").join(ed.run(ed.GATES, BY, {"prior": self.prior}), _EDGE)
        return scratch(ea.weights_at(self.similarity, ea.packed(parameters, BY, ["logit", "gate"]), BY))

    @cached_property
    def forecasts(self) -> DataFrame:
        """(entity, t, tgt, actual, predicted, err, w, v)"""
        weights = ea.packed(self.weights, BY, ["weight"]).withColumnRenamed("weight", "w")
        return scratch(ea.forecasts(ea.edge_rows(self.series, weights, BY, fx.VARS, TAU), BY))

    def contributions(self, fill: str, where: str = "true") -> DataFrame:
        return edges_of(ea.contributions(self.forecasts.where(where), BY, fill), ["raw_delta", "positive_delta"])

    @cached_property
    def gains(self) -> DataFrame:
        return scratch(self.contributions("0D"))

    @cached_property
    def reference(self) -> DataFrame:
        """Gains of the training hours on the edges that were drawn; the prior stands for the others."""
        runs = self.prior.select("entity", F.lit(0).alias("seed"), F.lit(0).alias("epoch")).distinct()
        return scratch(ed.gain_reference(self.contributions("0D", fx.TRAIN), self.prior, BY, self.drawn(runs)))

    def drawn(self, runs: DataFrame) -> DataFrame:
        return draws.sampled_edges(self.prior.withColumn("gate", F.round("gate", 10)), runs, BY, RUN, DRAWS)

    @property
    def weight_reference(self) -> DataFrame:
        """(entity, tgt, w): mean weights of the training hours"""
        return ea.means(self.weights_at.where(fx.TRAIN), [*BY, "tgt"], ["w"])

    @property
    def strengths(self) -> DataFrame:
        return self.forecasts.select("entity", "t", "tgt", F.expr(ea.normal(ea.STRENGTH, "tgt")).alias("a"))

    @property
    def error(self) -> DataFrame:
        return ea.error_scores(self.forecasts, BY, 2)

    @property
    def deviation(self) -> DataFrame:
        return ea.deviations(self.strengths, ea.packed(self.reference, BY, ["v"]).withColumnRenamed("v", "ref"), BY, fx.VARS, TAU, 3)

    @property
    def weight_deviation(self) -> DataFrame:
        return ea.deviations(self.weights_at.withColumnRenamed("w", "a"), self.weight_reference.withColumnRenamed("w", "ref"), BY, fx.VARS, TAU, 3)

    # Runs: seeds draw other edges, epochs go on with another part of the training hours.
    @cached_property
    def runs(self) -> DataFrame:
        """(entity, seed, epoch), of which one seed lacks an entity."""
        keys = self.prior.select("entity").distinct().withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(SEEDS))))
        return keys.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(EPOCHS)))).where("not (entity = 3 and seed > 1)")

    def _steps(self, batches: DataFrame, keys: list[str], start: str) -> DataFrame:
        steps = batches.groupBy(*keys, "tgt").agg(F.collect_list(F.struct("epoch", "a")).alias("steps"))
        first = ea.packed(self.prior, BY, ["weight"]).select("entity", "tgt", F.expr(start).alias("start"))
        return steps.join(first, ["entity", "tgt"])

    @property
    def weight_references(self) -> DataFrame:
        """(entity, tgt, epoch, ref): the mean weights of each epoch's hours, folded."""
        batches = ea.means(self.weights_at.where(fx.TRAIN).withColumn("epoch", F.expr(EPOCH)), [*BY, "tgt", "epoch"], ["w"])
        return ea.fold(self._steps(batches.withColumnRenamed("w", "a"), BY, "weight"), BY, 0.9, False)

    @property
    def references(self) -> DataFrame:
        """(entity, seed, tgt, epoch, ref): the gains of the edges drawn in each epoch, folded."""
        parts = self.forecasts.where(fx.TRAIN).withColumn("epoch", F.expr(EPOCH))
        gains = ea.contributions(parts, [*BY, "epoch"])
        known = self.drawn(self.runs).groupBy(*BY, *RUN).agg(F.collect_set(F.expr(f"(tau - 1) * {fx.VARS} + src")).alias("known"))
        batches = gains.join(known, [*BY, "epoch"]).select(*BY, *RUN, "tgt", F.expr("transform(positive_delta, (g, i) -> case when array_contains(known, i) then g end)").alias("a"))
        return ea.fold(self._steps(batches, [*BY, "seed"], "weight"), [*BY, "seed"], 0.9, True)

    @cached_property
    def raw_runs(self) -> DataFrame:
        """(entity, seed, epoch, t, p, c, g): raw scores of every run, to six places."""
        c = ea.deviations(self.strengths, self.references, BY, fx.VARS, TAU, 3, RUN).select(*BY, *RUN, "t", F.col("c_mean").alias("c"))
        g = ea.deviations(self.weights_at.withColumnRenamed("w", "a"), self.weight_references, BY, fx.VARS, TAU, 3, ["epoch"]).select(*BY, "epoch", "t", F.col("c_mean").alias("g"))
        out = c.join(g, [*BY, "epoch", "t"]).join(self.error.select(*BY, "t", F.col("p_mean").alias("p")), [*BY, "t"])
        return scratch(out.select(*BY, *RUN, "t", *[F.round(x, 6).alias(x) for x in sc.COMPONENTS]))

    @property
    def calibrated_runs(self) -> DataFrame:
        keys = [*BY, *RUN]
        return sc.calibrated(self.raw_runs, sc.calibrators(self.raw_runs, keys, fx.TRAIN), keys)


def edges_of(rows: DataFrame, columns: list[str], keep: tuple[str, ...] = ("entity", "tgt")) -> DataFrame:
    return ea.unpacked(rows, list(keep), columns, fx.VARS)


def query(name: str, keys: list[str], columns: list[str], make, body: str = _NO, before: str = "") -> None:
    Q[name] = lambda spark, d: make(Tables(spark, d)).select(*[F.col(k).cast("bigint").alias(k) for k in keys], *[(F.round(F.col(c).cast("double"), 7) + 0.0).alias(c) for c in columns])
    if body != _NO:
        O[name] = f"with {before} select {', '.join([*[f'cast({k} as bigint) as {k}' for k in keys], *[f'round(cast({c} as double), 7) + 0.0 as {c}' for c in columns]])} from ({body}) res"


query("f01_edge_logits", _EDGE, ["logit"], lambda t: ed.run(ed.LOGITS, BY, {"prior": t.prior}))
query("f02_edge_gates", _EDGE, ["gate"], lambda t: ed.run(ed.GATES, BY, {"prior": t.prior}))
query("f03_similarity", ["entity", "t", "tau", "src", "tgt"], ["similarity"], lambda t: edges_of(t.similarity, ["similarity"], ("entity", "t", "tgt")))
query("f03_weights_at", ["entity", "t", "tau", "src", "tgt"], ["weight"], lambda t: edges_of(t.weights_at, ["w"], ("entity", "t", "tgt")).withColumnRenamed("w", "weight"))
query("f07_weight_reference", _EDGE, ["v"], lambda t: edges_of(t.weight_reference, ["w"]).withColumnRenamed("w", "v"))
query("f04_edge_weights", _EDGE, ["weight", "gate"], lambda t: t.weights)
query("f05_forecast", ["entity", "t", "tgt"], ["actual", "predicted", "err"], lambda t: t.forecasts)
query("f07_reference", _EDGE, ["v"], lambda t: t.reference)


def refreshed(t: Tables) -> DataFrame:
    """The reference, into which the weights enter with a tenth."""
    both = ea.packed(t.weights, BY, ["weight"]).join(ea.packed(t.reference, BY, ["v"]), ["entity", "tgt"])
    steps = both.selectExpr("entity", "tgt", "v as start", "array(struct(1 as epoch, v as a), struct(2 as epoch, weight as a)) as steps")
    return edges_of(ea.fold(steps, BY, 0.9, False).where("epoch = 2"), ["ref"]).withColumnRenamed("ref", "v")


query("f08_reference_ema", _EDGE, ["v"], refreshed)
query("f08_weight_references", [*_EDGE, "epoch"], ["ref"], lambda t: edges_of(t.weight_references, ["ref"], ("entity", "tgt", "epoch")))
query("f08_gain_references", [*_EDGE, "seed", "epoch"], ["ref"], lambda t: edges_of(t.references, ["ref"], ("entity", "seed", "tgt", "epoch")))
query("i01_rotated_source", ["entity", "t"], ["before", "after"], lambda t: ed.run(ed.ROTATE, BY, {"series": t.series}, SRC=2, BLOCK=50, SHIFT=7))
query("i01_permuted_source", ["entity", "t"], ["before", "after"], lambda t: draws.permuted(t.series.where("var = 2"), BY, 50, 7))
query("i02_constant_fill", _EDGE, ["raw_delta", "positive_delta"], lambda t: t.contributions("0.5D"))
query("i03_drawn_edges", ["entity", "seed", "epoch", "draw", "tau", "src"], [], lambda t: t.drawn(t.runs))
query("i04_contributions", _EDGE, ["raw_delta", "positive_delta"], lambda t: t.gains)
query("i05_rollups", ["entity", "tau", "src", "tgt"], ["raw_mean", "raw_max", "positive_mean", "positive_max", "strength"], lambda t: ed.run(ed.ROLLUP, BY, {"gains": t.gains}))
query("i06_top_edges", ["entity", "place", "tau", "src", "tgt"], ["positive_delta"], lambda t: ed.run(ed.TOP, BY, {"gains": t.gains}, N=10))
query("i08_alignment", BY, ["loss"], lambda t: ed.run(ed.ALIGNMENT, BY, {"effects": t.forecasts.select("entity", "tgt", F.expr(f"aggregate({ea.STRENGTH}, 0D, (s, y) -> s + y)").alias("strength")), "gains": t.gains}))
query("m01_error_size", BY, ["mean_abs", "mean_l2"], lambda t: ed.run(ed.ERROR_SIZE, BY, {"errors": t.forecasts}))
_MON = ["js", "gate_bce", "sparsity", "monotone", "entropy", "stability", "structure_kl", "max_weight", "max_gate", "mean_weight", "std_weight"]
query("m02_edge_monitors", BY, _MON, lambda t: ed.run(ed.MONITORS, BY, {"weights": t.weights, "prior": t.prior}))


def environment_variance(t: Tables) -> DataFrame:
    """How much an edge's mean strength varies over four environments that split the time, in the mean over edges."""
    ends = t.forecasts.groupBy(*BY).agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    cut = t.forecasts.join(ends, BY).select("entity", "tgt", F.expr("cast(floor((t - t0) * 4 / (t1 - t0 + 1e0)) as int)").alias("env"), F.expr(ea.STRENGTH).alias("m"))
    each = edges_of(ea.means(cut, ["entity", "tgt", "env"], ["m"]), ["m"], ("entity", "tgt", "env"))
    return each.groupBy(*_EDGE).agg(F.var_pop("m").alias("v")).groupBy(*BY).agg(F.avg("v").alias("variance"))


query("m07_environment_variance", BY, ["variance"], environment_variance)
query("g01_error_score", ["entity", "t"], ["p_mean", "p_max", "p_top"], lambda t: t.error)
_C = ["c_mean", "c_max", "row_mean", "top_mean"]
query("g04_strength_deviation", ["entity", "t"], _C, lambda t: t.deviation)
query("g05_weight_deviation", ["entity", "t"], _C, lambda t: t.weight_deviation)


def combined(t: Tables) -> DataFrame:
    return scratch(sc.run(sc.COMBINE, BY, {"error": t.error, "deviation": t.deviation, "weights": t.weight_deviation}, ALPHA="0.5e0", BETA="0.5e0"))


query("g06_combined_score", ["entity", "t"], ["p", "c", "g", "s", "a"], combined)


def raw_components(t: Tables) -> DataFrame:
    return scratch(combined(t).select("entity", "t", *[F.round(x, 6).alias(x) for x in sc.COMPONENTS]))


query("g07_robust_scale", [*BY, "component"], ["centre", "scale"], lambda t: sc.calibrators(raw_components(t), BY, fx.TRAIN))


def calibrated(t: Tables) -> DataFrame:
    raw = raw_components(t)
    return sc.calibrated(raw, sc.calibrators(raw, BY, fx.TRAIN), BY)


query("g08_robust_z", ["entity", "t"], ["p", "c", "g", "s", "a"], calibrated)
Q["g10_scored_quality"] = lambda spark, d: _quality(spark, d)


def _quality(spark: SparkSession, d: str) -> DataFrame:
    scores = calibrated(Tables(spark, d)).select("entity", "t", F.round("a", 6).alias("score"))
    m = ql.rank_metrics(scratch(scores.join(fx.labels(spark, d), BY + ["t"])), BY)
    return m.select(F.col("entity").cast("bigint").alias("entity"), *[F.round(F.col(c), 7).alias(c) for c in ("auc_roc", "auc_pr", "f1")])


def on_scores(name: str, template: str, frames, keys: list[str], column: str, body: str, **numbers: object) -> None:
    cast = (lambda c: F.round(F.col(c).cast("double"), 7).alias(c)) if column == "score" else (lambda c: F.col(c))
    Q[name] = lambda spark, d: sc.run(template, BY, frames(spark, d), **numbers).select(*keys, cast(column))
    O[name] = f"with {fx.SCORES} select {', '.join(keys)}, {'round(score, 7) as score' if column == 'score' else column} from ({body}) q"


on_scores("g09_timeline", sc.TIMELINE, lambda s, d: {"times": fx.labels(s, d).select("entity", "t"), "windows": fx.scores(s, d).select("entity", F.col("t").alias("win"), "score")}, ["entity", "t"], "score", sc.filled(sc.TIMELINE, BY, True, L=10).format(times="(select entity, t from labels)", windows="(select entity, t as win, score from scores)"), L=10)
on_scores("q24_three_sigma", sc.THREE_SIGMA, lambda s, d: {"scores": fx.scores(s, d)}, ["entity", "t"], "above", sc.filled(sc.THREE_SIGMA, BY, True).format(scores="scores"))
on_scores("q25_padded", sc.PADDED, lambda s, d: {"times": fx.labels(s, d).select("entity", "t"), "scores": fx.scores(s, d)}, ["entity", "t"], "score", sc.filled(sc.PADDED, BY, True, W=15).format(times="(select entity, t from labels)", scores="scores"), W=15)

_RUN_BY = ["entity", *RUN]


def epoch_metrics(spark: SparkSession, d: str) -> DataFrame:
    """All nine metrics of every run's calibrated scores, to nine places; some of seed 2 are missing or no finite numbers."""
    scores = Tables(spark, d).calibrated_runs.select(*_RUN_BY, "t", F.round("a", 6).alias("score"))
    m = ql.report(scratch(scores.join(fx.labels(spark, d), BY + ["t"])), _RUN_BY, 4)
    m = m.select(*_RUN_BY, *[F.round(F.col(c).cast("double"), 9).alias(c) for c in rp.METRICS])
    odd = {"f1": None, "auc_pr": float("nan"), "vus_pr": float("inf")}
    at = (F.col("seed") == 2) & (F.col("epoch") == 2)
    return scratch(rp.require(m).withColumns({c: F.when(at, F.lit(v).cast("double")).otherwise(F.col(c)) for c, v in odd.items()}))


_STATS = [f"{m}_{x}" for m in rp.METRICS for x in ("mean", "std")]
_MEANS = [f"{m}_mean" for m in rp.METRICS]


def results(name: str, keys: list[str], columns: list[str], make) -> None:
    Q[name] = lambda spark, d: make(epoch_metrics(spark, d)).select(*keys, *[F.round(F.col(c).cast("double"), 7).alias(c) for c in columns])


results("a01_over_seeds", BY, _STATS, rp.over_seeds)
results("a02_over_epochs", ["entity", "epoch"], _STATS, rp.over_epochs)
results("a03_best_epoch", ["entity", "epoch"], ["total"], rp.best)
results("a04_macro_average", ["name"], _MEANS, lambda m: rp.best(m).withColumn("name", F.col("entity").cast("string")).select("name", *_MEANS).unionByName(rp.best(m).agg(*[F.avg(c).alias(c) for c in _MEANS]).withColumn("name", F.lit("MACRO_AVG"))))
results("a06_percent", ["entity", "epoch"], ["percent"], lambda m: rp.over_epochs(m).withColumn("percent", F.round(100 * F.col("auc_roc_mean"), 2)))
results("a07_epoch_metrics", _RUN_BY, ["auc_roc", "pa_f1", "event_f1", "r_f", "aff_f", "vus_roc"], lambda m: m)
