"""Queries of causal priors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import scratch, shared
from ..operators import prior as pr
from ..operators import windows
from ..sources import store
from . import fixtures as fx

BY = ["entity"]
BINS, TAU = 6, 3
Q, O = {}, {}
_EDGE = ["entity", "tau", "src", "tgt"]


def chunk_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of four chunks of 200 hours, missing ones 0."""
    c = fx.cells(spark, d).fillna({"x": 0})
    return windows.cut_chunks(c, windows.chunk_bounds(c, BY, [0.0, 0.3, 0.6, 1.0], 200, TAU), BY)


def bins(spark: SparkSession, d: str) -> DataFrame:
    c = fx.cells(spark, d).fillna({"x": 0})
    return windows.cut_chunks(pr.digitise(c, BY, BINS), windows.chunk_bounds(c, BY, [0.0, 0.3, 0.6, 1.0], 200, TAU), BY)


def query(name: str, keys: list[str], columns: list[str], run) -> None:
    Q[name] = lambda spark, d: run(spark, d).select(*[F.col(k).cast("bigint").alias(k) for k in keys], *[F.round(F.col(c).cast("double"), 8).alias(c) for c in columns])


query("p01_bin_edges", ["entity", "var", "edge"], ["x"], lambda s, d: pr.bin_edges(fx.cells(s, d), BY, BINS))
query("p02_digitise", ["entity", "var", "t"], ["b"], lambda s, d: pr.digitise(fx.cells(s, d).fillna({"x": 0}), BY, BINS))
query("p03_transfer_entropy", _EDGE, ["te"], lambda s, d: pr.transfer_entropy(bins(s, d), BY, TAU))
query("p05_confounders", ["entity", "src", "tgt", "z"], ["score"], lambda s, d: pr.confounders(pr.transfer_entropy(bins(s, d), BY, TAU), BY))
query("p04_conditional_entropy", _EDGE, ["te"], lambda s, d: pr.conditional_entropy(bins(s, d), pr.confounders(pr.transfer_entropy(bins(s, d), BY, TAU), BY), BY, TAU, BINS))
query("p06_conditional_prior", _EDGE, ["raw", "weight", "gate"], lambda s, d: pr.build("cte", bins(s, d), BY, TAU, BINS))
query("p07_entropy_prior", _EDGE, ["raw", "weight", "gate"], lambda s, d: pr.build("te", bins(s, d), BY, TAU))
#: A graph of the entropies: strong edges are arrows, middling ones ambiguous, some without a lag.
_GRAPH = "select entity, src, tgt, case when (src + tgt) % 3 = 0 and tau = 1 then 0 else tau end as lag, case when te > 0.4 then '-->' when te > 0.2 then 'o-o' when te > 0.1 then 'x-x' else '' end as edge_type, te as val from {te}"


def graph(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.frames import sql

    return sql(_GRAPH, te=pr.transfer_entropy(bins(spark, d), BY, TAU).withColumn("te", F.round("te", 10)))


query("p11_graph_prior", _EDGE, ["raw", "weight", "gate"], lambda s, d: pr.from_graph(graph(s, d), bins(s, d).select("entity", "var").distinct(), BY, TAU))
query("p13_built_from_graph", _EDGE, ["raw", "weight", "gate"], lambda s, d: pr.build("graph", graph(s, d), BY, TAU))
query("p15_density", ["entity", "directed", "ambiguous", "empty"], [], lambda s, d: pr.density(pr.from_graph(graph(s, d), bins(s, d).select("entity", "var").distinct(), BY, TAU), BY))


def driven(spark: SparkSession, d: str) -> DataFrame:
    """Bins of events of which variable 0 drives 1 an hour and 2 two hours later, as the conditional entropies need."""
    from ..functions.frames import sql

    c = fx.cells(spark, d).fillna({"x": 0}).where("var = 0")
    three = sql(
        """
        select entity, t, v.var, case v.var when 0 then noise when 1 then coalesce(lag(noise, 1) over w, 0) + noise % 2 else coalesce(lag(noise, 2) over w, 0) + noise div 2 % 2 end as x
        from (select entity, t, (x * 7919 + t * 104729 + entity * 31) % 1009 % 4 as noise from {c}) n cross join (select explode(array(0, 1, 2)) as var) v
        window w as (partition by entity, v.var order by t)
        """,
        c=c,
    )
    return pr.digitise(three, BY, 4).withColumn("chunk", F.lit(0))


def driven_te(spark: SparkSession, d: str) -> DataFrame:
    return pr.transfer_entropy(driven(spark, d), BY, 2)


query("p05_driven_confounders", ["entity", "src", "tgt", "z"], ["score"], lambda s, d: pr.confounders(driven_te(s, d), BY))
query("p04_driven_conditional_entropy", _EDGE, ["te"], lambda s, d: pr.conditional_entropy(driven(s, d), pr.confounders(driven_te(s, d), BY), BY, 2, 4))
query("p06_driven_conditional_prior", _EDGE, ["raw", "weight", "gate"], lambda s, d: pr.build("cte", driven(s, d), BY, 2, 4))


def reuse(spark: SparkSession, d: str) -> DataFrame:
    """Of all users the ones whose prior must be computed, when those of users with even ids were stored for other parameters."""
    c = fx.events(spark, d, "user_id").groupBy("entity", "t", "var").agg(F.sum("c").alias("x"))
    now = pr.fingerprints(c, BY, "tau=3")
    stored = now.where("entity % 3 = 0").union(pr.fingerprints(c, BY, "tau=5").where("entity % 2 = 0"))
    return pr.to_compute(now, stored, BY)


Q["p14_priors_to_compute"] = reuse


def through_store(spark: SparkSession, d: str) -> DataFrame:
    """All series' priors from a store that a run before filled with those of even entities."""
    path = f"{shared(spark)}/priors-{uuid.uuid4().hex}"
    cells = scratch(fx.cells(spark, d).fillna({"x": 0}))

    def compute(some: DataFrame) -> DataFrame:
        return pr.build("te", windows.cut_chunks(pr.digitise(some, BY, BINS), windows.chunk_bounds(some, BY, [0.0, 0.3, 0.6, 1.0], 200, TAU), BY), BY, TAU)

    store.reuse(path, cells.where("entity % 2 = 0"), BY, f"te bins={BINS} tau={TAU}", compute)
    return store.reuse(path, cells, BY, f"te bins={BINS} tau={TAU}", compute)


query("p14_stored_priors", [*_EDGE], ["raw", "weight", "gate", "reused"], lambda s, d: through_store(s, d).withColumn("reused", F.col("reused").cast("int")))
