"""Series, labels and scores that the queries derive from `events`; and the same as DuckDB CTEs.

cells: per entity (user_id modulo 4), hour t (0 to 719) and variable (event type in name order) the sum of `value` in
whole cents; NULL where no event fell. The first 432 hours train, the rest test.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.frames import sql
from ..operators import ingest

ENTITIES, HOURS, SPLIT, VARS = 4, 720, 432, 5
TRAIN = f"t < {SPLIT}"
BY = ["entity", "var"]


def events(spark: SparkSession, sf_dir: str, entity: str = f"user_id % {ENTITIES}") -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    return sql(
        f"""
        select {entity} as entity, cast(timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz)) as bigint) as t,
               cast(array_position(array('click', 'error', 'purchase', 'signup', 'view'), event_type) - 1 as int) as var, cast(round(value * 100) as bigint) as c
        from {{raw}} where user_id is not null and ts is not null
        """,
        raw=raw,
    )


def cells(spark: SparkSession, sf_dir: str, entity: str = f"user_id % {ENTITIES}") -> DataFrame:
    ev = events(spark, sf_dir, entity)
    grid = ev.select("entity").distinct().select("entity", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(HOURS - 1).cast("long"))).alias("t"))
    grid = grid.select("entity", "t", F.explode(F.sequence(F.lit(0), F.lit(VARS - 1))).alias("var"))
    return grid.join(ev.groupBy("entity", "t", "var").agg(F.sum("c").alias("x")), ["entity", "t", "var"], "left")


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, t, var, z)"""
    return ingest.standardise(cells(spark, sf_dir), BY, TRAIN)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, t, y) of test hours: whether the errors of three hours exceed their 0.9 quantile."""
    errors = cells(spark, sf_dir).where("var = 1")
    three = Window.partitionBy("entity").orderBy("t").rowsBetween(-2, 0)
    s3 = errors.select("entity", "t", F.sum(F.coalesce("x", F.lit(0))).over(three).alias("s3")).where(f"t >= {SPLIT}")
    q = s3.groupBy("entity").agg(F.expr("percentile(s3, 0.9)").alias("q"))
    return s3.join(q, "entity").select("entity", "t", (F.col("s3") > F.col("q")).cast("int").alias("y"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, t, y, score) of test hours: the mean absolute z over variables, to six places."""
    s = scaled(spark, sf_dir).where(f"t >= {SPLIT}").groupBy("entity", "t").agg(F.round(F.avg(F.abs("z")), 6).alias("score"))
    return s.join(labels(spark, sf_dir), ["entity", "t"]).select("entity", "t", "y", "score")


CELLS = f"""
ev as (select user_id % {ENTITIES} as entity, cast(floor(epoch(ts - timestamp '2024-01-01') / 3600) as bigint) as t,
       case event_type when 'click' then 0 when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 when 'view' then 4 end as var, cast(round(value * 100) as bigint) as c
       from events where user_id is not null and ts is not null),
cells as (select g.entity, g.t, g.var, cast(s.x as bigint) as x from
  (select k.entity, h.t, v.var from (select distinct entity from ev) k, range({HOURS}) h(t), range({VARS}) v(var)) g
  left join (select entity, t, var, sum(c) as x from ev group by all) s on g.entity = s.entity and g.t = s.t and g.var = s.var)"""
SCALED = (
    CELLS
    + f""",
means as (select entity, var, coalesce(avg(case when {TRAIN} then x end), 0) as fill_mean from cells group by all),
filled as (select c.entity, c.t, c.var, coalesce(c.x, m.fill_mean) as x from cells c join means m using (entity, var)),
stats as (select entity, var, avg(case when {TRAIN} then x end) as mu, case when coalesce(stddev_pop(case when {TRAIN} then x end), 0) = 0 then 1.0 else stddev_pop(case when {TRAIN} then x end) end as sd from filled group by all),
scaled as (select f.entity, f.t, f.var, (f.x - s.mu) / s.sd as z from filled f join stats s using (entity, var))"""
)
_LABELS = f""",
s3 as (select entity, t, sum(coalesce(x, 0)) over (partition by entity order by t rows between 2 preceding and current row) as s3 from cells where var = 1),
q9 as (select entity, quantile_cont(s3, 0.9) as q from s3 where t >= {SPLIT} group by all),
labels as (select s3.entity, s3.t, cast(s3 > q as int) as y from s3 join q9 using (entity) where t >= {SPLIT})"""
LABELS = CELLS + _LABELS
SCORES = (
    SCALED
    + _LABELS
    + f""",
scores as (select s.entity, s.t, l.y, s.score from (select entity, t, round(avg(abs(z)), 6) as score from scaled where t >= {SPLIT} group by all) s join labels l using (entity, t))"""
)
SEGMENTS = """,
pos as (select entity, t, t - row_number() over (partition by entity order by t) as g from labels where y > 0),
segments as (select entity, cast(row_number() over (partition by entity order by min(t)) as int) as seg_id, min(t) as s, max(t) as e, max(t) + 1 as e_excl from pos group by entity, g)"""
