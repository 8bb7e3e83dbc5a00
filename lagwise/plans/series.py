"""Queries of cleaning, windows and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import sql
from ..operators import ingest, segments, windows
from . import fixtures as fx

ENTITY = ["entity"]
Q, O = {}, {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        Q[name] = f
        if oracle:
            O[name] = oracle
        return f

    return keep


@query("s05_entities", f"with {fx.CELLS} select distinct entity from cells where entity in (0, 2, 3)")
def entities(spark: SparkSession, d: str) -> DataFrame:
    return fx.cells(spark, d).where("entity in (0, 2, 3)").select("entity").distinct()


@query("s06_paired_entities", f"with {fx.LABELS} select a.entity, cast(n_train as bigint) as n_train from (select entity, count(distinct var) as n_train from cells where {fx.TRAIN} group by all) a join (select entity, count(distinct var) as n_test from cells where not ({fx.TRAIN}) group by all) b using (entity) where n_train = n_test and entity in (select entity from labels where y = 1)")
def paired(spark: SparkSession, d: str) -> DataFrame:
    c = fx.cells(spark, d)
    return ingest.paired(c.where(fx.TRAIN), c.where(f"not ({fx.TRAIN})"), fx.labels(spark, d).where("y = 1"), "entity")


@query("s08_ingest_report", f"with {fx.LABELS} select entity, count(*) as n, cast(sum(y) as bigint) as positives, round(avg(y), 8) as ratio, string_agg(distinct y::varchar, ',' order by y::varchar) as labels from labels group by all")
def report(spark: SparkSession, d: str) -> DataFrame:
    return ingest.ingest_report(fx.labels(spark, d), ENTITY).withColumn("ratio", F.round("ratio", 8))


@query("c04_finite_values", "select event_id, case when isnan(r) or isinf(r) then null else round(r, 6) end as x from (select event_id, case when event_id % 7 = 0 then 'nan'::double when event_id % 11 = 0 then 'infinity'::double else value / 3 end as r from events)")
def finite(spark: SparkSession, d: str) -> DataFrame:
    raw = spark.read.parquet(f"{d}/events.parquet")
    r = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 11 == 0, F.lit(float("inf"))).otherwise(F.col("value") / 3)
    return raw.select("event_id", F.round(ingest.finite(r), 6).alias("x"))


@query("c05_interpolate", f"""with {fx.CELLS}, near as (select *, last_value(case when x is not null then t end ignore nulls) over w as t0, last_value(x ignore nulls) over w as x0,
 first_value(case when x is not null then t end ignore nulls) over v as t1, first_value(x ignore nulls) over v as x1 from cells
 window w as (partition by entity, var order by t rows between unbounded preceding and current row), v as (partition by entity, var order by t rows between current row and unbounded following))
 select entity, var, t, round(coalesce(case when t1 > t0 then x0 + (x1 - x0) * (t - t0)::double / (t1 - t0) end, x0, x1, 0), 6) as x from near""")
def interpolate(spark: SparkSession, d: str) -> DataFrame:
    return ingest.interpolate(fx.cells(spark, d), fx.BY).withColumn("x", F.round(F.col("x").cast("double"), 6))


@query("c06_impute", f"with {fx.SCALED} select entity, t, var, round(x, 6) as x from filled")
def impute(spark: SparkSession, d: str) -> DataFrame:
    return ingest.impute(fx.cells(spark, d), fx.BY, fx.TRAIN).select("entity", "t", "var", F.round("x", 6).alias("x"))


@query("c07_standardise", f"with {fx.SCALED} select entity, t, var, round(z, 6) + 0.0 as z from scaled")
def standardise(spark: SparkSession, d: str) -> DataFrame:
    return fx.scaled(spark, d).withColumn("z", F.round("z", 6) + 0.0)


@query("c08_scaler", f"with {fx.SCALED} select entity, var, 'standard' as mode, round(mu, 6) as mu, round(sd, 6) as sd from stats union all select distinct entity, var, 'none', 0.0, 1.0 from cells")
def scaler(spark: SparkSession, d: str) -> DataFrame:
    full = ingest.impute(fx.cells(spark, d), fx.BY, fx.TRAIN)
    both = [ingest.scaler(full, fx.BY, fx.TRAIN, m).withColumn("mode", F.lit(m)) for m in ("standard", "none")]
    return both[0].unionByName(both[1]).withColumns({"mu": F.round("mu", 6), "sd": F.round("sd", 6)})


@query("c09_any_label", f"with {fx.CELLS} select entity, t, cast(count(*) filter (where x > 2000 and var >= 2) > 0 as int) as y from cells group by all")
def any_label(spark: SparkSession, d: str) -> DataFrame:
    k = sql("select entity, t, transform(array_sort(collect_list(struct(var, coalesce(x, 0) as x))), s -> cast(s.x > 2000 and s.var >= 2 as int)) as ys from {c} group by entity, t", c=fx.cells(spark, d))
    return k.select("entity", "t", ingest.any_label(F.col("ys")).alias("y"))


@query("c10_numeric_label", "select event_id, cast(coalesce(case when event_id % 5 = 0 then null else cast(floor(value) as int) % 3 end, 0) != 0 as int) as y from events")
def numeric_label(spark: SparkSession, d: str) -> DataFrame:
    raw = spark.read.parquet(f"{d}/events.parquet")
    y = F.when(F.col("event_id") % 5 == 0, None).otherwise(F.floor("value").cast("int") % 3)
    return raw.select("event_id", ingest.numeric_label(y).alias("y"))


_RAW = "case o_orderkey % 11 when 0 then ' Attack ' when 1 then 'abnormal' when 2 then 'Normal' when 3 then '0' when 4 then '2' when 5 then '20' when 6 then '0.10' when 7 then 'nan' when 8 then '' when 9 then '-3.5' else o_orderpriority end"


@query("c11_text_label", f"select o_orderkey, case when regexp_matches(r, 'attack|anomaly|abnormal|fault|1|true|yes') then 1 when regexp_matches(r, 'normal|0|false|no') then 0 when coalesce(try_cast(r as double) <> 0, false) then 1 else 0 end as y from (select o_orderkey, lower(trim({_RAW})) as r from orders)")
def text_label(spark: SparkSession, d: str) -> DataFrame:
    raw = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey", f"{_RAW} as raw")
    return raw.select("o_orderkey", ingest.text_label(F.col("raw")).alias("y"))


@query("c13_long_enough", f"with ev as (select user_id as entity, cast(floor(epoch(ts - timestamp '2024-01-01') / 3600) as bigint) as t from events), ok as (select entity from ev group by all having count(distinct case when t < {fx.SPLIT} then t end) > 20 and count(distinct case when t >= {fx.SPLIT} then t end) > 20) select entity, count(*) as n from ev where entity in (select entity from ok) group by all")
def long_enough(spark: SparkSession, d: str) -> DataFrame:
    return ingest.long_enough(fx.events(spark, d, "user_id"), "entity", fx.TRAIN, 20).groupBy("entity").agg(F.count("*").alias("n"))


@query("c14_check_lengths", f"with {fx.LABELS}, c as (select entity, count(distinct case when {fx.TRAIN} then var end) as train_vars, count(distinct case when not ({fx.TRAIN}) then var end) as test_vars, count(distinct case when not ({fx.TRAIN}) then t end) as times from cells group by all) select c.*, coalesce(l.labels, 0) as labels, train_vars = test_vars and times = coalesce(l.labels, 0) as valid from c left join (select entity, count(*) as labels from labels where entity > 0 group by all) l using (entity)")
def check_lengths(spark: SparkSession, d: str) -> DataFrame:
    return ingest.check_lengths(fx.cells(spark, d), fx.labels(spark, d).where("entity > 0"), "entity", fx.TRAIN)


@query("w01_sliding_windows", f"with {fx.LABELS}, w as (select entity, t, list(y) over (partition by entity order by t rows between 9 preceding and current row) as ys from labels) select entity, t - 9 as win, t as t_end, array_to_string(ys, '') as ys from w where len(ys) = 10")
def sliding(spark: SparkSession, d: str) -> DataFrame:
    return windows.sliding(fx.labels(spark, d), ENTITY, 10, "y").select("entity", "win", "t_end", F.array_join("xs", "").alias("ys"))


@query("w02_environments", f"with {fx.LABELS}, n as (select entity, t as win, row_number() over (partition by entity order by t) - 1 as i, count(*) over (partition by entity) as n from labels) select entity, win, cast(least(i * 4 // n, 3) as bigint) as env from n")
def environments(spark: SparkSession, d: str) -> DataFrame:
    return windows.environments(fx.labels(spark, d).select("entity", F.col("t").alias("win")), ENTITY, 4).select("entity", "win", F.col("env").cast("bigint").alias("env"))


@query("w03_lag_windows", f"with {fx.CELLS} select entity, t, var, coalesce(sum(x) over w, 0)::bigint as total, count(x) over w as n from cells window w as (partition by entity, var order by t rows between 4 preceding and 2 preceding)")
def lag_windows(spark: SparkSession, d: str) -> DataFrame:
    w = windows.lag_windows(fx.cells(spark, d), fx.BY, 2, 3, 10)
    total = F.aggregate("xs", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return w.select("entity", "t", "var", total.alias("total"), F.size("xs").cast("bigint").alias("n"))


@query("w04_lagged_pairs", f"with {fx.CELLS}, p as (select entity, var, t, x as y, k.tau, case k.tau when 1 then lag(x, 1) over w when 2 then lag(x, 2) over w else lag(x, 3) over w end as x from cells, range(1, 4) k(tau) window w as (partition by entity, var, k.tau order by t)) select entity, tau, var, count(*) as n, cast(sum(y * x) as bigint) as xy from p where x is not null group by all")
def lagged_pairs(spark: SparkSession, d: str) -> DataFrame:
    return windows.lagged_pairs(fx.cells(spark, d), ENTITY, 3).groupBy("entity", F.col("tau").cast("bigint").alias("tau"), "var").agg(F.count("*").alias("n"), F.sum(F.col("y") * F.col("x")).alias("xy"))


_CHUNKS = """select entity, i as chunk, cast(t0 + floor(share * (n - 128)) as bigint) as s, cast(t0 + floor(share * (n - 128)) + 127 as bigint) as e
 from (select entity, count(distinct t) as n, min(t) as t0 from cells group by all), (values (0, 0.0::double), (1, 0.25::double), (2, 0.9::double)) c(i, share)"""


@query("w05_chunks", f"with {fx.CELLS}, k as ({_CHUNKS}) select c.entity, k.chunk, k.s, k.e, c.var, count(*) as n, cast(sum(c.x) as bigint) as x from cells c join k on c.entity = k.entity and c.t between k.s and k.e group by all")
def chunks(spark: SparkSession, d: str) -> DataFrame:
    c = fx.cells(spark, d)
    cut = windows.chunk_bounds(c, ENTITY, [0.0, 0.25, 0.9], 128, 3)
    return windows.cut_chunks(c, cut, ENTITY).join(cut, ["entity", "chunk"]).groupBy("entity", "chunk", F.col("s").cast("bigint").alias("s"), F.col("e").cast("bigint").alias("e"), "var").agg(F.count("*").alias("n"), F.sum("x").alias("x"))


@query("w06_block_subsample", f"with {fx.CELLS} select entity, count(*) as n, min(c.t) as s, max(c.t) as e from cells c join (select entity, cast(min(t) + floor(0.5::double * (count(distinct t) - 200)) as bigint) as s0 from cells group by all) k using (entity) where c.t between s0 and s0 + 199 group by all")
def block(spark: SparkSession, d: str) -> DataFrame:
    c = fx.cells(spark, d)
    return windows.cut_chunks(c, windows.chunk_bounds(c, ENTITY, [0.5], 200, 3), ENTITY).groupBy("entity").agg(F.count("*").alias("n"), F.min("t").alias("s"), F.max("t").alias("e"))


LS = fx.LABELS + fx.SEGMENTS


@query("e01_segments", f"with {LS} select entity, seg_id, s, e from segments")
def closed(spark: SparkSession, d: str) -> DataFrame:
    return segments.runs(fx.labels(spark, d), ENTITY).select("entity", "seg_id", "s", "e")


@query("e02_half_open_events", f"with {LS} select entity, s, e_excl from segments")
def half_open(spark: SparkSession, d: str) -> DataFrame:
    return segments.runs(fx.labels(spark, d), ENTITY).select("entity", "s", "e_excl")


@query("e03_event_ids", f"with {LS} select entity, max(seg_id) as events, cast(sum(seg_id * (s + e)) as bigint) as check_sum from segments group by all")
def event_ids(spark: SparkSession, d: str) -> DataFrame:
    return segments.runs(fx.labels(spark, d), ENTITY).groupBy("entity").agg(F.max("seg_id").alias("events"), F.sum(F.col("seg_id") * (F.col("s") + F.col("e"))).alias("check_sum"))


@query("e04_user_ranges", "with p as (select user_id, cast(floor(epoch(ts - timestamp '2024-01-01') / 3600) as bigint) as t from events group by all), g as (select user_id, t, t - row_number() over (partition by user_id order by t) as g from p) select user_id, min(t) as s, max(t) as e from g group by user_id, g")
def user_ranges(spark: SparkSession, d: str) -> DataFrame:
    hours = fx.events(spark, d, "user_id").select(F.col("entity").alias("user_id"), "t", F.lit(1).alias("y")).distinct()
    return segments.runs(hours, ["user_id"]).select("user_id", "s", "e")


@query("e05_count_segments", f"with {fx.CELLS} select entity, var, cast(count(*) filter (where x > 0 and coalesce(p, 0) = 0) as bigint) as n_segments from (select entity, var, x, lag(x) over (partition by entity, var order by t) as p from (select entity, t, var, coalesce(x, 0) as x from cells)) group by all")
def count_segments(spark: SparkSession, d: str) -> DataFrame:
    return segments.count_segments(fx.cells(spark, d).fillna({"x": 0}), fx.BY, "x")


@query("e06_median_length", f"with {LS} select k.entity, case when m.m is null then 100 else greatest(cast(floor(m.m) as int), 1) end as width from (select distinct entity from cells) k left join (select entity, quantile_cont(e - s + 1, 0.5) as m from segments where entity <> 1 group by all) m using (entity)")
def median_length(spark: SparkSession, d: str) -> DataFrame:
    return segments.median_length(segments.runs(fx.labels(spark, d), ENTITY).where("entity <> 1"), fx.cells(spark, d).select("entity").distinct(), ENTITY)


@query("e07_validate_events", f"with {LS}, x as (select entity, s, case when entity = 2 then e_excl + 40 else e_excl end as e_excl from segments), n as (select *, lead(s) over (partition by entity order by s) as nxt from x) select entity, count(*) as n, bool_and(s < e_excl and (nxt is null or nxt >= e_excl)) as valid from n group by all")
def validate(spark: SparkSession, d: str) -> DataFrame:
    return segments.validate(segments.runs(fx.labels(spark, d), ENTITY).selectExpr("entity", "s", "case when entity = 2 then e_excl + 40 else e_excl end as e_excl"), ENTITY)


@query("e08_ranges", f"with {LS} select entity, min(least(s, f0)) as lo, max(greatest(e_excl, f1)) as hi from segments join (select entity, min(t) - 3 as f0, max(t) + 3 as f1 from labels group by all) using (entity) group by all")
def ranges(spark: SparkSession, d: str) -> DataFrame:
    lab = fx.labels(spark, d)
    found = lab.groupBy("entity").agg((F.min("t") - 3).alias("s"), (F.max("t") + 3).alias("e_excl"))
    return segments.ranges(segments.runs(lab, ENTITY), found, ENTITY)


@query("e09_merge_buffered", f"with {LS}, f as (select *, coalesce(lag(e + 10) over (partition by entity order by s) < s - 10, true) as st from segments), g as (select *, sum(st::int) over (partition by entity order by s) as grp from f), m as (select entity, grp, min(s - 10) as s, max(e + 10) as e, max(grp) over (partition by entity) as n from g group by entity, grp) select entity, cast(grp as bigint) as seg_id, case when grp = 1 then greatest(s, 0) else s end as s, case when grp = n then least(e, 719) else e end as e from m")
def merge_buffered(spark: SparkSession, d: str) -> DataFrame:
    return segments.merge_buffered(segments.runs(fx.labels(spark, d), ENTITY), ENTITY, "20", "719L")


_SOFT = "{LS}, m as (select entity, unnest(range({lo}, {hi})) as t, s, e from segments), b as (select entity, t, sum(sqrt(1 - (case when t {op} e then t - e else s - t end) / {scale})) as add from m where t < s or t {op} e group by all) select l.entity, l.t, round(least(1.0, l.y + coalesce(b.add, 0)), 8) as soft from labels l left join b using (entity, t)"


@query("e10_soft_labels", "with " + _SOFT.format(LS=LS, lo="s - 10", hi="e + 11", op=">", scale="20.0"))
def soft(spark: SparkSession, d: str) -> DataFrame:
    return segments.soft_labels(fx.labels(spark, d), ENTITY, 20).withColumn("soft", F.round("soft", 8))


@query("e11_soft_labels_share", "with " + _SOFT.format(LS=LS, lo="s - cast(floor((e - s + 1) * 0.5) as bigint)", hi="e + cast(floor((e - s + 1) * 0.5) as bigint)", op=">=", scale="(2.0 * cast(floor((e - s + 1) * 0.5) as bigint))"))
def soft_share(spark: SparkSession, d: str) -> DataFrame:
    return segments.soft_labels_from_end(fx.labels(spark, d), ENTITY, share=0.5).withColumn("soft", F.round("soft", 8))


@query("e11_soft_labels_window", "with " + _SOFT.format(LS=LS, lo="s - 5", hi="e + 5", op=">=", scale="10.0"))
def soft_window(spark: SparkSession, d: str) -> DataFrame:
    return segments.soft_labels_from_end(fx.labels(spark, d), ENTITY, window=10).withColumn("soft", F.round("soft", 8))
