"""Row-count windows over series. A window is named by the time of its first row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import listed, same, sql
from . import blocks


def sliding(frames: DataFrame, by: list[str], length: int, xs: str = "xs", size: int = blocks.SIZE) -> DataFrame:
    """(by, win, t_end, xs): the last `length` rows of each row that has as many; a series' last length - 1 rows before.

    In blocks of `size` rows that see the length - 1 rows before them.
    """
    rows, keys = blocks.with_halo(frames.select(*by, "t", F.col(xs).alias("_x")), by, length - 1, size=size)
    last = Window.partitionBy(*keys).orderBy("t").rowsBetween(1 - length, 0)
    out = rows.withColumn("xs", F.collect_list("_x").over(last)).where(F.col("_own") & (F.size("xs") == length))
    return out.select(*by, (F.col("t") - (length - 1)).alias("win"), F.col("t").alias("t_end"), "xs")


def environments(windows: DataFrame, by: list[str], k: int) -> DataFrame:
    """Adds env, which splits each series' windows into k nearly equal runs."""
    p = listed(by)
    return sql(
        f"""
        with n as (select *, row_number() over (partition by {p} order by win) - 1 as _i, count(*) over (partition by {p}) as _n from {{windows}})
        select * except (_i, _n), case when {k} <= 1 or _n <= 1 then 0 else least(greatest(_i * {k} div _n, 0), {k} - 1) end as env from n
        """,
        windows=windows,
    )


def lag_windows(cells: DataFrame, by: list[str], lag: int, width: int, length: int, size: int = blocks.SIZE) -> DataFrame:
    """Adds xs: the `width` values that end `lag` rows before each row, clipped to its window of `length` rows."""
    first = min(lag + width - 1, length - 1)
    rows, keys = blocks.with_halo(cells, by, first, size=size)
    xs = F.collect_list("x").over(Window.partitionBy(*keys).orderBy("t").rowsBetween(-first, -lag))
    return rows.withColumn("xs", xs).where("_own").select(*cells.columns, "xs")


def lagged_pairs(cells: DataFrame, by: list[str], tau_max: int, size: int = blocks.SIZE) -> DataFrame:
    """(by, var, t, tau, y, x): each value with that of the same variable tau rows before, tau from 1 to tau_max."""
    rows, keys = blocks.with_halo(cells, [*by, "var"], tau_max, size=size)
    order = Window.partitionBy(*keys).orderBy("t")
    lags = F.array(*[F.struct(F.lit(i).alias("tau"), F.lag("x", i).over(order).alias("x")) for i in range(1, tau_max + 1)])
    out = rows.withColumn("_lags", lags).where("_own").select(*by, "var", "t", F.col("x").alias("y"), F.explode("_lags").alias("_l"))
    return out.select(*by, "var", "t", "_l.tau", "y", "_l.x").where("x is not null")


def chunk_bounds(frames: DataFrame, by: list[str], starts: list[float], chunk: int, tau_max: int) -> DataFrame:
    """(by, chunk, s, e): chunks of a series at the given shares (0 to 1) of the possible starts; one chunk if it is short."""
    least = max(tau_max + 3, 16)
    size = max(chunk, least)
    k = listed(by)
    shares = ", ".join(repr(float(s)) + "D" for s in starts)
    sizes = sql(f"select {k}, count(distinct t) as n, min(t) as t0 from {{frames}} group by {k}", frames=frames)
    each = sql(f"select *, posexplode(array({shares})) as (i, share) from {{sizes}}", sizes=sizes)
    return sql(
        f"""
        select {k}, i as chunk, case when n <= {size} then t0 else t0 + floor(share * (n - {size})) end as s,
               case when n <= {size} then t0 + n - 1 else t0 + floor(share * (n - {size})) + {size} - 1 end as e
        from {{each}} where n > {size} or i = 0
        """,
        each=each,
    )


def cut_chunks(cells: DataFrame, chunks: DataFrame, by: list[str]) -> DataFrame:
    """Each chunk's cells. The table of chunks is as small as entities times starts; the join is by entity."""
    return sql(f"select c.*, k.chunk from {{cells}} c join {{chunks}} k on {same(by, 'c', 'k')} and c.t between k.s and k.e", cells=cells, chunks=chunks)
