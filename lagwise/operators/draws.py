"""Seeded draws and permutations that any engine can repeat: random numbers are hashes of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks


def share(*parts: str) -> str:
    """A number from 0 to below 1 by the parts (columns or literals): the first 32 bits of their MD5."""
    return f"cast(conv(substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8), 16, 10) as bigint) / 4294967296D"


def sampled_edges(prior: DataFrame, runs: DataFrame, by: list[str], run: list[str], number: int) -> DataFrame:
    """(by, run, draw, tau, src): for each run `number` draws of (tau, src), with replacement, in proportion to the sums of their gates.

    runs are (by, run). Without any gate open all are as likely. A series' running sums are an array as long as it has
    pairs of lag and source, in which a draw finds its place.
    """
    mass = prior.groupBy(*by, "tau", "src").agg(F.sum("gate").alias("m"))
    all_, to = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("tau", "src")
    mass = mass.withColumn("m", F.when(F.sum("m").over(all_) > 1e-8, F.col("m")).otherwise(F.lit(1.0)))
    mass = mass.withColumn("hi", F.round(F.sum("m").over(to) / F.sum("m").over(all_), 10))
    places = mass.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("tau", "src", "hi"))).alias("_e"))
    drawn = runs.select(*by, *run, F.explode(F.sequence(F.lit(0), F.lit(number - 1))).alias("draw")).withColumn("_u", F.expr(share(*by, *run, "draw")))
    found = drawn.join(places, by).withColumn("_at", F.expr("_e[least(size(filter(_e, e -> e.hi <= _u)), size(_e) - 1)]"))
    return found.select(*by, *run, "draw", F.col("_at.tau").alias("tau"), F.col("_at.src").alias("src"))


def permuted(series: DataFrame, by: list[str], block: int, seed: int, value: str = "z", size: int = blocks.SIZE) -> DataFrame:
    """(by, t, before, after): values permuted at random within blocks of `block` rows; a block of one row stays as it is."""
    rows = blocks.placed(series.select(*by, "t", F.col(value).alias("v")), by, size=size)
    rows = rows.withColumn("_b", F.floor(F.col("_place") / block)).withColumn("_u", F.expr(share(*by, "t", repr(str(seed)))))
    keys = [*by, "_b"]
    first = rows.select(*keys, "t", F.col("v").alias("before"), F.row_number().over(Window.partitionBy(*keys).orderBy("t")).alias("_i"))
    other = rows.select(*keys, F.col("v").alias("after"), F.row_number().over(Window.partitionBy(*keys).orderBy("_u", "t")).alias("_i"))
    return first.join(other, [*keys, "_i"]).select(*by, "t", "before", "after")
