"""Window functions over series of any length: rows in blocks, and what must pass from block to block.

A window over a whole series is one task's work. Here a series is cut into blocks of at most about `size` rows; windows run
within a block, and what they need of others comes from a table with a row for each block: running sums start from the
totals of the blocks before, neighbours' values are carried over, and windows of a few rows see the last rows of the block
before (its halo). The tables of blocks are rows / size long. Rows without a key belong to no series and are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZE = 1 << 16
#: Blocks of a series by value, at most.
QUANTILES = 1024
BLOCK = "_block"


def by_time(rows: DataFrame, t: str = "t", size: int = SIZE) -> DataFrame:
    """Adds the block of each row: `size` consecutive times. Times differ within a series, so a block has at most `size` rows."""
    return rows.withColumn(BLOCK, F.floor(F.col(t) / F.lit(size)).cast("long"))


def by_value(rows: DataFrame, by: list[str], x: str, size: int = SIZE) -> DataFrame:
    """Adds the block of each row, numbered from the largest x down; equal x share a block.

    The borders are approximate quantiles of each series' different values, as many as its rows ask for; where they lie
    decides how even blocks are, never a result. Rows are to differ in x, as they do when grouped by it.
    """
    found = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx(x, [i / QUANTILES for i in range(1, QUANTILES)], 10_000).alias("_q"))
    blocks = F.least(F.ceil(F.col("_n") / size), F.lit(QUANTILES))
    found = found.withColumn("_step", F.floor(QUANTILES / blocks).cast("int"))
    # every _step-th quantile; none for a series of one block
    borders = found.select(*by, F.expr(f"array_distinct(filter(_q, (v, i) -> _step < {QUANTILES} and (i + 1) % _step = 0))").alias("_q"))
    return rows.join(borders, by).withColumn(BLOCK, F.expr(f"cast(size(filter(_q, v -> v > {x})) as long)")).drop("_q")


def running(rows: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column], totals: dict[str, str] | None = None) -> DataFrame:
    """Adds running sums in order, each row's own included; and, by name, the series' total of such a sum.

    rows has its blocks, which are in that order too. Within a block a window adds up; what the blocks before add up to
    comes from the table of blocks.
    """
    keys = [*by, BLOCK]
    local = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({f"_in_{n}": F.sum(c).over(local) for n, c in sums.items()})
    blocks = rows.groupBy(*keys).agg(*[F.sum(c).alias(f"_of_{n}") for n, c in sums.items()])
    whole, before = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns({f"_to_{n}": F.coalesce(F.sum(f"_of_{n}").over(before), F.lit(0)) for n in sums} | {t: F.sum(f"_of_{n}").over(whole) for t, n in (totals or {}).items()})
    out = out.join(blocks.drop(*[f"_of_{n}" for n in sums]), keys)
    return out.withColumns({n: F.col(f"_in_{n}") + F.col(f"_to_{n}") for n in sums}).drop(*[f"_{p}_{n}" for p in ("in", "to") for n in sums])


def placed(rows: DataFrame, by: list[str], t: str = "t", size: int = SIZE, place: str = "_place") -> DataFrame:
    """Adds each row's place in its series, from 0, by t."""
    out = running(by_time(rows, t, size), by, [F.col(t)], {place: F.lit(1).cast("long")})
    return out.withColumn(place, F.col(place) - 1).drop(BLOCK)


def with_halo(rows: DataFrame, by: list[str], before: int, t: str = "t", size: int = SIZE) -> tuple[DataFrame, list[str]]:
    """Rows in blocks by place, each block with the `before` rows ahead of it; and the keys of a block.

    Rows of the halo have `_own` false: they serve the windows of others and are to be left out behind these.
    """
    size = max(size, before + 1)
    at = placed(rows, by, t, size)
    home = F.floor(F.col("_place") / size).cast("long")
    late = F.col("_place") % size >= size - before
    both = at.withColumn("_home", home).withColumn(BLOCK, F.explode(F.when(late, F.array(home, home + 1)).otherwise(F.array(home))))
    # a halo behind a series' last block belongs to none
    return both.withColumn("_own", F.col(BLOCK) == F.col("_home")).drop("_home"), [*by, BLOCK]


def nearest_known(rows: DataFrame, by: list[str], value: Column, t: str = "t", size: int = SIZE) -> DataFrame:
    """Adds _before and _after: the last value that is not null at or before a row, and the first at or behind it."""
    cut = by_time(rows, t, size).withColumn("_v", value)
    keys = [*by, BLOCK]
    inside = Window.partitionBy(*keys).orderBy(t)
    cut = cut.withColumns({
        "_a": F.last("_v", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)),
        "_b": F.first("_v", ignorenulls=True).over(inside.rowsBetween(0, Window.unboundedFollowing)),
    })
    # a block's first and last known values; max and min of structs pass null over
    known = cut.where("_v is not null").groupBy(*keys).agg(F.min_by("_v", t).alias("_first"), F.max_by("_v", t).alias("_last"))
    blocks = cut.select(*keys).distinct().join(known, keys, "left")
    across = Window.partitionBy(*by).orderBy(BLOCK)
    blocks = blocks.select(
        *keys,
        F.last("_last", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_ahead"),
        F.first("_first", ignorenulls=True).over(across.rowsBetween(1, Window.unboundedFollowing)).alias("_behind"),
    )
    out = cut.join(blocks, keys)
    return out.withColumns({"_before": F.coalesce("_a", "_ahead"), "_after": F.coalesce("_b", "_behind")}).drop(BLOCK, "_v", "_a", "_b", "_ahead", "_behind")


def islands(times: DataFrame, by: list[str], t: str = "t", size: int = SIZE) -> DataFrame:
    """(by, s, e): maximal runs of consecutive times. Runs are found in each block; those at its borders are stitched."""
    cut = by_time(times.select(*by, t), t, size)
    keys = [*by, BLOCK]
    step = F.col(t) - F.row_number().over(Window.partitionBy(*keys).orderBy(t))
    parts = cut.withColumn("_g", step).groupBy(*keys, "_g").agg(F.min(t).alias("s"), F.max(t).alias("e"))
    inner = (F.col("s") > F.col(BLOCK) * size) & (F.col("e") < (F.col(BLOCK) + 1) * size - 1)
    # at most two runs of a block touch its borders
    order = Window.partitionBy(*by).orderBy("s")
    edge = parts.where(~inner).withColumn("_new", (F.coalesce(F.lag("e").over(order) + 1 < F.col("s"), F.lit(True))).cast("int"))
    edge = edge.withColumn("_g", F.sum("_new").over(order)).groupBy(*by, "_g").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return parts.where(inner).select(*by, "s", "e").unionByName(edge.select(*by, "s", "e"))


def beside(rows: DataFrame, by: list[str], order: str, values: dict[str, tuple[str, int]], size: int = SIZE) -> DataFrame:
    """Adds by name a column's value in the row before (-1) or behind (1) in the order of `order`, an integer; null where there is none."""
    cut = by_time(rows, order, size)
    keys = [*by, BLOCK]
    near, across = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*by).orderBy(BLOCK)
    step = {-1: F.lag, 1: F.lead}
    ends = {-1: F.max_by, 1: F.min_by}
    # structs, so that a null value is not taken for a missing row
    cut = cut.withColumns({f"_{n}": step[d](F.struct(F.col(c).alias("v"))).over(near) for n, (c, d) in values.items()})
    blocks = cut.groupBy(*keys).agg(*[ends[d](F.struct(F.col(c).alias("v")), order).alias(f"_of_{n}") for n, (c, d) in values.items()])
    blocks = blocks.select(*keys, *[step[d](f"_of_{n}").over(across).alias(f"_to_{n}") for n, (c, d) in values.items()])
    out = cut.join(blocks, keys)
    out = out.withColumns({n: F.coalesce(f"_{n}", f"_to_{n}")["v"] for n in values})
    return out.drop(BLOCK, *[f"_{n}" for n in values], *[f"_to_{n}" for n in values])
