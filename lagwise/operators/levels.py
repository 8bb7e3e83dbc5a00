"""Predicted segments of all thresholds at once: how they are born, grow and join as the threshold falls.

A point's level is the number of thresholds below its score; at threshold th the points with a level above th are
predicted. A segment lives from the threshold at which its lowest point appears down to where it joins a neighbour, so
a series of n points has at most n different segments over all thresholds, with a range of thresholds each. The gaps
between segments are the same with levels turned round. Segments inside a block of points come from one pass with a
stack; those at the borders of blocks are made threshold by threshold from the parts at the blocks' ends.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks

THRESHOLDS = 100
_KIND = {"run": 0, "gap": 1}


def _inside(v: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(first, last, lo, hi) of each run of values above th, for th from lo to hi, that touches neither end."""
    out, stack = [], []  # (first place, value), values rising
    for j, x in enumerate([*v.tolist(), -1]):
        first = j
        while stack and stack[-1][1] > x:
            first, value = stack.pop()
            if stack and j < len(v):
                lo = max(stack[-1][1], x)
                if lo < value:
                    out.append((first, j - 1, lo, value - 1))
        if not stack or stack[-1][1] < x:
            stack.append((first, x))
    return out


def _ends(v: np.ndarray, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each threshold the length of the run at the beginning, and the sum of `counted` over it."""
    least = np.minimum.accumulate(v)
    length = np.searchsorted(-least, -np.arange(THRESHOLDS), side="left")  # places whose least value is above th
    return length, np.concatenate(([0], np.cumsum(counted)))[length]


def _block(i0: int, v: np.ndarray, y: np.ndarray, kind: str) -> tuple[list[tuple], tuple]:
    """Whole runs of a block as (kind, s, e, lo, hi, hits, card), and what is at its ends."""
    turned = v if kind == "run" else THRESHOLDS - v
    hits = np.concatenate(([0], np.cumsum(y)))
    rises = np.concatenate(([y[0]], y[1:] * (1 - y[:-1])))  # first points of labelled segments
    starts = np.concatenate(([0], np.cumsum(rises)))
    out = []
    for a, b, lo, hi in _inside(turned):
        card = int(starts[b + 1] - starts[a + 1] + y[a])
        if kind == "gap":
            lo, hi = THRESHOLDS - 1 - hi, THRESHOLDS - 1 - lo
        out.append((_KIND[kind], i0 + a, i0 + b, lo, hi, int(hits[b + 1] - hits[a]), card))
    left, left_hits = _ends(turned, y)
    _, left_rises = _ends(turned, rises)
    right, right_hits = _ends(turned[::-1], y[::-1])
    # a run's first point counts as a rise whatever lies before
    falls = np.concatenate(([y[-1]], y[::-1][1:] * (1 - y[::-1][:-1])))
    _, right_rises = _ends(turned[::-1], falls)
    return out, (len(v), int(turned[-1]), int(y[0]), int(y[-1]), *(a.tolist() for a in (left, left_hits, left_rises, right, right_hits, right_rises)))


def levels(points: DataFrame, by: list[str], kinds: tuple[str, ...] = ("run",), size: int = blocks.SIZE) -> DataFrame:
    """(by, kind, s, e, lo, hi, hits, card) of points (by, i, y, nb), i without gaps from 0.

    kind 0: a run of points with nb > th for each threshold th from lo to hi; kind 1: a gap between runs. hits are
    its labelled points, card the labelled segments that it touches.
    """
    cut = blocks.by_time(points.select(*by, "i", F.col("y").cast("int").alias("y"), F.col("nb").cast("int").alias("nb")), "i", size)
    keys = [*by, blocks.BLOCK]
    kind_of = {k: cut.schema[k].dataType.simpleString() for k in keys}
    ends = "m int, last int, y0 int, y1 int, pl array<int>, ph array<int>, pr array<int>, sl array<int>, sh array<int>, sr array<int>"
    ends_names = [c.split()[0] for c in ends.split(", ")]
    names = [*keys, "kind", "s", "e", "lo", "hi", "hits", "card", *ends_names]
    schema = ", ".join([*[f"`{k}` {t}" for k, t in kind_of.items()], "kind int, s long, e long, lo int, hi int, hits long, card long", ends])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        i0 = table.column("i")[0].as_py()
        v, y = table.column("nb").to_numpy(), table.column("y").to_numpy()
        rows = []
        for kind in kinds:
            found, end = _block(i0, v, y, kind)
            rows += [(*r, *[None] * len(ends_names)) for r in found]
            rows.append((_KIND[kind], i0, None, None, None, None, None, *end))
        columns = list(zip(*rows, strict=True))
        ints = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.int32()] * 4, *[pa.list_(pa.int32())] * 6]
        key = table.select(keys).take(pa.array(np.zeros(len(rows), np.int64)))
        return pa.table([*key.columns, *[pa.array(c, t) for c, t in zip(columns, ints, strict=True)]], names=names)

    found = cut.groupBy(*keys).applyInArrow(run, schema)
    whole = found.where("m is null").select(*by, "kind", "s", "e", "lo", "hi", "hits", "card")
    # parts at the ends of blocks, for each threshold; a chain goes on through blocks that are one part
    at = Window.partitionBy(*by, "kind").orderBy(blocks.BLOCK)
    parts = found.where("m is not null").withColumns({"last0": F.lag("last").over(at), "y_before": F.lag("y1").over(at)})
    parts = parts.select("*", F.explode(F.sequence(F.lit(0), F.lit(THRESHOLDS - 1))).alias("th"))
    pick = {c: F.col(c)[F.col("th")] for c in ("pl", "ph", "pr", "sl", "sh", "sr")}
    parts = parts.withColumns(pick).withColumn("full", F.col("pl") == F.col("m"))
    along = Window.partitionBy(*by, "kind", "th").orderBy(blocks.BLOCK)
    parts = parts.withColumn("chain", F.sum(F.when(F.col("full"), 0).otherwise(1)).over(along) - F.when(F.col("full"), 0).otherwise(1))
    joins = F.when((F.col("last0") > F.col("th")) & (F.col("y_before") == 1) & (F.col("y0") == 1), 1).otherwise(0)
    left = F.struct(F.col("chain").alias("chain"), F.col("s").alias("a"), (F.col("s") + F.col("pl") - 1).alias("b"), F.col("ph").alias("h"), (F.col("pr") - joins).alias("r"), F.col("pl").alias("n"))
    right = F.struct((F.col("chain") + 1).alias("chain"), (F.col("s") + F.col("m") - F.col("sl")).alias("a"), (F.col("s") + F.col("m") - 1).alias("b"), F.col("sh").alias("h"), F.col("sr").alias("r"), F.col("sl").alias("n"))
    pieces = parts.select(*by, "kind", "th", F.explode(F.when(F.col("full"), F.array(left)).otherwise(F.array(left, right))).alias("p")).where("p.n > 0")
    chains = pieces.groupBy(*by, "kind", "th", "p.chain").agg(F.min("p.a").alias("s"), F.max("p.b").alias("e"), F.sum("p.h").alias("hits"), F.sum("p.r").alias("card"))
    th = F.when(F.col("kind") == 0, F.col("th")).otherwise(THRESHOLDS - 1 - F.col("th")).cast("int")
    return whole.unionByName(chains.select(*by, "kind", "s", "e", th.alias("lo"), th.alias("hi"), "hits", "card"))
