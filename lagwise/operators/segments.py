"""Segments: maximal runs of positive labels, closed [s, e]."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import listed, same, sql
from . import blocks


def runs(labels: DataFrame, by: list[str], y: str = "y", size: int = blocks.SIZE) -> DataFrame:
    """(by, seg_id from 1, s, e, e_excl) of each run of y > 0 over consecutive t, in blocks of `size` times."""
    found = blocks.by_time(blocks.islands(labels.where(F.col(y) > 0), by, size=size), "s", size)
    numbered = blocks.running(found, by, [F.col("s")], {"seg_id": F.lit(1)})
    return numbered.select(*by, F.col("seg_id").cast("int").alias("seg_id"), "s", "e", (F.col("e") + 1).alias("e_excl"))


def count_segments(series: DataFrame, by: list[str], x: str) -> DataFrame:
    """How often x turns positive."""
    k = listed(by)
    return sql(
        f"""
        with p as (select {k}, {x} > 0 and coalesce(lag({x}) over (partition by {k} order by t), 0) = 0 as start from {{series}})
        select {k}, count_if(start) as n_segments from p group by {k}
        """,
        series=series,
    )


def median_length(segments: DataFrame, entities: DataFrame, by: list[str], default: int = 100) -> DataFrame:
    """The median segment length, rounded down, 1 at least; `default` for entities without segments."""
    return sql(
        f"""
        with m as (select {listed(by)}, percentile(e - s + 1, 0.5) as m from {{segments}} group by {listed(by)})
        select {listed(by, 'a.')}, case when m.m is null then {default} else greatest(cast(floor(m.m) as int), 1) end as width from {{entities}} a left join m on {same(by, 'a', 'm')}
        """,
        segments=segments,
        entities=entities,
    )


def validate(segments: DataFrame, by: list[str]) -> DataFrame:
    """Whether each entity's events are ordered, disjoint and of positive length when taken as [s, e_excl)."""
    k = listed(by)
    return sql(
        f"""
        with n as (select *, lead(s) over (partition by {k} order by s) as nxt from {{segments}})
        select {k}, count(*) as n, bool_and(s < e_excl and (nxt is null or nxt >= e_excl)) as valid from n group by {k}
        """,
        segments=segments,
    )


def ranges(truth: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """(by, lo, hi): the range that an entity's true and found events span; entities without a true event are left out."""
    k = listed(by)
    return sql(
        f"""
        with u as (select {k}, s, e_excl, 1 as true_one from {{truth}} union all select {k}, s, e_excl, 0 from {{found}})
        select {k}, min(s) as lo, max(e_excl) as hi from u group by {k} having max(true_one) = 1
        """,
        truth=truth,
        found=found,
    )


def merge_buffered(segments: DataFrame, by: list[str], window: str, last: str) -> DataFrame:
    """(by, s, e): segments merged where their margins of half the window meet; the first starts at 0 or later, the last ends at `last` or before.

    `window` and `last` are expressions over the segments' columns.
    """
    k = listed(by)
    return sql(
        f"""
        with n as (select *, ({window}) div 2 as h, {last} as last_t from {{segments}}),
             f as (select *, coalesce(lag(e + h) over (partition by {k} order by s) < s - h, true) as start from n),
             g as (select *, sum(cast(start as int)) over (partition by {k} order by s) as grp from f),
             m as (select {k}, grp, min(s - h) as s, max(e + h) as e, max(last_t) as last_t, max(grp) over (partition by {k}) as groups from g group by {k}, grp)
        select {k}, grp as seg_id, case when grp = 1 then greatest(s, 0) else s end as s, case when grp = groups then least(e, last_t) else e end as e from m
        """,
        segments=segments,
    )


def soft_labels(labels: DataFrame, by: list[str], window: int) -> DataFrame:
    """(by, t, soft): labels with margins of half the window that fall with the distance from a segment."""
    h, k = window // 2, listed(by)
    return sql(
        f"""
        with m as (select {k}, explode(sequence(s - {h}, e + {h})) as t, s, e from {{segments}}),
             b as (select {k}, t, sum(sqrt(1 - (case when t > e then t - e when t < s then s - t end) / {max(window, 1)}.0D)) as add from m where t < s or t > e group by {k}, t)
        select {listed([*by, 't'], 'l.')}, least(1.0D, l.y + coalesce(b.add, 0)) as soft from {{labels}} l left join b on {same([*by, 't'], 'l', 'b')}
        """,
        labels=labels,
        segments=runs(labels, by),
    )


def soft_labels_from_end(labels: DataFrame, by: list[str], window: int | None = None, share: float | None = None) -> DataFrame:
    """The older margins: they start at a segment's last time itself and leave their outer end out.

    Their width is half the window, or the share of each segment's length (whose distance counts by twice the width).
    """
    k = listed(by)
    width = f"{window // 2}" if share is None else f"cast(floor((e - s + 1) * {share}D) as int)"
    scale = f"{window}.0D" if share is None else "(2.0D * w)"
    return sql(
        f"""
        with q as (select *, {width} as w from {{segments}}),
             m as (select {k}, explode(sequence(s - w, e + w - 1)) as t, s, e, w from q where w > 0),
             b as (select {k}, t, sum(sqrt(1 - (case when t >= e then t - e else s - t end) / {scale})) as add from m where t < s or t >= e group by {k}, t)
        select {listed([*by, 't'], 'l.')}, least(1.0D, l.y + coalesce(b.add, 0)) as soft from {{labels}} l left join b on {same([*by, 't'], 'l', 'b')}
        """,
        labels=labels,
        segments=runs(labels, by),
    )
