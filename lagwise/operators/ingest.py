"""Cleaning, imputation, standardisation and labels of cells (entity, t, var, x) and frames.

NaN and infinities are missing values; NULL stands for a missing value everywhere else.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import listed, same, sql
from . import blocks

# Fixed value: names of columns that hold time (searched anywhere in the name, as letters only, hence `runtime` as well).
TIME_LIKE = re.compile("time|timestamp|date|index|idx", re.IGNORECASE)
# Fixed value: the same for tables whose columns are numbered or indexed by name: an index is a feature there.
CLOCK_LIKE = re.compile("time|date|timestamp", re.IGNORECASE)
# Words that label a row as an anomaly or as normal; the first list is tested first.
ANOMALOUS = "attack|anomaly|abnormal|fault|1|true|yes"
NORMAL = "normal|0|false|no"
# Names under which a label column is looked for.
LABEL_NAMES = ("Normal/Attack", "Normal_Attack", "label", "Label", "Attack", "attack", "anomaly", "Anomaly")


def drop_time_columns(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if TIME_LIKE.search(c)])


def numeric_columns(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Names stripped; unnamed columns, those named for time or date, `extra` and non-numeric ones gone."""
    df = df.withColumnsRenamed({c: c.strip() for c in df.columns if c != c.strip()})
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
    keep = [c for c, t in df.dtypes if (t in kinds or t.startswith("decimal")) and not c.lower().startswith("unnamed") and not CLOCK_LIKE.search(c) and c not in extra]
    return df.select(*[f"`{c}`" for c in keep])


def common_columns(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with the columns they share, in the order of train."""
    keep = [c for c in train.columns if c in test.columns]
    if not keep:
        raise ValueError("train and test share no column")
    return train.select(*keep), test.select(*keep)


def label_column(df: DataFrame, names: tuple[str, ...] = LABEL_NAMES) -> str:
    """The first of df's columns whose name, stripped, is among `names`."""
    found = next((c for c in df.columns if c.strip() in names), None)
    if found is None:
        raise ValueError(f"no label column among {df.columns}")
    return found


def finite(x: Column) -> Column:
    """x, or NULL for NaN and infinities."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def interpolate(cells: DataFrame, by: list[str], t: str = "t", x: str = "x", size: int = blocks.SIZE) -> DataFrame:
    """x filled linearly by position between neighbours, by the nearest one at the edges, 0 where there is none.

    The nearest known values are found in blocks of `size` times and carried over from the blocks around.
    """
    known = F.when(F.col(x).isNotNull(), F.struct(F.col(t).alias("t"), F.col(x).alias("x")))
    near = blocks.nearest_known(cells.select(*by, t, x), by, known, t, size)
    line = f"case when _after.t > _before.t then _before.x + (_after.x - _before.x) * ({t} - _before.t) / (_after.t - _before.t) end"
    return near.select(*by, t, F.expr(f"coalesce({line}, _before.x, _after.x, 0)").alias(x))


def train_means(cells: DataFrame, by: list[str], train: str) -> DataFrame:
    """fill_mean of each series over its train rows (0 for a series without values)."""
    return sql(f"select {listed(by)}, coalesce(avg(case when {train} then x end), 0) as fill_mean from {{cells}} group by {listed(by)}", cells=cells)


def impute(cells: DataFrame, by: list[str], train: str) -> DataFrame:
    """Missing x replaced by the train mean of its series, in all rows."""
    means = train_means(cells, by, train)
    return sql(f"select c.* except (x), coalesce(c.x, m.fill_mean) as x from {{cells}} c join {{means}} m on {same(by, 'c', 'm')}", cells=cells, means=means)


def scaler(cells: DataFrame, by: list[str], train: str, mode: str = "standard") -> DataFrame:
    """mu and sd (population; 1 for a constant series) of each imputed series over its train rows."""
    if mode == "none":
        return sql(f"select distinct {listed(by)}, 0.0D as mu, 1.0D as sd from {{cells}}", cells=cells)
    if mode != "standard":
        raise ValueError(f"unknown scale mode {mode!r}")
    stats = sql(f"select {listed(by)}, avg(case when {train} then x end) as mu, stddev_pop(case when {train} then x end) as s from {{cells}} group by {listed(by)}", cells=cells)
    return stats.select(*by, "mu", F.when(F.coalesce("s", F.lit(0)) == 0, 1.0).otherwise(F.col("s")).alias("sd"))


def standardise(cells: DataFrame, by: list[str], train: str, mode: str = "standard") -> DataFrame:
    """Imputed and standardised: x replaced by z."""
    full = impute(cells, by, train)
    scale = scaler(full, by, train, mode)
    return sql(f"select c.* except (x), (c.x - s.mu) / s.sd as z from {{full}} c join {{scale}} s on {same(by, 'c', 's')}", full=full, scale=scale)


def any_label(labels: Column) -> Column:
    """1 if an array of labels has a positive sum."""
    return (F.aggregate(labels, F.lit(0.0), lambda a, y: a + F.coalesce(y.cast("double"), F.lit(0.0))) > 0).cast("int")


def numeric_label(y: Column) -> Column:
    return (F.coalesce(y, F.lit(0)) != 0).cast("int")


def text_label(raw: Column) -> Column:
    """1 for a text with a word for anomalies, 0 for one for normal rows, else whether it is a number other than 0 (`nan` is)."""
    text = F.lower(F.trim(raw))
    return F.when(text.rlike(ANOMALOUS), 1).when(text.rlike(NORMAL), 0).otherwise(F.coalesce(text.try_cast("double") != 0, F.lit(False)).cast("int"))


def long_enough(cells: DataFrame, entity: str, train: str, length: int) -> DataFrame:
    """Rows of entities whose train and test parts both have more than `length` times."""
    ok = sql(
        f"select {entity} from {{cells}} group by {entity} having count(distinct case when {train} then t end) > {length} and count(distinct case when not ({train}) then t end) > {length}",
        cells=cells,
    )
    return cells.join(ok, entity, "left_semi")


def ingest_report(labels: DataFrame, by: list[str]) -> DataFrame:
    """Rows, positives, their share and the distinct labels."""
    return sql(f"select {listed(by)}, count(*) as n, sum(y) as positives, avg(y) as ratio, array_join(sort_array(collect_set(y)), ',') as labels from {{labels}} group by {listed(by)}", labels=labels)


def check_lengths(cells: DataFrame, labels: DataFrame, entity: str, train: str) -> DataFrame:
    """Entities with the variables of both parts, and times and labels of the test part, and whether they agree."""
    return sql(
        f"""
        with c as (select {entity}, count(distinct case when {train} then var end) as train_vars, count(distinct case when not ({train}) then var end) as test_vars,
                          count(distinct case when not ({train}) then t end) as times from {{cells}} group by {entity}),
             l as (select {entity}, count(*) as labels from {{labels}} group by {entity})
        select c.*, coalesce(l.labels, 0) as labels, train_vars = test_vars and times = coalesce(l.labels, 0) as valid from c left join l on c.{entity} = l.{entity}
        """,
        cells=cells,
        labels=labels,
    )


def paired(train: DataFrame, test: DataFrame, labels: DataFrame, entity: str) -> DataFrame:
    """Entities that all three have and whose parts have equally many variables; others are skipped."""
    return sql(
        f"""
        with a as (select {entity}, count(distinct var) as n_train from {{train}} group by {entity}),
             b as (select {entity}, count(distinct var) as n_test from {{test}} group by {entity}),
             l as (select distinct {entity} from {{labels}})
        select a.{entity}, n_train from a join b on a.{entity} = b.{entity} join l on a.{entity} = l.{entity} where n_train = n_test
        """,
        train=train,
        test=test,
        labels=labels,
    )
