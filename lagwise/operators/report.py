"""Results over seeds, epochs and entities."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.frames import sql

METRICS = ("auc_pr", "auc_roc", "f1", "pa_f1", "event_f1", "r_f", "aff_f", "vus_roc", "vus_pr")
#: Metrics whose sum picks the best epoch.
BEST = ("auc_pr", "auc_roc", "vus_pr", "vus_roc", "f1", "aff_f")


def _finite(m: str) -> str:
    return f"case when not isnan({m}) and abs({m}) < double('infinity') then {m} end"


def finite_stats(table: str, by: str, metrics: tuple[str, ...] = METRICS, sample: bool = False) -> str:
    """SQL of the mean and deviation (population, or sample: NULL of one value) of each metric's finite values (none: NULL)."""
    sd = "stddev_samp" if sample else "stddev_pop"
    return f"select {by}, " + ", ".join(f"avg({_finite(m)}) as {m}_mean, {sd}({_finite(m)}) as {m}_std" for m in metrics) + f" from {table} group by {by}"


def best_epoch(table: str, by: str, metrics: tuple[str, ...] = BEST) -> str:
    """SQL of each entity's epoch with the largest sum of mean metrics (missing ones count nothing), the earliest of equals."""
    total = " + ".join(f"coalesce({m}_mean, 0e0)" for m in metrics)
    return f"select * from (select *, {total} as total, row_number() over (partition by {by} order by {total} desc, epoch) as place from {table}) r where place = 1"


def over_seeds(metrics: DataFrame) -> DataFrame:
    return sql(finite_stats("{metrics}", "entity"), metrics=metrics)


def over_epochs(metrics: DataFrame) -> DataFrame:
    return sql(finite_stats("{metrics}", "entity, epoch", sample=True), metrics=metrics)


def best(metrics: DataFrame) -> DataFrame:
    return sql(best_epoch("{epochs}", "entity"), epochs=over_epochs(metrics))


def require(metrics: DataFrame, columns: tuple[str, ...] = ("entity", "seed", "epoch", *METRICS)) -> DataFrame:
    """metrics itself; an error that names missing columns, before anything is read."""
    missing = [c for c in columns if c not in metrics.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return metrics
