"""Queries of the quality metrics on the derived scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import scratch
from ..operators import quality as ql
from . import by_threshold as bt
from . import fixtures as fx

BY = ["entity"]
Q, O = {}, {}


def duck(template: str, **tables: str) -> str:
    """The text for DuckDB over the fixtures' tables; other tables are texts themselves."""
    return template.format(**{"scores": "scores", "windows": "windows"}, **{k: f"({v})" for k, v in tables.items()})


def query(name: str, columns: list[str], keys: list[str], run, body: str, before: str = fx.SCORES) -> None:
    """Registers run(spark, dir) with `columns` rounded to eight places, and the SQL."""
    Q[name] = lambda spark, d: run(spark, d).select(*keys, *[F.round(F.col(c).cast("double"), 8).alias(c) for c in columns])
    O[name] = f"with {before} select {', '.join(keys)}, {', '.join(f'round(cast({c} as double), 8) as {c}' for c in columns)} from ({body}) res"


def on_scores(f):
    return lambda spark, d: f(fx.scores(spark, d), BY)


_NO = "select null"
query("flagship_rank_quality", ["auc_roc", "auc_pr", "f1"], BY, on_scores(ql.rank_metrics), _NO)
query("q02_auc_roc", ["auc_roc"], BY, on_scores(ql.rank_metrics), _NO)
query("q03_average_precision", ["auc_pr"], BY, on_scores(ql.rank_metrics), _NO)
query("q04_best_f1", ["f1"], BY, on_scores(ql.rank_metrics), _NO)
query("q06_sweep_counts", ["tp", "fp", "tpa", "hits", "n_seg", "pos"], [*BY, "th"], on_scores(ql.sweep), _NO)
query("q06_adjusted_f1", ["pa_f1"], BY, on_scores(ql.adjusted_f1), _NO)
query("q07_event_f1", ["event_f1"], BY, on_scores(ql.event_f1), _NO)
query("q08_range_recall", ["r_recall", "existence", "overlap", "r_precision"], [*BY, "th"], on_scores(ql.range_scores), _NO)
query("q10_range_f1", ["r_f"], BY, on_scores(ql.range_f1), _NO)
ZONES = duck(ql.text(bt.AFFILIATION_ZONES, BY))
query("q14_affiliation_zones", ["pred_len", "precision_p", "recall_p", "precision_d", "recall_d"], [*BY, "th", "seg"], on_scores(ql.affiliation_zones), ZONES)
AFF = duck(ql.text(bt.AFFILIATION, BY), zones=ZONES)
query("q17_affiliation", ["aff_precision", "aff_recall"], [*BY, "th"], on_scores(ql.affiliation), AFF)
query("q18_affiliation_f", ["aff_f"], BY, on_scores(ql.affiliation_f), duck(ql.text(bt.AFFILIATION_F, BY), affiliation=AFF))
query("q19_vus", ["vus_roc", "vus_pr"], BY, on_scores(ql.vus), _NO)
query("q21_range_auc", ["auc", "ap"], [*BY, "w"], on_scores(ql.range_auc), _NO)

query("q21_range_auc_share", ["auc", "ap"], BY, on_scores(lambda x, by: ql.range_auc_of_share(x, by, 0.5)), _NO)


def preds(spark: SparkSession, d: str) -> DataFrame:
    return fx.scores(spark, d).selectExpr("entity", "t", "y", "cast(score > 1.5 as int) as pred")


query("q05_point_adjust", ["y", "adjusted", "filled", "event"], [*BY, "t"], lambda s, d: ql.adjust(preds(s, d), BY), _NO)
query("q22_vus_of_predictions", ["vus_recall", "vus_precision", "vus_f"], BY, lambda s, d: ql.vus_of_predictions(preds(s, d), BY), _NO)
query("q23_report_of_predictions", ql.CLASSIC, BY, lambda s, d: ql.classic_report(fx.scores(s, d).withColumn("pred", (F.col("score") > 1.5).cast("int")), BY), _NO)
#: Algorithms that cut the score at a place of their own; the first predicts each hour, the last none.
ALGORITHMS = {"a0": -1, "a1": 1, "a2": 1.5, "a3": 1e9}


def files(spark: SparkSession, d: str) -> DataFrame:
    """What a folder of event files holds: each entity's labels and each algorithm's predictions, one of them cut short."""
    s = scratch(fx.scores(spark, d))
    parts = [s.selectExpr("entity as dataset", "'groundtruth' as algorithm", "t", "y")]
    parts += [s.selectExpr("entity as dataset", f"'{name}' as algorithm", "t", f"int(score > {cut}) as y").where("algorithm <> 'a2' or t < 700") for name, cut in ALGORITHMS.items()]
    return reduce(DataFrame.union, parts)


query("q29_batch_affiliation", ["aff_precision", "aff_recall", "aff_f"], ["dataset", "algorithm"], lambda s, d: ql.batch_affiliation(files(s, d)), _NO)
#: Hours before it are not judged.
START = 450


def sliced(spark: SparkSession, d: str) -> DataFrame:
    """Scores, some of which are no finite numbers."""
    broken = F.expr("case when t % 41 = 7 then double('nan') when t % 53 = 9 then double('infinity') when t % 59 = 11 then null else score end")
    return fx.scores(spark, d).withColumn("score", broken)


def slices(spark: SparkSession, d: str) -> DataFrame:
    part = ql.evaluation_slice(sliced(spark, d), BY, START)
    sums = part.groupBy("entity").agg(F.count("*").alias("n"), F.sum("y").alias("positives"), F.sum("score").alias("total"))
    return sums.join(ql.evaluation_windows(part, BY), "entity")


query("q01_evaluation_slice", ["n", "positives", "total", "win"], BY, slices, "select null")
query("q26_report", ["auc_roc", "auc_pr", "f1", "pa_f1", "event_f1", "r_f", "aff_f", "vus_roc", "vus_pr"], BY, lambda s, d: ql.report(scratch(sliced(s, d)), BY, start=START), "select null")
