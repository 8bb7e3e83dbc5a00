"""Series, labels, priors and results in files.

Bundles (.npz, .npy) cannot be split: each is one row of a binary read and is decoded by one task, once, into Parquet.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.frames import scratch
from ..operators.ingest import drop_time_columns, finite

FRAMES = "entity string, split string, t long, xs array<double>"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header; types inferred, time columns gone."""
    return drop_time_columns(spark.read.option("header", True).option("inferSchema", True).csv(path))


def lines(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, name, t, value): the lines of text files that are not blank, numbered from 0 in each file.

    Plain files are read in byte ranges, each by its own task: a line's number is its place in its range and the lines of
    the ranges before. A packed file is one range, read line by line. The lines are written once as a table, so that a task
    that is run again numbers none anew; the table of ranges has a row for each.
    """
    reader = spark.read if pattern is None else spark.read.option("pathGlobFilter", pattern)
    found = reader.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("start"), "value")
    # within a range the ids rise by one
    found = scratch(found.where(F.col("value").rlike(r"\S")).withColumn("row", F.monotonically_increasing_id()))
    ranges = found.groupBy("path", "start").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("path", "start", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return found.join(ranges, ["path", "start"]).select("path", "name", (F.col("row") + F.col("shift")).alias("t"), "value")


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """(entity, t, xs) of headerless text matrices, one file an entity, values parted by commas or blanks; a single column is an array of one."""
    entity = F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 1).alias("entity")
    cells = F.transform(F.split(F.trim("value"), r"\s*,\s*|\s+"), lambda v: finite(v.try_cast("double")))
    return lines(spark, path).select(entity, "t", cells.alias("xs"))


def _frames(entity: str, split: str, a: np.ndarray) -> pd.DataFrame:
    a = np.asarray(a, float)
    a = a.reshape(len(a), -1)
    return pd.DataFrame({"entity": entity, "split": split, "t": np.arange(len(a)), "xs": [[v if np.isfinite(v) else None for v in r] for r in a]})


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """(entity, split, t, xs) of .npz files with the keys train, test and label (split `label`); files without one of them are left out."""

    def load(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["name"], part["content"], strict=True):
                with np.load(io.BytesIO(content)) as z:
                    if {"train", "test", "label"} <= set(z.files):
                        for split in ("train", "test", "label"):
                            yield _frames(name, split, z[split])

    return _binary(spark, path, "*.npz").mapInPandas(load, FRAMES)


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(entity, split, t, xs) of {entity}_train.npy, {entity}_test.npy and {entity}_test_label.npy."""

    def load(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["name"], part["content"], strict=True):
                for end, split in (("_test_label", "label"), ("_train", "train"), ("_test", "test")):
                    if name.endswith(end):
                        yield _frames(name.removesuffix(end), split, np.load(io.BytesIO(content)))
                        break

    return _binary(spark, path, "*.npy").mapInPandas(load, FRAMES)


def _binary(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1).alias("name"), "content")


def write_series(frames: DataFrame, path: str) -> None:
    frames.write.partitionBy("entity", "split").mode("append").parquet(path)


def append_metrics(metrics: DataFrame, path: str) -> None:
    """One more CSV part with its header; read_metrics() reads all parts."""
    metrics.write.mode("append").option("header", True).csv(path)


def read_epoch_metrics(spark: SparkSession, path: str) -> DataFrame:
    """All *_seed{n}_epoch_metrics.csv below path, with entity and seed from the name; other files are passed over, none is an error."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*_epoch_metrics.csv").option("header", True).option("inferSchema", True).csv(path)
    name = r"^(.*)_seed(\d+)_epoch_metrics\.csv$"
    named = files.withColumn("entity", F.regexp_extract("_metadata.file_name", name, 1)).withColumn("seed", F.regexp_extract("_metadata.file_name", name, 2).try_cast("int"))
    named = named.where("seed is not null")
    if named.isEmpty():
        raise FileNotFoundError(f"no *_seed{{n}}_epoch_metrics.csv with rows below {path}")
    return named


def write_summary(table: DataFrame, path: str) -> None:
    """A result table, small by nature, as one CSV file with a header."""
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_run(path: str, **tables: DataFrame) -> None:
    """A run's tables (timeline, prior, scaler, ...), each partitioned by entity and, where it has one, seed."""
    for name, table in tables.items():
        table.write.partitionBy(*[c for c in ("entity", "seed") if c in table.columns]).mode("append").parquet(f"{path}/{name}")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, algorithm, t, y) of {dataset}_{algorithm}.gz files of one digit a line."""
    name = r"^(.*)_([^_]*)\.gz$"
    parts = [F.regexp_extract("name", name, i).alias(c) for i, c in ((1, "dataset"), (2, "algorithm"))]
    return lines(spark, path, "*.gz").select(*parts, "t", F.trim("value").cast("int").alias("y"))
