"""Priors kept from run to run: only series that are new or have changed are computed."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..functions.frames import scratch
from ..operators.prior import fingerprints, to_compute


def _files(spark: SparkSession, path: str):
    """The file system of a path, and how it names paths."""
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return name(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), name


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All stored rows with their `run`. Folders of runs that have not ended begin with an underscore, which Spark's readers pass over."""
    fs, name = _files(spark, path)
    fs.mkdirs(name(path))
    columns = StructType(list(schema)).add("run", StringType())
    return spark.read.schema(columns).parquet(path)


def append(rows: DataFrame, path: str) -> str:
    """Adds rows as one run: written beside the store, then renamed in one step. A run that fails leaves nothing that is read."""
    spark = rows.sparkSession
    run = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    fs, name = _files(spark, path)
    fs.mkdirs(name(path))
    rows.write.parquet(f"{path}/_{run}")
    if not fs.rename(name(f"{path}/_{run}"), name(f"{path}/run={run}")):
        raise OSError(f"could not rename {path}/_{run}")
    return run


def reuse(path: str, cells: DataFrame, by: list[str], parameters: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The priors of all series in cells, with their key and whether they were `reused`.

    A series' key changes with its cells and with the parameters. compute() gets the cells of the series whose key is not
    in the store and returns their priors with the columns `by`; they are appended before the store is read. If two runs at
    a time stored the same key, the earlier one's rows count. Keys name whole priors, so nothing is ever overwritten.
    Without cells the result is empty.
    """
    spark = cells.sparkSession
    keys = scratch(fingerprints(cells, by, parameters))
    schema = StructType([*compute(cells).schema, keys.schema["key"]])
    stored = read(spark, path, schema)
    missing = scratch(to_compute(keys, stored.select(*by, "key").distinct(), by))
    run = ""
    if not missing.isEmpty():
        fresh = compute(cells.join(missing.select(*by), by, "left_semi"))
        run = append(fresh.join(missing, by).select(*schema.names), path)
    wanted = read(spark, path, schema).join(keys, [*by, "key"], "left_semi")
    first = wanted.groupBy(*by, "key").agg(F.min("run").alias("run"))
    return wanted.join(first, [*by, "key", "run"]).withColumn("reused", F.col("run") != run).drop("run")
