"""SQL over DataFrames by name."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: A query, or several by name, in order: each may read those before it, the last is the result.
Query = str | dict[str, str]


def each(query: Query, f: Callable[[str], str]) -> Query:
    """The query, or each of several, through f."""
    return f(query) if isinstance(query, str) else {name: f(text) for name, text in query.items()}


def sql(query: Query, **frames: DataFrame) -> DataFrame:
    """The query's rows; {name} in it stands for a DataFrame, or for the rows of a query before it.

    Queries by name are DataFrames of their own: nested WITH lists, as they are when one operator's result enters the
    next, take the optimizer minutes.
    """
    spark = next(iter(frames.values())).sparkSession
    frames = dict(frames)
    frame = None
    for name, text in ({"result": query} if isinstance(query, str) else query).items():
        frame = spark.sql(text, **{k: v for k, v in frames.items() if f"{{{k}}}" in text})
        frames[name] = frame
    return frame


def shared(spark: SparkSession) -> str:
    """The folder spark.checkpoint.dir, which the driver and all executors share; in local mode one of its own where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"{tempfile.gettempdir()}/lagwise-{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: cuts the lineage, so that many readers cost one run."""
    spark = df.sparkSession
    path = f"{shared(spark)}/series-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def listed(keys: list[str], prefix: str = "") -> str:
    return ", ".join(f"{prefix}{k}" for k in keys)


def same(keys: list[str], a: str, b: str) -> str:
    """Join condition of equal keys."""
    return " and ".join(f"{a}.{k} = {b}.{k}" for k in keys) or "true"
