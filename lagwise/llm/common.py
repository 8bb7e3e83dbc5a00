"""What the corpus operators share: reading, scratch tables, distributed numbering.

Conventions of every operator in this subpackage

* `doc_id` is a document's key. A row without one is no document and is left out; an operator says so
  where it does otherwise. Rows that share a doc_id are documents of their own, in the order of their texts'
  hashes; if their texts are equal as well, they are one document given twice, and give equal rows.
* A null text is an empty text.
* Only the columns that an operator names are read, so further columns, whatever they are called, do not matter.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The class of ASCII white space that separates words: blank and \x09-\x0D (what bytes.split() takes).
SPACE = r"[\x20\x09-\x0D]+"


#: What this process, a worker, remembers between tasks: by operator how to give it up.
_KEPT: dict[str, Callable[[], object]] = {}
#: The operator that it works for.
_AT: str | None = None


def keeps(operator: str, give_up: Callable[[], object]) -> None:
    _KEPT[operator] = give_up


def turn_to(operator: str) -> None:
    """A worker that turns to another operator gives up what it remembers of the others, and what it holds free."""
    global _AT
    for other in [k for k in _KEPT if k != operator]:
        _KEPT.pop(other)()
    if _AT != operator:
        _AT = operator
        release()


def release() -> None:
    """Gives memory that is free in this process back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # the GNU library's allocator keeps it otherwise
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most so many: what is made of a batch's texts lies beside them, in the worker and in the executor."""
    for batch in batches:
        for at in range(0, max(batch.num_rows, 1), rows):
            yield batch.slice(at, rows)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(df: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the columns named; rows without a doc_id are left out."""
    return df.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *more
    )


def keyed(docs: DataFrame) -> DataFrame:
    """Adds `key`, which differs between documents (doc_id and text) and has the order of doc_id: doc_id itself if it will do.

    docs has doc_id and text, no nulls. Where a doc_id stands for several texts, documents are numbered by range instead.
    """
    ids = scratch(docs.select("doc_id", F.xxhash64("text").alias("h")), "ids")
    if ids.groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").isEmpty():
        return docs.withColumn("key", F.col("doc_id"))
    numbers = scratch(numbered(ids.distinct(), [], ["doc_id", "h"], "key"), "keys")
    return docs.withColumn("h", F.xxhash64("text")).join(numbers, ["doc_id", "h"]).drop("h")


#: Keys that join_back() broadcasts at most; and rows of a key that are no burden to a task.
FREQUENT, BEARABLE = 20_000, 100_000


def few(number: int) -> bool:
    """Whether so few rows cannot hold a key that is a burden."""
    return number <= BEARABLE


def join_back(rows: DataFrame, totals: DataFrame, key: str, count: str, number: int) -> DataFrame:
    """rows (`number` of them) joined to the one row that totals has for a key, with `count`, the key's number of rows.

    Only FREQUENT keys can have more than number / FREQUENT rows: their totals are broadcast, so that a key never meets
    its rows in one task. All other keys are shuffled.
    """
    if few(number):
        return rows.join(totals, key)
    limit = max(number // FREQUENT, BEARABLE)
    often = F.broadcast(totals.where(F.col(count) > limit))
    rest = rows.join(often.select(key), key, "left_anti").join(totals.where(F.col(count) <= limit), key)
    return rows.join(often, key).unionByName(rest)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for tables between jobs: spark.checkpoint.dir; if that is unset, one of our own, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"{tempfile.gettempdir()}/lagwise-{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows as a Parquet table in the shared folder: it survives lost executors and cuts the lineage.

    Tables are small beside the texts. drop() deletes those that nothing reads any more; the others, which the result
    reads, go when the folder is cleared.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])).parquet(path)
    out._scratch = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Deletes scratch tables whose readers' results are all written."""
    for t in tables:
        if path := getattr(t, "_scratch", None):
            at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, group: list[str], order: list[str], name: str, total: str | None = None) -> DataFrame:
    """Adds `name`: a row's place, gapless from 0, within its group, by `order`; and `total`, if named: the group's size.

    One range shuffle orders the rows; each range's count a group gives the offsets of the next ranges, so no
    task holds a whole group. The ordered rows are a scratch table, hence keep df narrow. Ties take any order.
    """
    spark = df.sparkSession
    keys = [*group, *order]
    at = (
        df.repartitionByRange(partitions(spark), *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    at = scratch(at.withColumn("_part", F.shiftright("_at", 33)), name)
    counts = at.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    # the table of counts has a row for each range and group that meet: at most ranges + groups
    before = "coalesce(sum(_n) over (partition by {g} order by _part rows between unbounded preceding and 1 preceding), 0)"
    g = ", ".join(f"`{x}`" for x in group) or "0"
    counts = counts.withColumn("_base", F.expr(before.format(g=g)))
    if total:
        counts = counts.withColumn(total, F.expr(f"sum(_n) over (partition by {g})"))
    counts = counts.withColumnsRenamed({x: f"_g_{x}" for x in ["_part", *group]})
    same = F.col("_part") == F.col("_g__part")
    for x in group:
        same = same & F.col(x).eqNullSafe(F.col(f"_g_{x}"))
    out = at.join(counts, same)
    return out.withColumn(name, F.col("_at") - F.col("_first") + F.col("_base")).select(
        *df.columns, name, *([total] if total else [])
    )


def add64(a: Column, b: Column) -> Column:
    """a + b modulo 2^64 on bigints: the carry passes between 32-bit halves, so nothing overflows under ANSI mode."""
    low = F.lit(0xFFFFFFFF)
    lo = a.bitwiseAND(low) + b.bitwiseAND(low)
    hi = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(lo, 32)
    return F.shiftleft(hi, 32).bitwiseOR(lo.bitwiseAND(low))


def mul64(a: Column, m: int) -> Column:
    """a * m modulo 2^64 on bigints, by limbs of 22 bits whose products stay below 2^46."""
    low = F.lit((1 << 22) - 1)
    a0, a1, a2 = a.bitwiseAND(low), F.shiftrightunsigned(a, 22).bitwiseAND(low), F.shiftrightunsigned(a, 44)
    m0, m1, m2 = (F.lit(x) for x in (m & (1 << 22) - 1, m >> 22 & (1 << 22) - 1, m >> 44 & (1 << 20) - 1))
    low_part = add64(a0 * m0, F.shiftleft(a0 * m1 + a1 * m0, 22))
    return add64(low_part, F.shiftleft(a0 * m2 + a1 * m1 + a2 * m0, 44))
