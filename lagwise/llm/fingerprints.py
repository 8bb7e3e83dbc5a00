"""Document fingerprints: bottom-k sketches of word shingles, with DataFrame functions only.

A sketch is the k smallest distinct 64-bit hashes of a text's shingles of five words (a shorter text is one shingle; a
text without words has an empty sketch), ascending. The sketch of a whole is the k smallest of its parts' sketches, so
sketches merge in any order and number of steps.

* Likeness (resemblance) of two: of the k smallest of both, the share that stands in both. Two empty sketches are
  alike (1.0), an empty one and another are not (0.0).
* Containment of the first in the second: the shared estimate |A n B| over the estimate |A|.
* Distinct shingles: exact below k, else (k - 1) over the share of the hash space below the largest hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, keyed, numbered, scratch, texts

SHINGLE = 5
K = 64


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def sketch_of(hashes: Column, shingle: int = SHINGLE, k: int = K) -> Column:
    """The sketch, given a column that holds word_hashes() (a column, lest it be computed for every shingle)."""
    last = F.size(hashes) - (shingle - 1)
    windows = F.transform(
        F.slice(hashes, 1, F.greatest(last, F.lit(0))), lambda h, i: F.xxhash64(h, *[F.get(hashes, i + j) for j in range(1, shingle)])
    )
    short = F.when(F.size(hashes) > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>"))
    return F.slice(F.sort_array(F.array_distinct(F.when(last > 0, windows).otherwise(short))), 1, k)


def with_sketch(df: DataFrame, text: str, name: str, shingle: int = SHINGLE, k: int = K) -> DataFrame:
    """df and the sketch of its column `text` as `name`."""
    return df.withColumn("_words", word_hashes(F.col(text))).withColumn(name, sketch_of(F.col("_words"), shingle, k)).drop("_words")


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    both = merged(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(both, a), b))
    return F.when(F.size(both) == 0, 1.0).otherwise(shared / F.greatest(F.size(both), F.lit(1)))


def distinct(sketch: Column, k: int = K) -> Column:
    """The estimated number of distinct shingles."""
    part = (F.element_at(sketch, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / part)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of a's shingles that b has too; 1.0 for an empty a."""
    shared = resemblance(a, b, k) * distinct(merged(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / F.greatest(distinct(a, k), F.lit(1.0))))


def written(sketch: Column) -> Column:
    """The sketch as one string of 16 hexadecimal digits a hash."""
    return F.lower(F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def merge_sketches(df: DataFrame, key: str, sketch: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for each key of the rows' sketches, in two steps so that a frequent key meets no single task whole."""
    salted = df.select(key, F.explode(sketch).alias("_h")).distinct()
    salted = salted.withColumn("_salt", F.pmod(F.col("_h"), F.lit(64)))
    best = lambda h: F.slice(F.array_sort(F.collect_set(h)), 1, k)
    ranked = salted.groupBy(key, "_salt").agg(best("_h").alias("_part"))
    return ranked.groupBy(key).agg(F.slice(F.array_sort(F.flatten(F.collect_list("_part"))), 1, k).alias(sketch))


def compare_with_next(df: DataFrame, shingle: int = SHINGLE, k: int = K) -> DataFrame:
    """Fingerprints of each document and of an edited one, and their likeness.

    The edited text is the text whose last floor(n_chars / 2) characters give way to as many first ones (or all) of the
    next document by doc_id; after the last comes the first. Rows that share a doc_id but not the text are documents of
    their own, next to each other; a document given twice gives equal rows and is not its own next one. A single document
    is. An empty table gives no rows.

    Only (key, length) are ordered to find neighbours. Texts are shuffled once, by key, with their sketches; each
    document then sends its first characters and its sketch to the one before it.
    """
    docs = keyed(texts(df)).withColumn("n", F.char_length("text"))
    ids = docs.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"))
    placed = numbered(ids, [], ["key"], "pos", total="docs")
    before = placed.select(
        F.pmod(F.col("pos") + 1, F.col("docs")).alias("pos"), F.col("key").alias("to"), F.col("doc_id").alias("to_id"), F.col("n").alias("to_n")
    )
    links = scratch(placed.select("pos", "key").join(before, "pos").select("key", "to", "to_id", "to_n"), "neighbours")

    docs = with_sketch(docs.select("key", "text", "n"), "text", "fp", shingle, k)
    # the first row of a key sends; a lag, since a limit by row number would be a shuffle apart
    first = docs.withColumn("_first", F.lag("n").over(Window.partitionBy("key").orderBy("n")).isNull()).where("_first").drop("_first")
    heads = first.join(links, "key").select(
        F.col("to").alias("key"),
        F.col("to_id").alias("doc_id"),
        F.expr("substring(text, 1, cast(to_n div 2 as int))").alias("head"),
        F.col("fp").alias("next_fp"),
    )
    both = docs.join(heads, "key").withColumn("edited", F.expr("concat(substring(text, 1, n - cast(n div 2 as int)), head)"))
    both = with_sketch(both.drop("text", "head"), "edited", "edited_fp", shingle, k)
    return both.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        written(F.col("fp")).alias("fingerprint"),
        written(F.col("edited_fp")).alias("edited_fingerprint"),
        resemblance(F.col("fp"), F.col("edited_fp"), k).alias("near_edited"),
        resemblance(F.col("fp"), F.col("next_fp"), k).alias("near_next"),
        containment(F.col("edited_fp"), F.col("fp"), k).alias("edited_in_text"),
        distinct(F.col("fp"), k).alias("n_shingles"),
    )
