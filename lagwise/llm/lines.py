r"""Line dedup by overlapping windows of three lines.

A text's lines are what stands between its \n. Three consecutive lines, of which one at least is not blank, form a
window; windows equal line by line repeat, in one document or in several. The first occurrence (smallest doc_id, then
first line) stays; of every later one all three lines go, and overlapping windows merge into one stretch.

A null text stays null with 0 lines; a text of fewer than three lines, an empty one included, stays as it is. Rows
without a doc_id stay as they are, too. Of equal windows the first is an aggregate, and what is no document's first goes:
no row meets the others of its window, so a window that a third of all documents hold is nobody's burden. No rows: none.
Windows are compared by two 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _places(lines: Column, window: int) -> Column:
    """(place, h, g) of each window that is not blank, place being its first line, from 0."""
    marks = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("g"), (F.trim(x) == "").alias("blank")))

    def one(i: Column, of: Column) -> Column:
        at = [F.get(of, i + k) for k in range(window)]
        blank = F.lit(True)
        for a in at:
            blank = blank & a["blank"]
        return F.struct(i.alias("place"), F.xxhash64(*[a["h"] for a in at]).alias("h"), F.xxhash64(*[a["g"] for a in at]).alias("g"), blank.alias("blank"))

    # an array of one array, so that the marks are a variable, computed once
    found = F.transform(F.array(marks), lambda m: F.transform(F.sequence(F.lit(0), F.size(m) - window), lambda i: one(i, m)))
    found = F.filter(F.get(found, F.lit(0)), lambda w: ~w["blank"])
    return F.when(F.size(lines) >= window, found).otherwise(F.expr("cast(array() as array<struct<place:int,h:bigint,g:bigint,blank:boolean>>)"))


def firsts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, places): where windows start of which that is the first occurrence, from (key, text)."""
    each = docs.select("key", F.explode(_places(_lines(F.col("text")), window)).alias("w"))
    # key and place in one number: its minimum is a hash aggregate, that of a struct would sort all windows
    spots = each.select("w.h", "w.g", F.expr("cast(key as decimal(20,0)) * 2147483648 + w.place").alias("spot"))
    first = spots.groupBy("h", "g").agg(F.min("spot").alias("spot")).withColumn("place", F.expr("pmod(spot, 2147483648)"))
    first = first.select(F.expr("cast((spot - place) / 2147483648 as bigint)").alias("key"), F.col("place").cast("int").alias("place"))
    return first.groupBy("key").agg(F.collect_list("place").alias("places"))


def dedup_lines(df: DataFrame, window: int = WINDOW) -> DataFrame:
    """df with its texts deduplicated, and n_lines and n_removed, all rows and other columns kept.

    n_chars, where df has it, follows the text. Columns of df named n_lines or n_removed are replaced.
    """
    columns = [c for c in df.columns if c not in ("n_lines", "n_removed")]
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    docs = df.select(row, F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = docs.where("doc_id is not null and text is not null")
    with_key = keyed(known)
    kept = firsts(with_key, window)
    rest = docs.where("doc_id is null or text is null").select("row", "text", F.lit(None).cast("bigint").alias("key"))
    both = with_key.select("row", "text", "key").join(kept, "key", "left").select("row", "text", "key", "places")
    both = both.unionByName(rest.withColumn("places", F.lit(None).cast("array<int>")))
    both = both.withColumn("lines", _lines(F.col("text")))
    starts = F.transform(_places(F.col("lines"), window), lambda w: w["place"])
    gone = F.array_except(starts, F.coalesce("places", F.array().cast("array<int>")))
    both = both.withColumn("gone", F.when(F.col("key").isNull(), F.array().cast("array<int>")).otherwise(gone))
    covered = F.array_distinct(F.flatten(F.transform("gone", lambda p: F.sequence(p, p + window - 1))))
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    stay = F.when(F.size("gone") > 0, F.array_except(every, covered))
    both = both.withColumn("stay", stay)
    text = F.when(F.col("stay").isNull(), F.col("text")).otherwise(F.array_join(F.transform("stay", lambda i: F.get(F.col("lines"), i)), "\n"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines"))
    removed = F.when(F.col("stay").isNull(), 0).otherwise(F.size("lines") - F.size("stay"))
    both = both.select("row", text.alias("text"), n.cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"))
    shown = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return both.select(*[shown.get(c, F.col("row").getField(c)).alias(c) for c in columns], "n_lines", "n_removed")


ORACLE = """
with l as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i
  from documents where doc_id is not null and text is not null
), w as (
  select doc_id, i, line, lead(line, 1) over d as b, lead(line, 2) over d as c
  from l window d as (partition by doc_id order by i)
), n as (
  select doc_id, i, row_number() over (partition by line, b, c order by doc_id, i) as k
  from w where c is not null and not (trim(line) = '' and trim(b) = '' and trim(c) = '')
), gone as (
  select distinct doc_id, i + x as i from n, (values (0), (1), (2)) as o(x) where k > 1
), kept as (
  select l.doc_id, count(*) as n_lines, count(g.i) as n_removed,
         coalesce(string_agg(line, chr(10) order by l.i) filter (where g.i is null), '') as text
  from l left join gone g on l.doc_id = g.doc_id and l.i = g.i group by l.doc_id
)
select d.doc_id, k.text, coalesce(k.n_lines, 0)::bigint as n_lines, coalesce(k.n_removed, 0)::bigint as n_removed
from documents d left join kept k on d.doc_id = k.doc_id where d.doc_id is not null
"""
