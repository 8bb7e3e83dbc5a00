"""Substring dedup: repeated word windows, found level by level at doubled lengths.

A window can repeat only if what it contains repeats. The levels are the window's length halved again and again (20: 5
and 10 before it). At each one a document offers, of the runs of that length within each window, the one with the least
hash: equal windows choose equal runs at equal places, so none is missed, and few runs are shuffled. What occurs once,
alone, is out; windows whose run repeats go on to twice the length, until the window's own. passages() doubles on from
there until no candidate survives.

No row is joined with the others of its run or window, which a third of all documents may hold: a run's first place is
an aggregate that is summed before the shuffle; runs that occur in one document only are told to that document, and of
windows the first occurrence (smallest doc_id, then earliest start) is told to its document. A document knows its own
windows; all of them go that are no first ones, with each word that they cover. Removal needs the window's length only:
a longer repeat consists of repeated windows.

A text that equals one of a smaller doc_id has no first occurrence; it is found by the hash of the whole text and takes
no part in the levels, so that groups of exact copies cost one text's windows.
A text without words, an empty or a null one has nothing to remove; one shorter than a window keeps all. Rows of equal
doc_id and text are one document and give equal rows; rows of equal doc_id with different texts are documents of their
own, in the order of their hashes. No rows: none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, keyed, scratch, texts

WINDOW = 20
#: Words of the shortest runs of the first level, at least.
SHORTEST = 4
#: Bytes of text whose words are held at once, but for longer texts.
PART = 1 << 18
#: Bytes of the longest words that are hashed eight bytes at a time.
LONG = 64
#: Which bytes separate words: blank and \x09-\x0D; and by n the mask of a number's first n bytes.
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end in the bytes of texts that stand one behind the other; no word goes over a text's end."""
    blank = np.ones(len(data) + 2, bool)
    blank[1:-1] = BLANK[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    starts = np.flatnonzero(~blank[1:-1] & (blank[:-2] | border[:-1]))
    return starts, np.flatnonzero(~blank[1:-1] & (blank[2:] | border[1:])) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's length and bytes, eight at a time; of longer words than LONG bytes XXH64."""
    size = ends - starts
    eight = np.ndarray(len(data) + 1, "<u8", np.concatenate((data, np.zeros(8, np.uint8))).data, strides=(1,))
    out = mix(size.astype(np.uint64), eight[starts] & FIRST[np.minimum(size, 8)])
    at = np.flatnonzero((size > 8) & (size <= LONG))
    for k in range(8, LONG, 8):
        out[at] = mix(out[at], eight[starts[at] + k] & FIRST[np.minimum(size[at] - k, 8)])
        at = at[size[at] > k + 8]
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]])
    return out


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(0xD6E8FEB86659FD93))
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(29)


def run_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """The hash of each run of `length` words: halves are joined, an odd word is added."""
    if len(h) < length:
        return h[:0]
    if length == 1:
        return h
    half = run_hashes(h, length // 2)
    n = len(h) - length + 1
    out = mix(half[:n], half[length // 2 : length // 2 + n])
    return mix(out, h[length - 1 :]) if length % 2 else out


def chosen(runs: np.ndarray, width: int) -> np.ndarray:
    """For each `width` neighbouring runs the place of the least, the first of equals."""
    best, at, w = runs, np.arange(len(runs)), 1
    while w < width:
        step = min(w, width - w)
        left, right = slice(0, len(best) - step), slice(step, len(best))
        smaller = best[right] < best[left]
        best, at, w = np.where(smaller, best[right], best[left]), np.where(smaller, at[right], at[left]), w + step
    return at


def _parts(batch: pa.RecordBatch, window: int) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Runs of neighbouring rows with PART bytes of text at most (or one row), and their words."""
    texts_ = batch.column("text").cast(pa.large_binary())
    offsets = np.frombuffer(texts_.buffers()[1], np.int64)[texts_.offset : texts_.offset + len(texts_) + 1] if len(texts_) else np.zeros(1, np.int64)
    data = np.frombuffer(texts_.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts_):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PART, side="right")) - 1)
        yield batch.slice(at, end - at), Words(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], window)
        at = end


def _mapped(df: DataFrame, schema: str, window: int, of: Callable[[pa.RecordBatch, Words], tuple[np.ndarray, ...]]) -> DataFrame:
    """Rows of `schema`, key first, from each part of df: `of` gives each row's document in the part, and one array a further column."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, w in _parts(batch, window):
                row, *columns = of(part, w)
                columns = [part.column("key").to_numpy()[row], *columns]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return df.mapInArrow(run, schema)


def levels(window: int) -> list[int]:
    """The lengths before the window's own."""
    out = []
    while window // 2 >= SHORTEST:
        out.insert(0, window := window // 2)
    return out


class Words:
    """The words of neighbouring documents by their hashes, and what the levels passed so far leave of their windows.

    Places are counted through all of these documents; `first` has each one's first place, and the end.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int) -> None:
        self.data, self.offsets, self.window = data, offsets, window
        self.starts, self.ends = bounds(data, offsets)
        self.hashes = word_hashes(data, self.starts, self.ends)
        self.first = np.searchsorted(self.starts, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        n = max(len(self.hashes) - window + 1, 0)
        self.alive = self.doc[:n] == self.doc[len(self.doc) - n :]

    def marked(self, places: pa.ListArray) -> np.ndarray:
        """Which words stand at their document's `places`."""
        out = np.zeros(len(self.hashes), bool)
        out[self.first[pc.list_parent_indices(places).to_numpy()] + pc.list_flatten(places).to_numpy()] = True
        return out

    def own(self, at: np.ndarray) -> np.ndarray:
        """Places within the document."""
        return at - self.first[self.doc[at]]

    def runs(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows alive: each one's chosen run's place; and of each document's different runs hash, first place and number."""
        if not self.alive.any():
            none = np.zeros(0, np.int64)
            return none, none.astype(np.uint64), none, none
        every = run_hashes(self.hashes, length)
        mine = chosen(every, self.window - length + 1)[self.alive]
        places = np.zeros(len(every), bool)
        places[mine] = True
        places = np.flatnonzero(places)
        places, new = _firsts(places, self.doc[places], every[places])
        at = np.flatnonzero(new)
        return mine, every[places[at]], places[at], np.diff(at, append=len(places))

    def pass_level(self, length: int, alone: np.ndarray) -> None:
        """Windows whose run occurs once, here and anywhere, are out; alone: marks first places of runs of their document only."""
        mine, _, first, number = self.runs(length)
        out = np.zeros(len(self.hashes), bool)
        out[first] = alone[first] & (number == 1)
        self.alive[self.alive] = ~out[mine]

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows alive: places and two hashes."""
        at, half = np.flatnonzero(self.alive), self.window // 2
        if not len(at):
            return at, at, at
        runs = run_hashes(self.hashes, half)
        a, b = runs[at], runs[at + half]
        h = mix(a, b)
        if self.window % 2:
            h = mix(h, self.hashes[at + self.window - 1])
        # a second hash, of the halves in turn: two different windows hardly share both
        return at, h.view(np.int64), (mix(b, a) >> np.uint64(33)).astype(np.int64)

    def own_first(self) -> np.ndarray:
        """Which of windows() do not start earlier in their document."""
        at, h, g = self.windows()
        first = np.zeros(len(at), bool)
        order, new = _firsts(np.arange(len(at)), self.doc[at], h, g)
        first[order[new]] = True
        return first


def _firsts(places: np.ndarray, *by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places by what `by` says of them, equals in their order; and which of them are the first of equals."""
    order = np.lexsort(by[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([x[order[1:]] != x[order[:-1]] for x in by], axis=0)
    return places[order], new


def _found(part: pa.RecordBatch, length: int) -> tuple[pa.ListArray, np.ndarray]:
    """The places that a level found alone, and the documents that have no other run there."""
    places, n = part.column(f"alone{length}").flatten()
    return places, pc.fill_null(pc.equal(pc.list_value_length(places), n), False).to_numpy(zero_copy_only=False)


def _at_level(part: pa.RecordBatch, w: Words, passed: list[int]) -> Words:
    for length in passed:
        w.pass_level(length, w.marked(_found(part, length)[0]))
    return w


def alone(docs: DataFrame, window: int, passed: list[int], length: int) -> DataFrame:
    """(key, alone<length>: (places, n)): where runs of this document only start first, and how many runs it chose.

    n is larger than there are places if a run repeats within the document.
    """

    def of(part: pa.RecordBatch, w: Words) -> tuple[np.ndarray, ...]:
        _, values, first, number = _at_level(part, w, passed).runs(length)
        doc = w.doc[first]
        n = np.bincount(doc, minlength=part.num_rows) + (np.bincount(doc, number > 1, part.num_rows) > 0)
        return doc, w.own(first), values.view(np.int64), n[doc]

    runs = _mapped(docs, "key long, place int, run long, n int", window, of)
    once = runs.groupBy("run").agg(F.min("key").alias("key"), F.max("key").alias("last"), F.min("place").alias("place"), F.min("n").alias("n"))
    # rows of one document given twice have its key both
    once = once.where("key = last").groupBy("key").agg(F.collect_list("place").alias("places"), F.min("n").alias("n"))
    return once.select("key", F.struct("places", "n").alias(f"alone{length}"))


def first_places(docs: DataFrame, window: int, passed: list[int]) -> DataFrame:
    """(key, firsts): where windows start of which that is the first occurrence anywhere."""

    def of(part: pa.RecordBatch, w: Words) -> tuple[np.ndarray, ...]:
        first = _at_level(part, w, passed).own_first()
        at, h, g = (x[first] for x in w.windows())
        return w.doc[at], w.own(at), h, g

    found = _mapped(docs, "key long, place int, h long, g int", window, of)
    # a document has a window once here, so the place of the smallest key is the first one
    first = found.groupBy("h", "g").agg(F.min("key").alias("key"), F.min_by("place", "key").alias("place"))
    return first.groupBy("key").agg(F.collect_list("place").alias("firsts"))


def heads(docs: DataFrame) -> DataFrame:
    """(key, head): of equal texts, by two 64-bit hashes, the smallest key."""
    marks = docs.select("key", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"))
    return marks.groupBy("h", "g").agg(F.min("key").alias("key")).select("key", F.lit(True).alias("head"))


def survivors(docs: DataFrame, window: int) -> tuple[DataFrame, list[int]]:
    """docs (key, text, head ...) with what each level found alone, and the levels."""
    passed: list[int] = []
    for length in levels(window):
        docs = docs.join(alone(_open(docs, passed), window, passed, length), "key", "left")
        passed.append(length)
    return docs, passed


def _open(docs: DataFrame, passed: list[int]) -> DataFrame:
    """Documents of which a run of the last level is not alone, or that have none."""
    open_ = docs.where("head")
    for length in passed:
        open_ = open_.where(f"alone{length} is null or size(alone{length}.places) < alone{length}.n")
    return open_


def repeats(df: DataFrame, window: int = WINDOW) -> tuple[DataFrame, list[int]]:
    """(doc_id, text, head, what the levels found, firsts) of every document, and the levels."""
    docs = keyed(texts(df))
    docs = docs.join(scratch(heads(docs), "heads"), "key", "left")
    # the texts' shuffle by key serves every level
    docs, passed = survivors(docs, window)
    return docs.join(first_places(_open(docs, passed), window, passed), "key", "left"), passed


def kept(part: pa.RecordBatch, w: Words, passed: list[int]) -> np.ndarray:
    """Which words stay."""
    head = pc.fill_null(part.column("head"), False).to_numpy(zero_copy_only=False)
    done = ~head
    for length in passed:
        done |= _found(part, length)[1]
    w.alive &= ~done[w.doc[: len(w.alive)]]
    at = np.flatnonzero(_at_level(part, w, passed).alive)
    at = at[~(w.own_first() & w.marked(part.column("firsts"))[at])]
    edge = np.zeros(len(w.hashes) + 1, np.int64)
    edge[at] += 1
    edge[at + w.window] -= 1
    # a later copy of a text keeps what is too short for a window
    return (edge.cumsum()[:-1] == 0) & (head | (np.diff(w.first) < w.window))[w.doc]


def joined(w: Words, stays: np.ndarray) -> list[memoryview]:
    """Each document's words that stay, joined by one blank."""
    at = np.flatnonzero(stays)
    # a word that another one of its document follows takes the blank behind it along
    inner = at[:-1][w.doc[at[:-1]] == w.doc[at[1:]]] if len(at) else at
    data, edge = w.data.copy(), np.zeros(len(w.data) + 1, np.int8)
    data[w.ends[inner]] = 0x20
    edge[w.starts[at]] += 1
    edge[w.ends[at]] -= 1
    taken = edge[:-1].cumsum(dtype=np.int8).view(bool)
    taken[w.ends[inner]] = True
    ends = np.concatenate(([0], taken.cumsum()))[w.offsets].tolist()
    out = memoryview(data[taken])
    return [out[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def dedup_words(df: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, text): the words that stay, joined by one blank."""
    return _removed(df, window, lambda b: str(b, "utf-8", "surrogatepass"), "text")


def digests(df: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of what dedup_words() keeps."""
    return _removed(df, window, lambda b: hashlib.sha256(b).hexdigest(), "kept_sha256")


def _removed(df: DataFrame, window: int, show: Callable[[memoryview], str], name: str) -> DataFrame:
    docs, passed = repeats(df, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, w in _parts(batch, window):
                stays = kept(part, w, passed)
                every = np.diff(w.first)
                gone = np.bincount(w.doc[~stays], minlength=part.num_rows)
                out = [show(b) for b in joined(w, stays)]
                arrays = [part.column("doc_id"), pa.array(every, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", name])

    return docs.drop("key").mapInArrow(run, f"doc_id long, n_words long, n_removed long, {name} string")


def passages(df: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, place, length): at each level, window, twice it and so on, the windows that occur more than once.

    A level's windows are the next one's candidates; it ends when none is left, whatever the length.
    """
    docs = keyed(texts(df)).withColumn("head", F.lit(True))
    state, passed = survivors(docs, window)

    def of(part: pa.RecordBatch, w: Words) -> tuple[np.ndarray, ...]:
        at, h, g = _at_level(part, w, passed).windows()
        return w.doc[at], w.own(at), h, g

    found = _mapped(_open(state, passed), "key long, place int, h long, g int", window, of)
    out, length = None, window
    while True:
        once = found.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key"), F.min("place").alias("place")).where("n = 1")
        level = scratch(found.select("key", "place").join(once.select("key", "place"), ["key", "place"], "left_anti").distinct(), "level")
        if level.isEmpty():
            drop(level)
            break
        level = level.withColumn("length", F.lit(length))
        out = level if out is None else out.union(level)
        length *= 2
        both = docs.join(level.groupBy("key").agg(F.collect_list("place").alias("places")), "key")
        found = _mapped(both, "key long, place int, h long, g int", length, _extended(length))
    if out is None:
        return docs.where("false").select("doc_id", F.lit(0).alias("place"), F.lit(0).alias("length"))
    return out.join(docs.select("key", "doc_id").distinct(), "key").select("doc_id", "place", "length")


def _extended(length: int) -> Callable[[pa.RecordBatch, Words], tuple[np.ndarray, ...]]:
    """Windows of `length` words both of whose halves start at the document's `places`."""
    half = length // 2

    def of(part: pa.RecordBatch, w: Words) -> tuple[np.ndarray, ...]:
        starts = w.marked(part.column("places"))
        n = len(w.alive)
        w.alive &= starts[:n] & starts[half : half + n]
        at, h, g = w.windows()
        return w.doc[at], w.own(at), h, g

    return of


#: The rows of digests() in DuckDB.
ORACLE = r"""
with t as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents where doc_id is not null
), w as (
  select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as i from t
), v as (
  select doc_id, i, string_agg(word, ' ') over f as words, count(*) over f as n from w
  window f as (partition by doc_id order by i rows between current row and 19 following)
), s as (
  select doc_id, i, row_number() over (partition by words order by doc_id, i) as k from v where n = 20
), gone as (
  select distinct doc_id, i + o.x as i from s, range(20) as o(x) where k > 1
), kept as (
  select w.doc_id, count(*) as n, count(g.i) as gone, string_agg(word, ' ' order by w.i) filter (where g.i is null) as text
  from w left join gone g on w.doc_id = g.doc_id and w.i = g.i group by w.doc_id
)
select t.doc_id, coalesce(n, 0)::bigint as n_words, coalesce(gone, 0)::bigint as n_removed, sha256(coalesce(text, '')) as kept_sha256
from t left join kept on t.doc_id = kept.doc_id
"""
