"""Phrase collocation mining by vertically partitioned suffix trees, truncated in depth.

Every occurrence of a word starts a suffix, cut after DEPTH words or at the end of its piece. Suffixes are dealt out by a
prefix: the first word, lengthened as long as all its words are heavy, i.e. occur more often than the memory budget
allows. A prefix therefore ends in a word that is not heavy and holds at most `budget` suffixes; prefixes are dealt to
groups of about that size. One task reads a group's suffixes, sorts them and so has the leaves of its subtrees in order:
an inner node is a run of leaves with a common beginning, its count the total of the run. Only nodes above a prefix (all
words heavy) have their runs in several groups; their totals are added up.

What is known to every task is bounded: the heavy words (at most HEAVY), and a Bloom filter of fixed size of the words
that occur often enough for a phrase. A suffix ends before a word that the filter rejects, for no phrase with it is a
candidate; a word let through by mistake costs memory, and no wrong count.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, scratch

#: Words of the longest phrase: the depth of the trees.
DEPTH = 5
#: Occurrences that make a candidate; and rows of the result for a language.
LEAST, TOP = 100, 2000
#: Suffixes of a prefix, and about of a group; and the largest number of heavy words.
BUDGET, HEAVY = 1 << 20, 1 << 16
#: Bits of the filter, in buckets as Spark's bitmap functions make them.
FILTER, BUCKET = 1 << 24, 1 << 15
#: Suffixes that a task sorts at a time; and words that it remembers.
TOGETHER, REMEMBERED = 1 << 21, 1 << 19
#: Bytes that end a piece become one that no UTF-8 text has, as a word of its own.
_END = b"\xff"
_BREAKS = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d", _END * 10)


def words(text: str) -> list[bytes]:
    """The words, A-Z in lower case, with _END between pieces."""
    data = text.encode("utf-8", "surrogatepass").lower().translate(_BREAKS)
    return data.replace(_END, b" \xff ").split()


def _key(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, xxhash.xxh32_intdigest(lang.encode("utf-8", "surrogatepass")))


def _by_lang(batch: pa.RecordBatch) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
        out.setdefault(lang, []).append(text.as_py())
    return out


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, h, f) of each language's words, of which h is a hash."""

    def rows(counts: dict[str, Counter]) -> pa.RecordBatch:
        found = [(lang, w.decode("utf-8", "surrogatepass"), np.uint64(_key(lang, w)).astype(np.int64), n) for lang, c in counts.items() for w, n in c.items()]
        columns = list(zip(*found, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["lang", "word", "h", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, some in _by_lang(batch).items():
                c = counts.setdefault(lang, Counter())
                for text in some:
                    c.update(words(text))
                c.pop(_END, None)
            if sum(map(len, counts.values())) > REMEMBERED:
                yield rows(counts)
                counts = {}
        yield rows(counts)

    found = texts(docs).mapInArrow(run, "lang string, word string, h long, f long")
    return found.groupBy("lang", "word").agg(F.min("h").alias("h"), F.sum("f").alias("f"))


def _filter(frequent: DataFrame) -> np.ndarray:
    """The Bloom filter of the hashes h: three places of each, counted from 1 as Spark's bitmaps do."""
    place = lambda by: F.shiftrightunsigned("h", by).bitwiseAND(F.lit(FILTER - 1)) + 1
    places = frequent.select(F.explode(F.array(place(0), place(24), place(40))).alias("at"))
    parts = places.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    bits = np.zeros((FILTER // BUCKET, BUCKET // 8), np.uint8)
    for r in parts.collect():  # FILTER / 8 bytes at most
        data = np.frombuffer(bytes(r["bits"]), np.uint8)
        bits[r["bucket"] - 1, : len(data)] = data
    return bits.ravel()


class Ids(dict):
    """Numbers of a language's words from 1, by first use; 0 for the end of a piece and for words that the filter rejects."""

    def __init__(self, lang: str, bits: np.ndarray, heavy: set[bytes]) -> None:
        super().__init__({_END: 0})
        self.lang, self.bits, self.heavy = lang, bits, heavy
        self.words: list[bytes] = [b""]
        self.keys_: list[int] = [0]
        self.is_heavy: list[bool] = [False]

    def passes(self, h: int) -> bool:
        places = (h >> by & FILTER - 1 for by in (0, 24, 40))
        return all(self.bits[i >> 3] >> (i & 7) & 1 for i in places)

    def __missing__(self, word: bytes) -> int:
        h = _key(self.lang, word)
        n = 0
        if self.passes(h):
            n = len(self.words)
            self.words.append(word)
            self.keys_.append(h)
            self.is_heavy.append(word in self.heavy)
        self[word] = n
        return n


def suffixes(ids: np.ndarray) -> np.ndarray:
    """Rows of DEPTH ids for each place where two words follow each other, 0 behind an end; ids end with a 0."""
    padded = np.concatenate((ids, np.zeros(DEPTH, ids.dtype)))
    at = np.flatnonzero((padded[:-1] > 0) & (padded[1:] > 0))
    out = np.stack([padded[at + k] for k in range(DEPTH)], axis=1)
    for k in range(2, DEPTH):
        out[out[:, k - 1] == 0, k] = 0
    return out


def counted(rows: np.ndarray, counts: np.ndarray, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Different rows in order (of `first`, then of the row), and their total counts."""
    keys = [rows[:, k] for k in range(DEPTH - 1, -1, -1)] + ([] if first is None else [first])
    order = np.lexsort(keys)
    rows = rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    starts = np.flatnonzero(new)
    totals = np.add.reduceat(counts[order], starts) if len(starts) else counts[:0]
    return rows[starts], totals, None if first is None else first[order][starts]


def prefix_groups(rows: np.ndarray, keys: np.ndarray, heavy: np.ndarray, groups: int) -> np.ndarray:
    """The group of each suffix's prefix: its words up to the first that is not heavy."""
    h = keys[rows[:, 0]]
    on = heavy[rows[:, 0]]
    for k in range(1, DEPTH):
        on = on & (rows[:, k] > 0)
        h = np.where(on, (h ^ h >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + keys[rows[:, k]], h)
        on = on & heavy[rows[:, k]]
    return ((h ^ h >> np.uint64(31)) % np.uint64(groups)).astype(np.int64)


def _pack(rows: np.ndarray, counts: np.ndarray, names: list[bytes]) -> tuple[bytes, bytes]:
    """A group's rows in one piece: the words they use (each ended by a blank), and columns of their numbers in that list."""
    used, local = np.unique(rows, return_inverse=True)
    local = local.reshape(rows.shape).astype("<i4")
    vocabulary = b" ".join(names[i] for i in used)  # number 0 is the empty name
    if used[0]:
        vocabulary, local = b" " + vocabulary, local + 1
    columns = [np.diff(local[:, 0], prepend=0), *local[:, 1:].T, counts]
    return zlib.compress(vocabulary, 1), zlib.compress(b"".join(c.astype("<i4").tobytes() for c in columns), 1)


def _unpack(vocabulary: bytes, data: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    columns = np.frombuffer(zlib.decompress(data), "<i4").reshape(DEPTH + 1, -1)
    rows = np.stack([np.cumsum(columns[0]), *columns[1:DEPTH]], axis=1)
    return zlib.decompress(vocabulary).split(b" "), rows, columns[DEPTH].astype(np.int64)


def dealt(docs: DataFrame, bits: np.ndarray, heavy: dict[str, set[bytes]], groups: int) -> DataFrame:
    """(lang, g, vocabulary, data): the suffixes, counted and packed by group."""
    shared = docs.sparkSession.sparkContext.broadcast((bits, heavy))

    def rows(lang: str, ids: Ids, arrays: list[np.ndarray]) -> Iterator[tuple[str, int, bytes, bytes]]:
        found = suffixes(np.concatenate(arrays))
        if not len(found):
            return
        g = prefix_groups(found, np.array(ids.keys_, np.uint64), np.array(ids.is_heavy), groups)
        found, counts, g = counted(found, np.ones(len(found), np.int64), g)
        cuts = np.flatnonzero(np.diff(g, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(g)], strict=True):
            yield lang, int(g[a]), *_pack(found[a:b], counts[a:b], ids.words)

    def batch_of(found: list[tuple[str, int, bytes, bytes]]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["lang", "g", "vocabulary", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, heavy = shared.value
        open_: dict[str, tuple[Ids, list[np.ndarray]]] = {}
        held = 0
        for batch in batches:
            for lang, some in _by_lang(batch).items():
                ids, arrays = open_.setdefault(lang, (Ids(lang, bits, heavy.get(lang, set())), []))
                for text in some:
                    ws = words(text)
                    ws.append(_END)
                    arrays.append(np.fromiter(map(ids.__getitem__, ws), np.int32, len(ws)))
                    held += len(ws)
                    if held > TOGETHER or len(ids) > REMEMBERED:
                        for name, (known, more) in open_.items():
                            if more:
                                yield batch_of(list(rows(name, known, more)))
                        open_, held = {}, 0
                        ids, arrays = open_.setdefault(lang, (Ids(lang, bits, heavy.get(lang, set())), []))
        for name, (known, more) in open_.items():
            if more:
                yield batch_of(list(rows(name, known, more)))

    return texts(docs).mapInArrow(run, "lang string, g long, vocabulary binary, data binary")


def subtrees(packed: DataFrame, heavy: dict[str, set[bytes]], least: int) -> DataFrame:
    """(lang, phrase, a): totals of the groups' nodes of two words or more; of a node in several groups a part from each."""
    shared = packed.sparkSession.sparkContext.broadcast(heavy)

    def run(table: pa.Table) -> pa.Table:
        lang = table.column("lang")[0].as_py()
        mine = shared.value.get(lang, set())
        numbers: dict[bytes, int] = {b"": 0}
        rows, counts = [], []
        for v, d in zip(table.column("vocabulary"), table.column("data"), strict=True):
            names, some, n = _unpack(v.as_py(), d.as_py())
            rows.append(np.array([numbers.setdefault(w, len(numbers)) for w in names], np.int64)[some])
            counts.append(n)
        leaves, n, _ = counted(np.concatenate(rows), np.concatenate(counts))
        names = list(numbers)
        on = np.array([w in mine for w in names])[leaves].cumprod(axis=1).astype(bool)
        phrases, totals = [], []
        new = np.ones(len(leaves), bool)
        new[1:] = leaves[1:, 0] != leaves[:-1, 0]
        for k in range(1, DEPTH):
            new[1:] |= leaves[1:, k] != leaves[:-1, k]
            starts = np.flatnonzero(new)
            total = np.add.reduceat(n, starts)
            for i in np.flatnonzero((leaves[starts, k] > 0) & ((total >= least) | on[starts, k])):
                phrases.append(b" ".join(names[w] for w in leaves[starts[i], : k + 1]).decode("utf-8", "surrogatepass"))
                totals.append(int(total[i]))
        return pa.table({"lang": pa.array([lang] * len(phrases), pa.string()), "phrase": pa.array(phrases, pa.string()), "a": pa.array(totals, pa.int64())})

    return packed.groupBy("lang", "g").applyInArrow(run, "lang string, phrase string, a long")


def phrase_counts(docs: DataFrame, least: int = LEAST, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, a) of all phrases of 2 to DEPTH words with a >= least; and (lang, word, f, n) of all words with f >= least."""
    spark = docs.sparkSession
    counts = word_counts(docs)
    # a language without a frequent word has no candidate; n counts all its words
    all_words = scratch(counts, "words")
    totals = all_words.groupBy("lang").agg(F.sum("f").alias("n"))
    known = all_words.where(F.col("f") >= least)
    number = all_words.agg(F.sum("f")).first()[0] or 0
    budget = max(budget, number // HEAVY + 1)  # so that there are at most HEAVY heavy words
    heavy: dict[str, set[bytes]] = {}
    for r in known.where(F.col("f") > budget).select("lang", "word").collect():
        heavy.setdefault(r["lang"], set()).add(r["word"].encode("utf-8", "surrogatepass"))
    groups = max(partitions(spark), number // budget + 1)
    packed = dealt(docs, _filter(known), heavy, groups)
    found = subtrees(packed, heavy, least).groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return scratch(found, "phrases"), known.join(F.broadcast(totals), "lang").select("lang", "word", "f", "n")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, budget: int = BUDGET) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases, by the scores of their weakest cuts.

    All per language (null: und), over whole texts (null: empty). A phrase that a longer one contains wherever it
    occurs (as many occurrences) goes. Documents without words, an empty table, or no phrase that occurs `least` times:
    no rows. A text given twice counts twice, whatever its doc_id, null included. Only lang and text are read.
    """
    phrases, single = phrase_counts(docs, least, budget)
    parts = F.split("phrase", " ")
    # a longer phrase that occurs as often contains one that is a word longer and does so too
    longer = phrases.where(F.size(parts) > 2).select("lang", "a", F.explode(F.array(F.array_join(F.slice(parts, 2, DEPTH), " "), F.expr("array_join(slice(split(phrase, ' '), 1, size(split(phrase, ' ')) - 1), ' ')"))).alias("phrase"))
    alone = phrases.join(longer.distinct(), ["lang", "phrase", "a"], "left_anti")
    cut = "transform(sequence(1, size(split(phrase, ' ')) - 1), k -> struct(k, array_join(slice(split(phrase, ' '), 1, k), ' ') as first, array_join(slice(split(phrase, ' '), k + 1, 5), ' ') as rest))"
    cuts = alone.select("lang", "phrase", "a", F.explode(F.expr(cut)).alias("cut")).select("lang", "phrase", "a", "cut.*")
    known = scratch(phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")).unionByName(single.select("lang", F.col("word").alias("part"), "f")), "parts")
    cuts = cuts.join(known.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.join(F.broadcast(single.groupBy("lang").agg(F.max("n").alias("n"))), "lang")
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"cast(floor((cast(1000 as decimal(4, 0)) * {wide('a')} * {wide('n')} - (cast(1000 as decimal(4, 0)) * {wide('a')} * {wide('n')}) % ({wide('l')} * {wide('r')})) / ({wide('l')} * {wide('r')})) as bigint)")
    weakest = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("m")).select("lang", "phrase", "a", "n", "m.score", "m.l", "m.r")
    return _first(weakest, top)


def _first(scored: DataFrame, top: int) -> DataFrame:
    """Each language's first `top` rows; of each of 64 parts as many first, so that a task meets few."""
    by = "order by score desc, a desc, phrase"
    some = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = some.withColumn("rank", F.expr(f"row_number() over (partition by lang, part {by})")).where(F.col("rank") <= top)
    out = some.withColumn("rank", F.expr(f"row_number() over (partition by lang {by})").cast("long")).where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
ws as (select lang, [x for x in regexp_split_to_array(piece, '[\x20\x09]+') if x <> ''] as w from pieces),
totals as (select lang, cast(sum(len(w)) as hugeint) as n from ws group by lang),
places as (select lang, w, unnest(range(1, len(w) + 1)) as i from ws),
grams as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase from places, range(1, 6) s(k) where i + k - 1 <= len(w)),
f as (select lang, k as size, phrase, cast(count(*) as hugeint) as a from grams group by all having count(*) >= 100),
cand as (select lang, size, phrase, a, string_split(phrase, ' ') as w from f where size >= 2),
inner_ as (select distinct lang, a, array_to_string(w[i:i + k - 1], ' ') as phrase from cand, range(2, 5) s(k), range(1, 5) t(i) where k < size and i + k - 1 <= size),
alone as (select c.* from cand c anti join inner_ using (lang, a, phrase)),
cuts as (select c.lang, c.phrase, c.a, k, l.a as l, r.a as r, n, (1000 * c.a * n) // (l.a * r.a) as score from alone c join totals using (lang), range(1, 5) s(k)
         , f l, f r where k < c.size and l.lang = c.lang and l.phrase = array_to_string(c.w[1:k], ' ') and r.lang = c.lang and r.phrase = array_to_string(c.w[k + 1:c.size], ' ')),
weak as (select *, row_number() over (partition by lang, phrase order by score, k) as place from cuts),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from weak where place = 1)
select lang, cast(rank as bigint) as rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r, cast(n as bigint) as n, cast(score as bigint) as score from ranked where rank <= 2000"""
