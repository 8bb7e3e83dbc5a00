r"""Byte-level BPE of a corpus: merge replay over its distinct words, on an inverted index.

1. Tasks cut texts into words by the pattern. A word that is a token is its id at once. The others of a slice (a run of
   a task's texts of about SLICE characters) are numbered in the order in which they come.
2. These words go to partitions by their hash, each distinct one to one place only, and the merges are replayed there:
   the bytes of a partition's words lie end to end, an index leads from token pair (by the rank of its merge) to the
   positions where it stands, and the merges are applied in rank order. One merge visits its listed positions only,
   joins each to its right neighbour and lists the two pairs that arise.
3. The ids go back to the slices, where each text's words are replaced by them.

All pairs of one rank that do not overlap merge at once. That is what merging them one by one gives, as long as no merge
makes a pair of a lower rank; a word where one does (only odd vocabularies allow it) is encoded anew one merge at a time.

Null and empty texts have no ids. Rows of equal doc_id are encoded each for itself; a null doc_id is no document. Any
text is whole, however long: nothing is cut, replaced or normalised, and no step is worse than n log n in a text's
length. No rows: none. Step 1 runs once for the words and once for the texts; a table whose rows do not come in the same
order twice is an error, not a wrong result (write it first).
"""

from __future__ import annotations

import base64
import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import count

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, texts

#: Characters of the texts of a slice, and codes of a row of it.
SLICE, ROW = 32_000_000, 1 << 20
#: Parts of the words, by hash.
BUCKETS = 1024
#: Bytes of words that are replayed together; words that a task remembers (beyond, some are replayed anew: no result depends on it).
TOGETHER, REMEMBERED = 16_000_000, 1_000_000
#: The rank of a pair that does not merge.
NEVER = 1 << 40
#: What \s means to the tokenizers: Unicode white space, without the separators \x1c-\x1f.
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and not "\x1c" <= c <= "\x1f")


def compiled(pattern: str) -> regex.Pattern:
    return regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))


class Ranks:
    """A rank file: `tokens` from rank to bytes, `pairs` (sorted) of left and right and what each pair is `merged` into."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
        self.base = max(self.ranks.values()) + 1
        self.tokens = [b""] * self.base
        self.joined: dict[int, int] = {}
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.joined[left * self.base + right] = rank
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)])
        keys = np.array(sorted(self.joined.items())).reshape(-1, 2)
        self.pairs, self.merged = keys[:, 0].copy(), keys[:, 1].copy()
        lower = self.pairs // self.base > self.merged
        #: Tokens that make, with some token behind them, one of a lower rank.
        self.early = set((self.pairs[lower] // self.base).tolist())
        self.cut = compiled(pattern).findall
        #: From word to id, of words that are tokens.
        self.words: dict[str, int] = {}
        for token, rank in self.ranks.items():
            try:
                self.words[token.decode()] = rank
            except UnicodeDecodeError:
                pass

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge; NEVER where the two don't merge or one of them is not there (-1)."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), self.merged[at], NEVER)

    def one(self, word: bytes) -> list[int]:
        """The ids of a word, one merge at a time: the lowest rank first, of equal ones the first."""
        token = [int(self.bytes[b]) for b in word]
        n = len(token)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get, base = self.joined.get, self.base
        heap = [(r, i) for i in range(n - 1) if (r := get(token[i] * base + token[i + 1])) is not None]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            j = after[i] if token[i] >= 0 else n
            if j >= n or get(token[i] * base + token[j]) != r:
                continue
            token[i], token[j], after[i] = r, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (new := get(r * base + token[after[i]])) is not None:
                    heappush(heap, (new, i))
            if before[i] >= 0 and (new := get(token[before[i]] * base + r)) is not None:
                heappush(heap, (new, before[i]))
        return [t for t in token if t >= 0]

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids (unsigned 32-bit) of the words (none empty), and where each word's begin and the last one's end."""
        starts = np.cumsum([0] + [len(w) for w in words])
        n = int(starts[-1])
        token = np.append(self.bytes[np.frombuffer(b"".join(words), np.uint8)], -1)  # at n stands what is not there
        word = np.repeat(np.arange(len(words)), np.diff(starts))
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[starts[1:] - 1] = n
        before[starts[:-1]] = n
        now = np.append(self.rank(token[:-1], token[after[:-1]]), NEVER)  # the rank of the pair that starts at a position
        index: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []
        odd: set[int] = set()

        def enter(places: np.ndarray, values: np.ndarray) -> None:
            order = values.argsort(kind="stable")
            places, values = places[order], values[order]
            cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
            for r, a, b in zip(values[np.append(0, cuts)].tolist(), [0, *cuts.tolist()], [*cuts.tolist(), len(places)], strict=True):
                if (at := index.get(r)) is None:
                    index[r] = [places[a:b]]
                    heappush(ranks, r)
                else:
                    at.append(places[a:b])

        if len(live := np.flatnonzero(now != NEVER)):
            enter(live, now[live])
        while ranks:
            rank = heappop(ranks)
            at = index.pop(rank)
            at = np.unique(np.concatenate(at)) if len(at) > 1 else at[0]
            at = at[now[at] == rank]  # elsewhere a neighbour changed since the pair was listed
            if len(at) > 1 and (tied := after[at[:-1]] == at[1:]).any():
                # a run like aaaa: of pairs that share a token the first merges, then the third and so on
                first = np.append(True, ~tied)
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            right = after[gone]
            if rank in self.early and (lower := self.rank(np.full(len(at), rank), token[right]) < rank).any():
                odd.update(word[at[lower]].tolist())  # before the token behind it merges, too
            token[at], token[gone] = rank, -1
            after[at], before[right] = right, at
            now[gone] = NEVER
            left = before[at]
            now[at] = self.rank(token[at], token[right])
            now[left] = self.rank(token[left], token[at])
            now[n] = NEVER
            places = np.concatenate((at, left))
            values = now[places]
            if (lower := values < rank).any():
                odd.update(word[places[lower]].tolist())
            if len(places := places[keep := values != NEVER]):
                enter(places, values[keep])
        live = token[:n] >= 0
        flat = token[:n][live].astype(np.uint32)
        ends = np.append(0, np.cumsum(live))[starts]
        if odd:
            parts = [np.array(self.one(words[k]), np.uint32) if k in odd else flat[ends[k] : ends[k + 1]] for k in range(len(words))]
            flat, ends = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        return flat, ends

    def decode(self, ids: bytes | np.ndarray) -> bytes:
        return b"".join([self.tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(maxsize=2)
def ranks(path: str, pattern: str) -> Ranks:
    return Ranks(path, pattern)


def slices(batches: Iterator[pa.RecordBatch], coder: Ranks) -> Iterator[tuple[int, list[int], list[np.ndarray], list[str] | None]]:
    """(slice, doc_ids, the codes of each text, the slice's new words once it ends): a code is an id, or base + k for the k-th new word."""
    number, size, held = 0, 0, 0
    codes = defaultdict(count(coder.base).__next__, coder.words)
    doc_ids, found = [], []
    for batch in batches:
        if batch.num_rows and not number:
            number = (batch.column("part")[0].as_py() << 32) + 1
        for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            text = t.as_py()
            ws = coder.cut(text)
            doc_ids.append(d)
            found.append(np.fromiter(map(codes.__getitem__, ws), np.uint32, len(ws)))
            size, held = size + len(text) + 1, held + len(ws)
            if size >= SLICE:
                yield number, doc_ids, found, list(codes)[len(coder.words) :]
                number, size = number + 1, 0
                codes = defaultdict(count(coder.base).__next__, coder.words)
            elif held >= ROW:
                yield number, doc_ids, found, None
            else:
                continue
            doc_ids, found, held = [], [], 0
    yield number, doc_ids, found, list(codes)[len(coder.words) :]


def _planes(a: np.ndarray) -> bytes:
    """The bytes of an array of integers, all first ones before all second ones and so on: they compress better so."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes()


def _whole(planes: bytes | memoryview, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays, their lengths in front."""
    head = np.array([len(a) for a in arrays], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join([_planes(a) for a in arrays]))


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw, at, out = memoryview(zstandard.ZstdDecompressor().decompress(data)), 8 * len(kinds), []
    for n, kind in zip(np.frombuffer(raw[:at], np.int64).tolist(), kinds, strict=True):
        size = n * np.dtype(kind).itemsize
        out.append(_whole(raw[at : at + size], kind))
        at += size
    return out


class Reordered(RuntimeError):
    def __init__(self) -> None:
        super().__init__("the table's rows came in another order the second time: write it first")


#: Rows of a slice, in their order: the ids of some of its new words, then its texts' codes, then a digest of its new words.
PARTS = "slice long, kind int, data binary"


def new_words(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(bucket, slice, data): the words of each slice that are no tokens, by a hash of the word; data: numbers, lengths, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, _, words in slices(batches, ranks(path, pattern)):
            if not words:
                continue
            every = [w.encode() for w in words]
            buckets = np.fromiter(map(xxhash.xxh32_intdigest, every), np.uint32, len(every)) % BUCKETS
            order = buckets.argsort(kind="stable")
            used, first = np.unique(buckets[order], return_index=True)
            data = []
            for at in np.split(order, first[1:]):
                mine = [every[k] for k in at.tolist()]
                data.append(_pack(np.diff(at, prepend=0).astype(np.uint32), np.fromiter(map(len, mine), np.uint32, len(mine)), np.frombuffer(b"".join(mine), np.uint8)))
            arrays = [pa.array(used.astype(np.int32)), pa.array(np.full(len(used), number)), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "slice", "data"])

    return docs.mapInArrow(run, "bucket int, slice long, data binary")


def coded_texts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """PARTS of kind 1 (doc_ids, how many codes each has, codes), and of kind 2, a digest of its new words, at a slice's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, doc_ids, found, words in slices(batches, ranks(path, pattern)):
            rows = []
            if doc_ids:
                lengths = np.array([len(x) for x in found], np.uint32)
                rows.append((1, _pack(np.array(doc_ids, np.int64), lengths, np.concatenate(found))))
            if words:
                rows.append((2, xxhash.xxh64_digest("".join(words).encode())))
            kinds, data = zip(*rows, strict=True) if rows else ((), ())
            arrays = [pa.array(np.full(len(rows), number)), pa.array(kinds, pa.int32()), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["slice", "kind", "data"])

    return docs.mapInArrow(run, PARTS)


def replayed(words: DataFrame, path: str, pattern: str) -> DataFrame:
    """PARTS of kind 0 (numbers of words, how many ids each has, ids), from new_words()."""
    grouped = words.repartition(partitions(words.sparkSession), "bucket")

    def encoded(held: dict[int, list], known: dict[bytes, bytes], new: set[bytes], coder: Ranks) -> pa.RecordBatch:
        fresh = list(new)
        if fresh:
            flat, ends = coder.replay(fresh)
            raw, ends = flat.tobytes(), (ends * 4).tolist()
            known.update(zip(fresh, [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], strict=True))
        data = []
        for parts in held.values():
            at = np.concatenate([a for a, _ in parts])
            ids = [known[w] for _, ws in parts for w in ws]
            order = at.argsort()
            n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            flat = np.frombuffer(b"".join([ids[k] for k in order.tolist()]), np.uint32)
            data.append(_pack(np.diff(at[order], prepend=0).astype(np.uint32), n[order].astype(np.uint32), flat))
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([0] * len(data), pa.int32()), pa.array(data, pa.binary())], names=["slice", "kind", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, known = ranks(path, pattern), {}
        held, new, size = defaultdict(list), set(), 0
        for batch in batches:
            for number, data in zip(batch.column("slice").to_pylist(), batch.column("data"), strict=True):
                at, lengths, text = _unpack(data.as_py(), "<u4", "<u4", "u1")
                text, ends = text.tobytes(), np.cumsum(lengths.astype(np.int64)).tolist()
                ws = [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                held[number].append((np.cumsum(at.astype(np.int64)), ws))
                new.update([w for w in ws if w not in known])
                size += len(text)
                if size >= TOGETHER:
                    yield encoded(held, known, new, coder)
                    held, new, size = defaultdict(list), set(), 0
                    if len(known) > REMEMBERED:
                        known.clear()
        if held:
            yield encoded(held, known, new, coder)

    return grouped.mapInArrow(run, PARTS)


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices first, first + 1, ... of each of several runs, one run after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)


def each_text(df: DataFrame, path: str, pattern: str, schema: str, of: Callable[[Ranks, int, np.ndarray], tuple]) -> DataFrame:
    """The row of `schema` that `of` makes from each text's doc_id and ids."""
    docs = texts(df).withColumn("part", F.spark_partition_id())
    parts = replayed(new_words(docs, path, pattern), path, pattern).union(coded_texts(docs, path, pattern))
    parts = parts.repartition(partitions(df.sparkSession), "slice").sortWithinPartitions("slice", "kind")
    fields = [c.split() for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ranks(path, pattern)
        own = np.arange(coder.base + 1)
        here, given, size, flat, ends = None, [], 0, None, None
        for batch in batches:
            for number, kind, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if number != here:
                    here, given, size, flat = number, [], 0, None
                if kind == 0:
                    at, n, ids = _unpack(data, "<u4", "<u4", "<u4")
                    given.append((np.cumsum(at.astype(np.int64)), n, ids))
                    continue
                if flat is None:  # tokens are their own ids; a new word's ids stand behind them, by its number
                    at, n, ids = (np.concatenate(x) if x else np.zeros(0, np.uint32) for x in (zip(*given, strict=True) if given else ((), (), ())))
                    size, n = len(at), n.astype(np.int64)
                    if size and not np.array_equal(np.sort(at), np.arange(size)):
                        raise Reordered
                    order = at.argsort()
                    first = np.cumsum(n) - n
                    flat = np.concatenate((own[:-1].astype(np.uint32), ids[spread(first[order], n[order])]))
                    ends = np.concatenate((own, coder.base + np.cumsum(n[order])))
                    given = []
                if kind == 2:
                    if flat is None or xxhash.xxh64_digest(coder.decode(flat[coder.base :])) != data:
                        raise Reordered
                    continue
                doc_ids, lengths, codes = _unpack(data, "<i8", "<u4", "<u4")
                if len(codes) and codes.max() >= len(ends) - 1:
                    raise Reordered
                n = ends[1:][codes] - ends[:-1][codes]
                ids = flat[spread(ends[:-1][codes], n)]
                cuts = np.append(0, np.cumsum(n))[np.append(0, np.cumsum(lengths.astype(np.int64)))].tolist()
                yield made([of(coder, d, ids[a:b]) for d, a, b in zip(doc_ids.tolist(), cuts[:-1], cuts[1:], strict=True)])

    return parts.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit integers) of each text."""
    return each_text(df, path, pattern, "doc_id long, ids binary", lambda coder, d, ids: (d, ids.tobytes()))


def decode(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the text of each row's ids, as bytes (null ids: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ranks(path, pattern)
        for batch in batches:
            out = [coder.decode(x.as_py() or b"") for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def _digests(coder: Ranks, d: int, ids: np.ndarray) -> tuple:
    raw = ids.tobytes()
    return d, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(coder.decode(raw)).hexdigest()


def round_trip(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes each text, decodes the ids and returns digests of both; ids stay within the task."""
    return each_text(df, path, pattern, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", _digests)
