"""Vector best-fit packing of documents into sequences of bounded length.

A piece of a document has three sizes: its tokens, 1 document, and its attention cost, the tiles of TILE x TILE tokens
that its own attention fills (those of its length, rounded up, squared); a sequence has a capacity for each. The cost's
is little more than that of one piece of full length, so that short documents, which fill tiles badly, spread over
sequences. Pieces go in order of falling length into the sequence that they leave with the smallest weighted
norm of what is free (or with which they have the largest weighted dot product), among those where all three fit.

Pieces of one length are alike, so the choice is made for counts of pieces and counts of alike sequences: what is
planned at once is the table of lengths (as many rows as a sequence has tokens), whatever the number of documents.
A plan's row says that the pieces of a length with ranks a to b go to sequences s, s + 1, ... at one offset; each
piece finds its row by its length and its rank among the pieces of that length.

Null and empty texts are a document of the end token alone. Rows of equal doc_id are packed each for itself. An empty
table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import insort
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keeps, numbered, scratch, texts, turn_to

LENGTH = 1024
#: Tokens on a side of a tile of attention; tiles that a sequence may fill beyond those of one piece of full length; and
#: documents that it may hold.
TILE, EXTRA, DOCUMENTS = 128, 2, 12
#: How byte-level vocabularies write each byte: a printable one as its Latin-1 character, the others in turn from U+0100.
PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTES = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in PRINTABLE)}
BLANK = chr(BYTES[0x20])
END = 2
#: Bytes, roughly, of chunks and their ids that a worker remembers at most; beyond that it forgets all and starts anew. No result depends on it.
REMEMBERED = 100_000_000
#: Characters of text that are encoded together.
TOGETHER = 2_000_000
#: A blank that white space or the end follows: there the chunk goes on.
LOOSE = re.compile(r" (?:\s|\Z)")
#: Weights of tokens, documents and cost in the norm and the dot product; tokens decide, the others break ties.
WEIGHTS = (1.0, 0.05, 0.05)


def chunks(text: str) -> list[str]:
    """The text cut before each blank that a character other than white space follows; those blanks are left out."""
    found = text.split(" ")
    if not LOOSE.search(text):
        return found
    out = found[:1]
    for c in found[1:]:
        if c and not c[0].isspace():
            out.append(c)
        else:
            out[-1] += " " + c
    return out


def together(column: pa.Array, limit: int = TOGETHER) -> Iterator[list[str]]:
    """Runs of neighbouring texts (null: empty) of about `limit` characters."""
    out, size = [], 0
    for value in column:
        out.append(t := value.as_py() or "")
        size += len(t) + 1
        if size >= limit:
            yield out
            out, size = [], 0
    if out:
        yield out


class Words:
    """Ids by the tokenizer, remembered for each blank-separated chunk (at whose borders byte-level BPE always cuts).

    A text that holds one of the vocabulary's special strings passes the tokenizer whole, as the library takes such a
    string for one token (`special`), unless it is to be ordinary text.
    """

    def __init__(self, path: str, special: bool = True) -> None:
        # a worker has one core: the library's threads, one for each of the machine's, would each keep memory of their own
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.known: dict[str, bytes] = {}  # from a chunk that follows a blank to the ids of both
        self.first: dict[str, bytes] = {}  # from a text's first chunk to its ids
        self.bytes = 0
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        strings = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.special = re.compile("|".join(map(re.escape, strings)) if strings else r"(?!)")
        vocabulary = self.tokenizer.get_vocab()
        self.four = [i.to_bytes(4, "little") for i in range(max(vocabulary.values()) + 1)]
        self.starts = np.zeros(max(vocabulary.values()) + 1, bool)  # of ids whose token starts with a blank
        self.starts[[i for t, i in vocabulary.items() if t[0] == BLANK]] = True

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, batch: list[str]) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        if self.bytes > REMEMBERED:
            self.forget()
        new, heads = set(), set()
        cut = [t if self.special.search(t) else chunks(t) for t in batch]
        known = self.known
        for c in cut:
            if isinstance(c, list):
                heads.add(c[0])
                new.update([x for x in c[1:] if x not in known])
        fresh, heads = list(new), list(heads.difference(self.first))
        ids = self.learn([" " + c for c in fresh] + heads)
        self.bytes += sum(map(len, ids)) + sum(map(len, fresh)) + sum(map(len, heads)) + 200 * len(ids)
        known.update(zip(fresh, ids[: len(fresh)], strict=True))
        self.first.update(zip(heads, ids[len(fresh) :], strict=True))
        get = known.__getitem__
        for c in cut:
            yield self.first[c[0]] + b"".join(map(get, c[1:])) if isinstance(c, list) else self.whole(c)

    def forget(self) -> None:
        self.known.clear()
        self.first.clear()
        self.bytes = 0

    def learn(self, new: list[str]) -> list[bytes]:
        """Chunks of letters alone are one word for the model; others pass the whole tokenizer.

        Of those, the ones whose only blank is the first are joined before encoding, and their ids cut at each blank.
        """
        out, four, model = {}, self.four, self.tokenizer.model
        joined, alone = [], []
        for c in new:
            if (c[1:] if c[:1] == " " else c).isalpha():
                word = c if c.isascii() else c.encode().decode("latin-1")
                out[c] = b"".join([four[t.id] for t in model.tokenize(word.translate(BYTES))])
            else:
                (joined if c.rfind(" ") == 0 else alone).append(c)
        for at in range(0, len(joined), 100_000):
            part = joined[at : at + 100_000]
            found = self.tokenizer.encode_batch_fast(["".join(part[k : k + 50]) for k in range(0, len(part), 50)], add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, "<u4") for e in found])
            cuts = (np.flatnonzero(self.starts[ids]) * 4).tolist()
            flat = ids.tobytes()
            out.update(zip(part, [flat[a:b] for a, b in zip(cuts, [*cuts[1:], len(flat)], strict=True)], strict=True))
        for c, e in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False), strict=True):
            out[c] = np.array(e.ids, "<u4").tobytes()
        return [out[c] for c in new]


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(path)


def cut(ids: bytes, length: int = LENGTH) -> Iterator[tuple[int, int, bytes]]:
    """(start, tokens, ids) of each piece: all but the first have the full length."""
    n = len(ids) // 4
    start, size = 0, n % length or min(n, length)
    while start < n:
        yield start, size, ids[4 * start : 4 * (start + size)]
        start, size = start + size, length


def tokenized(df: DataFrame, path: str, length: int = LENGTH, end: int = END, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece, and its ids (binary), if they are to be kept."""
    last = np.array([end], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("packing")
        keeps("packing", words.cache_clear)
        coder = words(path)
        for batch in batches:
            doc_ids = iter(batch.column("doc_id").to_pylist())
            for part in together(batch.column("text")):
                rows = []
                for ids in coder.encode(part):
                    d = next(doc_ids)
                    rows += [(d, k, s, n, zlib.crc32(b), b) for k, (s, n, b) in enumerate(cut(ids + last, length))]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[i], kinds[i]) for i in range(len(names))], names=names)

    return texts(df).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def cost(size: int) -> int:
    return (-(-size // TILE)) ** 2


def plan(
    counts: Iterable[tuple[int, int]], length: int = LENGTH, max_documents: int = DOCUMENTS, max_cost: int | None = None, weights: tuple[float, float, float] = WEIGHTS, by: str = "norm"
) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), by length and rank, from (length, number of pieces).

    A row holds up to the next rank of the same length. A piece that alone exceeds a capacity is an error.
    """
    caps = np.array([length, max_documents, cost(length) + EXTRA if max_cost is None else max_cost], float)
    scale = np.array(weights) ** 0.5 / caps
    free = np.empty((0, 3))  # what is free in each kind of open sequence
    holds: list[list[tuple[int, int]]] = []  # for each kind its runs of sequences: (first, how many)
    place: dict[tuple[float, ...], int] = {}
    rows, sequences = [], 0

    def put(left: np.ndarray, runs: list[tuple[int, int]]) -> None:
        nonlocal free
        if left[0] < 1 or left[1] < 1 or left[2] < 1:
            return  # nothing fits any more
        k = place.get(key := tuple(left))
        if k is None:
            place[key] = len(holds)
            holds.append([])
            free = np.vstack([free, left])
            k = len(holds) - 1
        for run in runs:
            insort(holds[k], run)

    for size, count in sorted(counts, reverse=True):
        item = np.array([size, 1, cost(size)], float)
        if (item > caps).any():
            raise ValueError(f"a piece of {size} tokens exceeds a sequence's capacity")
        rank = 0
        while rank < count:
            fits = np.array([bool(h) for h in holds], bool)
            fits &= (free >= item).all(axis=1)
            if fits.any():
                left = (free[fits] - item) * scale
                score = (left**2).sum(axis=1) if by == "norm" else -((free[fits] * scale) @ (item * scale))
                k = np.flatnonzero(fits)[score.argmin()]
                runs, used = holds[k], []
                while runs and rank < count:
                    first, many = runs.pop(0)
                    take = min(many, count - rank)
                    rows.append((size, rank, first, length - int(free[k][0])))
                    used.append((first, take))
                    rank += take
                    if take < many:
                        runs.insert(0, (first + take, many - take))
                put(free[k] - item, used)
            else:  # new sequences, each with as many of these pieces as it can hold
                each = int(min(caps // item))
                full, rest = divmod(count - rank, each)
                for n, many in ((each, full), (rest, 1)):
                    if n and many:
                        for i in range(n):
                            rows.append((size, rank, sequences, i * size))
                            rank += many
                        put(caps - n * item, [(sequences, many)])
                        sequences += many
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def place_pieces(pieces: DataFrame, length: int = LENGTH, max_documents: int = DOCUMENTS, max_cost: int | None = None, by: str = "norm") -> DataFrame:
    """Adds sequence_id and offset to the pieces that tokenized() gives."""
    counts = [(r["length"], r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()]
    table = plan(counts, length, max_documents, max_cost, by=by)  # `counts` has at most `length` rows
    ranked = numbered(pieces, ["length"], ["doc_id", "piece"], "_rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            size, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            row = np.searchsorted(start, size << 44 | rank, side="right") - 1
            seq = table[row, 2] + rank - table[row, 1]
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(seq), pa.array(table[row, 3])], names=[c.split()[0] for c in PACKED.split(", ")])

    return ranked.mapInArrow(run, PACKED)


def pack(df: DataFrame, path: str, length: int = LENGTH, end: int = END, **capacities) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = scratch(tokenized(df, path, length, end), "pieces")
    return place_pieces(pieces, length, **capacities)


def sequences(df: DataFrame, packed: DataFrame, path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """sequence_id and ids (binary) of each sequence of pack(df, ...), whose doc_ids must differ."""
    pieces = tokenized(df, path, length, end, keep_ids=True).select("doc_id", "piece", "ids")
    both = packed.select("doc_id", "piece", "sequence_id", "offset").join(pieces, ["doc_id", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # a sequence's pieces: bounded by its length
    joined = F.aggregate(parts, F.encode(F.lit(""), "UTF-8"), lambda a, x: F.concat(a, x["ids"]))
    return both.groupBy("sequence_id").agg(joined.alias("ids"))
