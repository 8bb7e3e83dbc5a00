"""SimHash near-duplicates through an inverted index on the fingerprint's positional bytes, with count filtering.

Two fingerprints of 8 bytes that differ in at most `distance` bits share at least 8 - distance bytes at their places;
that is the guaranteed minimum of shared bytes. Lists of a single byte's value would pair all fingerprints that share one
byte, 1/256 of all, so lists are met in combination: a posting is the value of some pairs of neighbouring bytes, as many
as two close fingerprints must share (two of four, for a distance of two). In a list the shared bytes of each pair are
tallied, pairs that reach the guaranteed minimum are retained and verified bit by bit. A list of more than LIGHT
fingerprints is split by further bytes until a posting holds 8 - distance of them: two that reach the minimum share such
a posting too, and only `distance` bytes are free in it, which bounds it (65,536 different fingerprints for two),
whatever the number of documents. Long lists are found by their sums and never meet in one task whole. Equal
fingerprints are one entry. A list gives links that connect it as all its links would, not every pair.

near_duplicates() follows fingerprints of word shingles to their components. similar_texts() finds texts whose
five-word shingles overlap by 0.8 or more: candidates share a fingerprint of single words up to two bits in one of
several tables (a shingle's fingerprint turns too many bits for that overlap) or a band of MinHashes of the five-word
shingles; each MinHash gives a positional byte, shared bytes are tallied per pair, and pairs that reach the minimum are
verified by the exact overlap of their sets of five-word shingles.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, join_back, keyed, partitions, scratch, slices, texts, turn_to
from .components import components

SEED = 42
#: Tables of single-word fingerprints in similar_texts().
TABLES = 3
#: Bands of MinHashes of five-word shingles, and MinHashes of a band: of pairs of 0.8 all but 1 in 300,000 share a band.
BANDS, ROWS = 24, 4
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
#: Positional bytes that a pair must share; of two texts of overlap 0.8 it is reached by all but one in ten thousand.
MATCHES = 62
#: Texts of a list that are tallied pair by pair; and the number of bands after which a longer list is not split further.
LIST, DEEP = 1024, 4
#: Bytes of shingle sets that a task of verified(), or a block of a list, keeps for texts that it meets again.
KEPT = 1 << 25
#: Parts in which a text meets its candidates.
PARTS = 64
SIMILARITY = 0.8
DISTANCE = 2
#: Fingerprints of a list that are tallied pair by pair.
LIGHT = 512
SHINGLE = 3
#: Bytes of shingle hashes whose bits are counted at a time.
TOGETHER = 1 << 18


def shingle_hashes(text: str | bytes, shingle: int) -> np.ndarray:
    """XXH64 of each run of `shingle` words, A-Z in lower case; of all words, if there are fewer; none without words."""
    words = (text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")).lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    whole, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-shingle]]]
    return np.array([digest(whole[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=True)], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """The signed 64-bit fingerprint: a bit is 1 if it is set in more than half of the hashes."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), TOGETHER // 8):
        bits = np.unpackbits(hashes[at : at + TOGETHER // 8].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every text; a text without words has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [simhash(shingle_hashes(t.as_py(), shingle)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return texts(df).mapInArrow(run, "doc_id long, fp long")


def _signed(places: Iterable[int]) -> int:
    """The mask of these byte places, as a signed number."""
    m = sum(0xFF << 8 * p for p in places)
    return m - (1 << 64) if m >> 63 else m


def _masks(distance: int) -> list[tuple[int, list[int]]]:
    """For each choice of pairs of neighbouring bytes the mask that keeps them, and the masks of 8 - distance bytes that split its lists."""
    if not 0 <= distance <= 3:
        raise ValueError("distance must be 0 to 3")
    out = []
    for pairs_ in combinations(range(4), 4 - distance):
        kept = [2 * p + k for p in pairs_ for k in (0, 1)]
        free = [p for p in range(8) if p not in kept]
        out.append((_signed(kept), [_signed([*kept, *more]) for more in combinations(free, 8 - distance - len(kept))]))
    return out


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))


def retained(values: np.ndarray, left: np.ndarray, right: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs those whose tally of shared bytes reaches 8 - distance and that are within `distance` bits."""
    differ = values[left] ^ values[right]
    tally = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    at = np.flatnonzero(tally >= 8 - distance)
    at = at[popcount(differ[at]) <= distance]
    return left[at], right[at]


def pairs(values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs of one list's different fingerprints within `distance`; each has few such neighbours."""
    n = len(values)
    if n <= LIGHT:
        left, right = np.triu_indices(n, 1)
        return retained(values, left, right, distance)
    # look up every value that differs in up to `distance` of the bits that vary in this list
    vary = int(np.bitwise_or.reduce(values ^ values[0])) & (1 << 64) - 1
    bits = [np.uint64(1 << i) for i in range(64) if vary >> i & 1]
    order = values.argsort()
    ranked = values[order]
    found = []
    for k in range(1, distance + 1):
        for some in combinations(bits, k):
            other = values ^ np.bitwise_or.reduce(np.array(some, np.uint64)).astype(np.int64)
            at = np.minimum(np.searchsorted(ranked, other), n - 1)
            hit = np.flatnonzero((ranked[at] == other) & (values < other))
            found.append(np.stack((hit, order[at[hit]])))
    return tuple(np.concatenate(found, axis=1))


def connect(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of one list's different fingerprints: each to the smallest that it reaches within the list."""
    n = len(values)
    left, right = pairs(values, distance)
    label = np.arange(n)
    while True:  # labels fall to the smallest reachable index, by hooking and shortcuts
        new = label.copy()
        np.minimum.at(new, left, label[right])
        np.minimum.at(new, right, label[left])
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(int(values[i]), int(values[label[i]])) for i in np.flatnonzero(label != np.arange(n))]


def links(fps: DataFrame, distance: int = DISTANCE, every: bool = False) -> DataFrame:
    """(a, b): links between different values of `fp` that connect what differs in at most `distance` bits.

    With `every`, all such pairs, some more than once: a value has at most as many as there are ways to change
    `distance` bits.
    """
    masks = _masks(distance)
    kept = F.array(*[F.struct(F.lit(i).alias("places"), F.col("fp").bitwiseAND(F.lit(m)).alias("bytes")) for i, (m, _) in enumerate(masks)])
    postings = fps.select(F.explode(kept).alias("list"), "fp")
    sizes = postings.groupBy("list").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = join_back(postings, sizes, "list", "n", len(masks) * fps.count())
    split = F.lit(None)
    for i, (_, more) in enumerate(masks):
        finer = F.array(*[F.struct(F.lit(100 + 100 * i + k).alias("places"), F.col("fp").bitwiseAND(F.lit(m)).alias("bytes")) for k, m in enumerate(more)])
        split = F.when(F.col("list.places") == i, finer).otherwise(split)
    lists = sized.where(f"n <= {LIGHT}").select("list.places", "list.bytes", "fp")
    longer = sized.where(f"n > {LIGHT}").select(F.explode(split).alias("list"), "fp").select("list.places", "list.bytes", "fp")
    lists = lists.union(longer).repartition(partitions(fps.sparkSession), "places", "bytes").sortWithinPartitions("places", "bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((0, 3), np.int64)
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            rows = np.concatenate((rest, rows))
            new = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
            last = new[-1] if len(new) else 0
            yield _linked(rows[:last], distance, every)
            rest = rows[last:]  # the list that the next batch may go on with
        yield _linked(rest, distance, every)

    return lists.mapInArrow(run, "a long, b long")


def _linked(rows: np.ndarray, distance: int, every: bool) -> pa.RecordBatch:
    """The links of whole lists, sorted by list."""
    out: list[tuple[int, int]] = []
    if len(rows):
        cuts = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
        starts = np.append(0, cuts)
        sizes = np.diff(np.append(starts, len(rows)))
        left, right = retained(rows[:, 2].copy(), starts[sizes == 2], starts[sizes == 2] + 1, distance)
        out = list(zip(rows[left, 2].tolist(), rows[right, 2].tolist(), strict=True))
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            values = rows[s : s + n, 2]
            if every:
                left, right = pairs(values, distance)
                out += zip(values[left].tolist(), values[right].tolist(), strict=True)
            else:
                out += connect(values, distance)
    a, b = zip(*out, strict=True) if out else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def near_duplicates(df: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id): components of fingerprints that differ in at most `distance` bits.

    component_id is the smallest doc_id in the component. Rows of equal doc_id count as documents of their own; a null
    text is an empty one, and texts without words link like any others, by their fingerprint zero. Empty in, empty out.
    """
    marks = scratch(fingerprints(df, shingle), "fingerprints")
    nodes = scratch(marks.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), "nodes")
    roots = components(links(nodes.select("fp"), distance), "a", "b")
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", "copies", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = scratch(join_back(rooted, lowest, "root", "n", nodes.count()).select("fp", "copies", "component_id"), "named")
    return join_back(marks, named, "fp", "copies", marks.count()).select("doc_id", "fp", "component_id")


def minhashes(hashes: np.ndarray) -> np.ndarray:
    """BANDS x ROWS MinHashes; texts without words share all."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, (FACTORS[:, None] * hashes[None, at : at + 1024]).min(axis=1))
    return least


def marks(docs: DataFrame) -> DataFrame:
    """(key, doc_id, h, t0.. of single words, n, bands, places, text_key) of every text.

    n is the number of five-word shingles, bands the hashes of each band's MinHashes, places the bytes of all MinHashes.
    """
    names = [*[f"t{i}" for i in range(TABLES)], "n"]

    def several(h: np.ndarray, n: int) -> list[int]:
        """Fingerprints by n independent hashes, made from one."""
        out = []
        for i in range(n):
            x = h ^ np.uint64((i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
            x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
            out.append(simhash(x ^ x >> np.uint64(32)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("simhash")
        for batch in slices(batches):
            rows, keys, bands, places = [], [], [], []
            for t in batch.column("text"):
                text = t.as_py()
                h = np.unique(shingle_hashes(text, 5))
                least = minhashes(h)
                rows.append([*several(shingle_hashes(text, 1), TABLES), len(h)])
                bands.append([xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) - (1 << 63) for i in range(BANDS)])
                # MinHashes are small numbers where shingles are many: their bytes are taken behind a mix
                places.append(((least ^ least >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(56)).astype(np.uint8).tobytes())
                keys.append(xxhash.xxh128_hexdigest(text.encode("utf-8", "surrogatepass")))
            columns = np.array(rows, np.int64).reshape(-1, len(names)).T
            given = [batch.column(c) for c in ("key", "doc_id", "h")]
            more = [pa.array(bands, pa.list_(pa.int64())), pa.array(places, pa.binary()), pa.array(keys, pa.string())]
            yield pa.RecordBatch.from_arrays([*given, *[pa.array(c) for c in columns], *more], names=["key", "doc_id", "h", *names, "bands", "places", "text_key"])

    docs = docs.select("key", "doc_id", F.xxhash64("text").alias("h"), "text")
    return docs.mapInArrow(run, ", ".join(["key long", "doc_id long", "h long", *[f"{n} long" for n in names], "bands array<long>", "places binary", "text_key string"]))


def tallied(pairs: DataFrame) -> DataFrame:
    """(x, y): of pairs (x, y, xp, yp) those whose tally of shared positional bytes reaches MATCHES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("xp", "yp")]
            keep = pa.array((sides[0] == sides[1]).sum(axis=1) >= MATCHES) if batch.num_rows else pa.array([], pa.bool_())
            yield batch.select(["x", "y"]).filter(keep)

    return pairs.select("x", "y", "xp", "yp").mapInArrow(run, "x long, y long")


def packed_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, packed): the compressed texts whose key is a node of wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            packed = [zlib.compress(t.as_py().encode("utf-8", "surrogatepass"), 3) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(packed, pa.binary())], names=["node", "packed"])

    return docs.select("key", "text").join(wanted.withColumnRenamed("node", "key"), "key", "left_semi").mapInArrow(run, "node long, packed binary")


def verified(pairs: DataFrame, packed: DataFrame, similarity: float) -> DataFrame:
    """The pairs (x, y) whose sets of five-word shingles have that overlap (Jaccard) or more; two empty sets do.

    A text may have very many candidates; it meets them in parts, so that no key holds all. A part is a run of sorted
    rows, x before each y, and of a run only the set of x is kept.
    """
    part = F.pmod(F.xxhash64("y"), F.lit(PARTS)).cast("long").alias("part")
    sides = pairs.select("x", part, F.lit(0).alias("side"), F.col("x").alias("node")).distinct()
    sides = scratch(sides.union(pairs.select("x", part, F.lit(1), F.col("y"))), "sides")
    met = sides.join(packed, "node").select("x", "part", "side", "node", "packed")
    met = met.repartition(partitions(met.sparkSession), "x", "part").sortWithinPartitions("x", "part", "side", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("simhash")
        at, heads = None, []
        sets: dict[int, np.ndarray] = {}
        size = 0
        for batch in batches:
            found = []
            for x, part, side, node, data in zip(*batch.columns, strict=True):
                here = (x.as_py(), part.as_py())
                if here != at:
                    at, heads = here, []
                mine = sets.get(node.as_py())
                if mine is None:
                    mine = np.unique(shingle_hashes(zlib.decompress(data.as_py()), 5))
                    size += mine.nbytes + 256
                    if size > KEPT:
                        sets, size = {}, mine.nbytes + 256
                    sets[node.as_py()] = mine
                if side.as_py() == 0:
                    heads.append(mine)  # more than one only where texts share a doc_id
                    continue
                for other in heads:
                    common = len(np.intersect1d(mine, other, assume_unique=True))
                    union = len(mine) + len(other) - common
                    if not union or common / union >= similarity:
                        found.append((here[0], node.as_py()))
                        break
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["x", "y"])

    return met.mapInArrow(run, "x long, y long")


class Sets:
    """The sets of five-word shingles of compressed texts; those known are given up when they pass `kept` bytes."""

    def __init__(self, kept: int) -> None:
        self.known: dict[bytes, np.ndarray] = {}
        self.size, self.kept = 0, kept

    def of(self, text: bytes) -> np.ndarray:
        mine = self.known.get(text)
        if mine is None:
            mine = np.unique(shingle_hashes(zlib.decompress(text), 5))
            self.size += mine.nbytes + len(text) + 256
            if self.size > self.kept:
                self.known, self.size = {}, mine.nbytes + len(text) + 256
            self.known[text] = mine
        return mine

    def alike(self, one: bytes, two: bytes, similarity: float) -> bool:
        a, b = self.of(one), self.of(two)
        common = len(np.intersect1d(a, b, assume_unique=True))
        union = len(a) + len(b) - common
        return not union or common / union >= similarity


def verified_in_blocks(pairs: DataFrame, packed: DataFrame, similarity: float) -> DataFrame:
    """The same for pairs (x, y, list, p, q): a text travels once to each block (list, p, q) with a pair of it, not once for each pair.

    A block has at most two times LIST texts, held compressed; sets of shingles are kept as far as KEPT allows.
    """
    block = ["list", "p", "q"]
    sides = pairs.select(*block, F.col("x").alias("node")).union(pairs.select(*block, "y")).distinct()
    given = sides.join(packed, "node").select(*block, F.lit(0).alias("kind"), "node", F.lit(0).cast("long").alias("y"), "packed")
    given = given.union(pairs.select(*block, F.lit(1), F.col("x"), "y", F.lit(None).cast("binary")))
    given = given.repartition(partitions(given.sparkSession), *block).sortWithinPartitions(*block, "kind", "node", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("simhash")
        at, data, sets = None, {}, Sets(KEPT)
        for batch in batches:
            found = []
            for *here, kind, node, y, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if here != at:
                    at, data = here, {}
                if kind == 0:
                    data.setdefault(node, []).append(text)  # more than one only where texts share a doc_id
                elif any(sets.alike(a, b, similarity) for a in data[node] for b in data[y]):
                    found.append((node, y))
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["x", "y"])

    return given.mapInArrow(run, "x long, y long")


def close_fingerprints(nodes: DataFrame, distance: int) -> DataFrame:
    """(x, y): in each table a fingerprint's texts with the smallest of them, and the smallest of fingerprints that the index links."""
    found, number = None, nodes.count()
    for i in range(TABLES):
        heads = nodes.groupBy(F.col(f"t{i}").alias("fp")).agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n"))
        close = links(heads.select("fp"), distance)
        a, b = heads.selectExpr("fp as a", "head as x"), heads.selectExpr("fp as b", "head as y")
        across = close.join(a, "a").join(b, "b").select("x", "y")
        within = join_back(nodes.select("node", F.col(f"t{i}").alias("fp")), heads, "fp", "n", number).where("node <> head").select(F.col("head").alias("x"), F.col("node").alias("y"))
        both = across.union(within)
        found = both if found is None else found.union(both)
    return found


def similar_texts(df: DataFrame, similarity: float = SIMILARITY, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, component_id): components of documents with equal texts or verified links; the id is the smallest doc_id.

    Texts that share a band are candidates, and those whose fingerprints the index links. A candidate's tally of shared
    positional bytes must reach MATCHES, then the overlap is verified exactly. First a list (the texts of a band) meets
    one pivot, that which shares most bands with others, then another one, by hash: of very many near copies nearly all
    are then of one component. Lists that still hold several components and more than LIST texts are split by further
    bands, which two texts of the wanted overlap share as well; then each two texts of a list are tallied, in blocks,
    and a block gives the links that connect its texts, not their pairs. So a list's work is bounded by LIST texts
    each, unless texts agree in DEEP bands and yet not in a component.
    Texts without words are alike to each other only. Documents that share a doc_id may be in different groups. Empty
    in, empty out; very long texts are held one at a time, as hashes of their shingles.
    """
    found = _groups(keyed(texts(df)), similarity, distance)
    return found.select("doc_id", "component_id")


def _fit(a: str, b: str, similarity: float) -> Column:
    """Sets that differ more in size cannot overlap enough."""
    return F.least(a, b) >= F.lit(similarity) * F.greatest(a, b) - 1e-9


def _pivots(left: DataFrame, nodes: DataFrame, score: Column, similarity: float) -> DataFrame:
    """(x, y, xp, yp): the texts of each list (list, node, root) with its pivot, that of the highest score, if of another component."""
    lists = left.groupBy("list").agg(F.max(F.struct(score.alias("score"), "node", "root")).alias("p"), F.count(F.lit(1)).alias("size"))
    lists = lists.select("list", "size", F.col("p.node").alias("x"), F.col("p.root").alias("x_root"))
    pairs = join_back(left.select("list", "node", "root"), lists, "list", "size", left.count()).where("root <> x_root").select("x", F.col("node").alias("y"), "list")
    # the pivot's bytes come with the list, so that a pivot of very many texts never meets them in one task
    known = lists.select("list", "size", "x").join(nodes.select(F.col("node").alias("x"), F.col("n").alias("x_n"), F.col("places").alias("xp")), "x")
    pairs = scratch(pairs.groupBy("x", "y").agg(F.min("list").alias("list")), "pairs")
    pairs = join_back(pairs, known.drop("x"), "list", "size", pairs.count())
    pairs = pairs.join(nodes.select(F.col("node").alias("y"), F.col("n").alias("y_n"), F.col("places").alias("yp")), "y")
    return pairs.where(_fit("x_n", "y_n", similarity))


def _unsettled(left: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows (list, node, ...) of lists that hold several components, with the component as root."""
    left = left.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    left = scratch(left, "lists")
    open_ = left.groupBy("list").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("size")).where("a <> b").select("list", "size")
    return scratch(join_back(left, open_, "list", "size", left.count()).drop("size"), "lists")


def _deeper(left: DataFrame, nodes: DataFrame) -> DataFrame:
    """Lists of at most LIST texts, or of DEEP bands: longer ones are split by each further band. `depth` is the number of bands."""
    depth, done = 1, None
    while True:
        sizes = left.groupBy("list").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("list", "size")
        sized = scratch(join_back(left, sizes, "list", "size", left.count()), "sized")
        fine = (sized if depth == DEEP else sized.where(F.col("size") <= LIST)).withColumn("depth", F.lit(depth))
        done = fine if done is None else done.unionByName(fine)
        long_ = sized.where(F.col("size") > LIST)
        if depth == DEEP or long_.isEmpty():
            return done
        # the further bands behind the last one of the list, so that a choice of bands comes once
        more = long_.join(nodes.select("node", "bands"), "node").select("node", "root", "last", "list", F.posexplode("bands").alias("at", "band")).where("at > last")
        left = scratch(more.select(F.xxhash64("list", "band").alias("list"), "node", "root", F.col("at").alias("last")), "deeper")
        depth += 1


def _candidates(table: pa.Table, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """Places in a block's table: a text and those of other components with which its tally reaches MATCHES.

    A pair that shares DEEP bands or more is met in one list only, that of the first bands it shares: those bands' list
    is split until it is done, so it has one.
    """
    root, n, part = (table.column(c).to_numpy() for c in ("root", "n", "part"))
    p, q, last, depth = (table.column(c)[0].as_py() for c in ("p", "q", "last", "depth"))
    places = np.frombuffer(b"".join(table.column("places").to_pylist()), np.uint8).reshape(len(n), -1)
    bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(n), -1)
    left, right = np.flatnonzero(part == p), np.flatnonzero(part == q)
    across = np.ascontiguousarray(places[right].T)
    for k, i in enumerate(left.tolist()):
        at = k + 1 if p == q else 0
        tally = (across[:, at:] == places[i][:, None]).sum(axis=0, dtype=np.uint8)
        other = right[at:][tally >= MATCHES]
        other = other[(root[other] != root[i]) & (np.minimum(n[other], n[i]) >= similarity * np.maximum(n[other], n[i]) - 1e-9)]
        shared = bands[other] == bands[i]
        yield i, other[(shared.sum(axis=1) < DEEP) | (shared[:, : last + 1].sum(axis=1) == depth)]


def _linked_lists(lists: DataFrame, nodes: DataFrame, packed: DataFrame, similarity: float) -> DataFrame:
    """(x, y): links that connect the texts of each list as all its pairs of the wanted overlap would.

    Each two texts of different components are tallied, in blocks of at most two times LIST texts. A block first says
    which texts have a candidate in it; with these texts it verifies the pairs that its links so far leave in different
    components. Rows out of a block: its texts, then at most one link less than it has components; never its pairs.
    """
    block = ["list", "p", "q"]
    parts = F.greatest(F.lit(1), F.ceil(F.col("size") / LIST)).cast("long")
    at = lists.select("list", "last", "depth", "node", "root", parts.alias("parts"), F.pmod(F.xxhash64("node"), parts).alias("part")).distinct()
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda o: F.struct(F.least("part", o).alias("p"), F.greatest("part", o).alias("q")))
    rows = at.withColumn("pair", F.explode(pair)).select("list", "pair.*", "last", "depth", "node", "root", "part")
    rows = rows.join(nodes.select("node", "n", "places", "bands"), "node")

    def open_(table: pa.Table) -> pa.Table:
        some = np.zeros(table.num_rows, bool)
        for i, other in _candidates(table, similarity):
            some[other] = True
            some[i] |= len(other) > 0
        return table.filter(pa.array(some))

    def link(table: pa.Table) -> pa.Table:
        turn_to("simhash")
        node, data, sets = table.column("node").to_numpy(), table.column("packed"), Sets(KEPT)
        label = np.unique(table.column("root").to_numpy(), return_inverse=True)[1]
        xs, ys = [], []
        for i, other in _candidates(table, similarity):
            for j in other[label[other] != label[i]].tolist():
                if label[i] != label[j] and sets.alike(data[i].as_py(), data[j].as_py(), similarity):
                    label[label == label[j]] = label[i]
                    xs.append(node[i])
                    ys.append(node[j])
        x, y = np.array(xs, np.int64), np.array(ys, np.int64)
        return pa.table({"x": np.minimum(x, y), "y": np.maximum(x, y)})

    # blocks are small and their work is not: they are dealt to all tasks, whatever their bytes
    number = partitions(nodes.sparkSession)
    met = rows.repartition(number, *block).groupBy(*block).applyInArrow(open_, rows.schema)
    return met.join(packed, "node").repartition(number, *block).groupBy(*block).applyInArrow(link, "x long, y long")


def _groups(docs: DataFrame, similarity: float, distance: int) -> DataFrame:
    """(key, doc_id, h, component, component_id) of (key, doc_id, text); component is the smallest key, component_id its doc_id."""
    rows = scratch(marks(docs), "marks")
    data = [*[f"t{i}" for i in range(TABLES)], "n", "bands", "places"]
    nodes = rows.groupBy("text_key").agg(F.min("key").alias("node"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in data])
    nodes = scratch(nodes, "texts")
    number = nodes.count()
    lists = nodes.select("node", F.posexplode("bands").alias("last", "list"))
    sizes = lists.groupBy("list").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = scratch(join_back(lists, sizes, "list", "size", BANDS * number), "shared")
    central = shared.groupBy("node").agg(F.sum("size").alias("score"))
    left = scratch(shared.drop("size").join(central, "node").withColumn("root", F.col("node")), "lists")
    more = close_fingerprints(nodes, distance).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    more = scratch(more, "close")
    for end in "xy":  # the head of a fingerprint may have very many texts
        known = more.groupBy(end).agg(F.count(F.lit(1)).alias("size")).join(nodes.select(F.col("node").alias(end), F.col("n").alias(f"{end}_n"), F.col("places").alias(f"{end}p")), end)
        more = join_back(more, known, end, "size", more.count()).drop("size")
    met = scratch(tallied(more.where(_fit("x_n", "y_n", similarity))), "close")
    wanted = shared.select("node").union(met.select("x")).union(met.select("y")).distinct()
    packed = scratch(packed_texts(docs, wanted), "packed")
    links = scratch(verified(tallied(_pivots(left, nodes, F.col("score"), similarity)).union(met).distinct(), packed, similarity), "links")
    roots = scratch(components(links, "x", "y"), "roots")
    left = _unsettled(left, roots)
    links = scratch(links.union(verified(tallied(_pivots(left, nodes, F.xxhash64("list", "node"), similarity)), packed, similarity)), "links")
    roots = scratch(components(links, "x", "y"), "roots")
    left = _unsettled(left, roots).select("list", "node", "root", "last")
    links = links.union(_linked_lists(_deeper(left, nodes), nodes, packed, similarity))
    roots = components(scratch(links, "links"), "x", "y")
    names = rows.select("key", F.col("doc_id").alias("component_id")).distinct()
    named = nodes.join(roots, "node", "left").select("text_key", "copies", F.coalesce("root", "node").alias("component"))
    # the smallest keys of components are few beside the texts that name them: counted, then told to them
    firsts = named.groupBy("component").agg(F.count(F.lit(1)).alias("size")).join(names.withColumnRenamed("key", "component"), "component")
    named = scratch(named, "named")
    named = scratch(join_back(named, firsts, "component", "size", number), "named").select("text_key", "copies", "component", "component_id")
    return join_back(rows.select("key", "doc_id", "h", "text_key"), named, "text_key", "copies", rows.count()).select("key", "doc_id", "h", "component", "component_id")


def keep_one(df: DataFrame, similarity: float = SIMILARITY, distance: int = DISTANCE) -> DataFrame:
    """df with one document of each group, that of the smallest doc_id, all columns kept; rows without a doc_id stay.

    A document given twice (equal doc_id and text) stays once.
    """
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    found = scratch(_groups(keyed(texts(df)), similarity, distance), "groups")
    gone = found.where("key <> component").select("doc_id", "h").distinct()
    out = row.join(gone, ["doc_id", "h"], "left_anti")
    if not found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        known = out.where("doc_id is not null").dropDuplicates(["doc_id", "h"])
        out = known.unionByName(out.where("doc_id is null"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in df.columns])
