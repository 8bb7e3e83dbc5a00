"""Links between embeddings by cosine, through inverted lists of product-quantised residuals.

A vector is at home in the list of its nearest coarse centroid; its residual is kept as one code a subspace, with the
length of what the codes leave out. A query probes lists of near centroids: there a table of its distances to all codes
gives its distance to each stored vector but for that length, so what lies beyond the bound cannot link and goes; the
rest is compared exactly. How many lists are probed is measured when the index is fitted: of pairs exactly at the
threshold, in directions that the data have, all but MISSED must meet in a list that one of them probes.

Very many vectors close to each other must not be compared one by one. Lists are cut into blocks; in a block, vectors
within half the threshold's angle of a pivot become its ball. Members of a ball are linked to each other without
comparing, and only balls enter the index: of two balls the angle of the pivots tells whether all their members link or
none does; only in between are their members compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, join_back, scratch
from .components import components

SIMILARITY = 0.9
#: Vectors, dealt by hash, that the index is fitted on; the largest number of lists; subspaces and codes of one.
FIT, LISTS, SUBSPACES, CODES = 1 << 14, 1 << 12, 16, 256
#: Share of the pairs at the threshold that may meet in no list.
MISSED = 0.001
#: Vectors of a list's block, and queries that meet it at a time.
BLOCK, QUERIES = 1 << 11, 1 << 13
#: What angles and distances may be off by rounding; pairs nearer than this to a bound are compared exactly.
SLACK = 1e-6
#: Pairs compared at a time.
TOGETHER = 1 << 16


def stored(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, h, v): the entries as bytes and their hash; both null where the vector links with nothing."""
    single = isinstance(df.schema[vector].dataType, T.ArrayType) and isinstance(df.schema[vector].dataType.elementType, T.FloatType)
    kind = "<f4" if single else "<f8"
    v = F.col(vector) if single else F.col(vector).cast("array<double>")
    good = v.isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))) & F.exists(v, lambda c: c != 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [r.values.to_numpy(zero_copy_only=False).astype(kind).tobytes() if r.is_valid else None for r in batch.column("v")]
            hashes = [None if x is None else xxhash.xxh3_128_hexdigest(x) for x in data]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(hashes, pa.string()), pa.array(data, pa.binary())], names=["vec_id", "h", "v"])

    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), F.when(good, v).alias("v"))
    return rows.mapInArrow(run, "vec_id long, h string, v binary")


def matrix(column: pa.Array | pa.ChunkedArray, d: int, kind: str) -> np.ndarray:
    """The vectors, at unit length; shorter ones end in zeros."""
    data = column.to_pylist()
    out = np.zeros((len(data), d))
    size = d * int(kind[-1])
    if all(len(x) == size for x in data):
        out[:] = np.frombuffer(b"".join(data), kind).reshape(len(data), d)
    else:
        for i, x in enumerate(data):
            row = np.frombuffer(x, kind)
            out[i, : len(row)] = row
    out /= np.abs(out).max(axis=1, initial=0, keepdims=True)  # lest squares overflow
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each row of a with that of b; the same either way round."""
    return np.einsum("ij,ij->i", a, b)


def _means(x: np.ndarray, k: int, random: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """k-means."""
    c = x[random.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _near(x, c)
        size = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[size > 0] = total[size > 0] / size[size > 0, None]
    return c


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances but for the square of x."""
    return (c * c).sum(axis=1) - 2 * (x @ c.T)


def _near(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([_distances(x[i : i + 4096], c).argmin(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


class Index:
    """Coarse centroids, codebooks, and the number of lists to probe."""

    def __init__(self, sample: np.ndarray, lists: int, similarity: float) -> None:
        random = np.random.default_rng(11)
        n, d = sample.shape
        self.coarse = _means(sample, min(lists, n), random)
        rest = sample - self.coarse[_near(sample, self.coarse)]
        self.cuts = np.array_split(np.arange(d), min(SUBSPACES, d))
        self.books = [_means(rest[:, cut], min(CODES, n), random) for cut in self.cuts]
        self.probes = self._probes(sample, similarity, random)

    def _probes(self, sample: np.ndarray, similarity: float, random: np.random.Generator) -> int:
        x, s = sample[random.integers(0, len(sample), 8192)], sample[random.integers(0, len(sample), 8192)]
        across = s - cosines(s, x)[:, None] * x
        length = np.sqrt(cosines(across, across))
        x, across = x[length > 1e-3], across[length > 1e-3] / length[length > 1e-3, None]
        if not len(x):
            return len(self.coarse)
        y = similarity * x + math.sqrt(1 - similarity**2) * across
        ranks = []
        for i in range(0, len(x), 1024):
            a, b = _distances(x[i : i + 1024], self.coarse), _distances(y[i : i + 1024], self.coarse)
            at = np.arange(len(a))
            one = (a < a[at, b.argmin(axis=1)][:, None]).sum(axis=1)
            ranks.append(np.minimum(one, (b < b[at, a.argmin(axis=1)][:, None]).sum(axis=1)))
        return int(np.quantile(np.concatenate(ranks), 1 - MISSED, method="higher")) + 1

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lists to probe, the nearest first; codes; and the length of what these leave out."""
        d = _distances(x, self.coarse)
        near = np.argsort(d, axis=1, kind="stable")[:, : self.probes]
        rest = x - self.coarse[near[:, 0]]
        codes = np.stack([_near(rest[:, cut], book) for cut, book in zip(self.cuts, self.books, strict=True)], axis=1).astype(np.uint8)
        for m, (cut, book) in enumerate(zip(self.cuts, self.books, strict=True)):
            rest[:, cut] -= book[codes[:, m]]
        return near, codes, np.sqrt(cosines(rest, rest))

    def within(self, q: np.ndarray, home: int, codes: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of a query and a vector of the list `home` whose distance by table is at most `bound` (query, vector)."""
        rest = q - self.coarse[home]
        total = np.zeros((len(q), len(codes)), np.float32)
        total += (rest * rest).sum(axis=1, keepdims=True)
        for m, (cut, book) in enumerate(zip(self.cuts, self.books, strict=True)):
            table = _distances(rest[:, cut], book).astype(np.float32)
            total += table[:, codes[:, m]]
        return np.nonzero(np.sqrt(np.maximum(total, 0)) <= bound)


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the links (a, b) connect: each node to the smallest that it reaches."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, left, label[right])
        np.minimum.at(new, right, label[left])
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(int(nodes[i]), int(nodes[label[i]])) for i in np.flatnonzero(label != np.arange(len(nodes)))]


_OUT = "kind int, a long, b long"
_CREDIT, _LINK, _PAIR = 0, 1, 2


def _table(credit: dict[int, int], links: list[tuple[int, int]], pairs: list[tuple[int, int]]) -> pa.Table:
    rows = [*((_CREDIT, k, n) for k, n in credit.items()), *((_LINK, *x) for x in links), *((_PAIR, *x) for x in pairs)]
    columns = list(zip(*rows, strict=True)) or [[]] * 3
    return pa.table([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["kind", "a", "b"])


def _credits(credit: dict[int, int], nodes: np.ndarray, values: np.ndarray) -> None:
    keys, at = np.unique(nodes, return_inverse=True)
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, at, values)
    for k, n in zip(keys.tolist(), sums.tolist(), strict=True):
        credit[k] = credit.get(k, 0) + n


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", similarity: float = SIMILARITY, lists: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept): links between vectors whose cosine is `similarity` or more.

    A row without a key is left out. A vector that is null, empty, all zeros, or holds a null or no finite number links
    with nothing. A shorter vector counts as one that ends in zeros. Rows that share a key are vectors of their own;
    equal vectors link. component_id is the smallest key that links reach; kept where it is the row's own. Empty in,
    empty out. Other columns are not read. Every link is exact; those at the threshold may be missed where no probed
    list holds them, see MISSED.
    """
    spark = df.sparkSession
    kind = "<f4" if isinstance(getattr(df.schema[vector].dataType, "elementType", None), T.FloatType) else "<f8"
    rows = scratch(stored(df, key, vector), "vectors")
    total, width = rows.agg(F.count("h"), F.max(F.length("v"))).first()
    alone = rows.where("h is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not total:
        return alone
    d = width // int(kind[-1])
    nodes = rows.where("h is not null").groupBy("h").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("cnt"), F.first("v").alias("v"))
    nodes = scratch(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    number = nodes.count()
    sample = nodes.orderBy("h").limit(FIT).select("v").toArrow()
    lists = lists or min(LISTS, max(16, 1 << math.ceil(math.log2(math.sqrt(number)))))
    index = spark.sparkContext.broadcast(Index(matrix(sample.column("v"), d, kind), min(lists, sample.num_rows), similarity))
    wide, half = math.acos(similarity), math.acos(similarity) / 2 - SLACK

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, codes, left = index.value.encode(matrix(batch.column("v"), d, kind))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("cnt"), batch.column("v"), pa.array(near[:, 0].astype(np.int32)), pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32())), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(left)],
                names=["node", "cnt", "v", "home", "probes", "codes", "beyond"],
            )

    coded = scratch(nodes.select("node", "cnt", "v").mapInArrow(encode, "node long, cnt long, v binary, home int, probes array<int>, codes binary, beyond double"), "codes")
    blocks = _blocks(coded.groupBy("home").agg(F.count(F.lit(1)).alias("n")), BLOCK)

    def balls(table: pa.Table) -> pa.Table:
        x = matrix(table.column("v"), d, kind)
        nodes, counts = table.column("node").to_numpy(), table.column("cnt").to_numpy()
        pivot, angle = np.full(len(x), -1), np.zeros(len(x))
        for i in np.argsort(nodes):
            if pivot[i] < 0:
                free = np.flatnonzero(pivot < 0)
                to = np.arccos(np.clip(cosines(x[free], x[i : i + 1]), -1, 1)) if len(free) else np.zeros(0)
                mine = free[to <= half]
                pivot[mine], angle[mine] = i, to[to <= half]
                pivot[i], angle[i] = i, 0.0
        radius, mass = np.zeros(len(x)), np.zeros(len(x), np.int64)
        np.maximum.at(radius, pivot, angle)
        np.add.at(mass, pivot, counts)
        more = {"pivot": pa.array(nodes[pivot]), "radius": pa.array(radius[pivot]), "mass": pa.array(mass[pivot])}
        for name, column in more.items():
            table = table.append_column(name, column)
        return table.select(["node", "cnt", "v", "home", "probes", "codes", "beyond", "pivot", "radius", "mass"])

    blocked = coded.join(F.broadcast(blocks), "home").withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")))
    schema = "node long, cnt long, v binary, home int, probes array<int>, codes binary, beyond double, pivot long, radius double, mass long"
    members = scratch(blocked.select("home", "block", "node", "cnt", "v", "probes", "codes", "beyond").groupBy("home", "block").applyInArrow(balls, schema), "members")
    pivots = members.where("node = pivot")
    # a list's vectors in blocks, and the queries that probe it in blocks: each block meets each
    asked = pivots.selectExpr("node as q", "v as qv", "radius as qr", "mass as qm", "home as from", "explode(probes) as home")
    sizes = _blocks(pivots.groupBy("home").agg(F.count(F.lit(1)).alias("n")), BLOCK).withColumnRenamed("parts", "held")
    sizes = F.broadcast(sizes.join(_blocks(asked.groupBy("home").agg(F.count(F.lit(1)).alias("n")), QUERIES), "home"))
    part = lambda node, of: F.pmod(F.xxhash64(node, F.lit(1)), F.col(of)).alias(of)
    all_of = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1)).alias(of)
    kept = pivots.join(sizes, "home").select("home", part("node", "held"), "parts", "node", "v", "radius", "mass", "probes", "codes", "beyond").withColumn("parts", all_of("parts"))
    asked = asked.join(sizes, "home").select("home", part("q", "parts"), "held", "q", "qv", "qr", "qm", "from").withColumn("held", all_of("held"))

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table({}, [], [])
        y, q = matrix(left.column("v"), d, kind), matrix(right.column("qv"), d, kind)
        codes = np.frombuffer(b"".join(left.column("codes").to_pylist()), np.uint8).reshape(len(y), -1)
        yn, ym, yr, beyond = (left.column(c).to_numpy() for c in ("node", "mass", "radius", "beyond"))
        qn, qm, qr, home = (right.column(c).to_numpy() for c in ("q", "qm", "qr", "from"))
        probed = left.column("probes").combine_chunks()
        probed = probed.flatten().to_numpy().reshape(len(y), -1)
        credit: dict[int, int] = {}
        links, pairs = [], []
        for at in range(0, len(q), 512):
            some = slice(at, at + 512)
            reach = np.minimum(wide + qr[some, None] + yr[None], math.pi)
            i, j = index.value.within(q[some], key[0].as_py(), codes, (2 * np.sin(reach / 2) + beyond + 1e-4).astype(np.float32))
            i += at
            i, j = i[qn[i] != yn[j]], j[qn[i] != yn[j]]
            for k in range(0, len(i), TOGETHER):
                a, b = i[k : k + TOGETHER], j[k : k + TOGETHER]
                cosine = cosines(q[a], y[b])
                angle, spread = np.arccos(np.clip(cosine, -1, 1)), qr[a] + yr[b]
                whole = np.where(spread == 0, cosine >= similarity, angle + spread <= wide - SLACK)
                part_ = ~whole & (spread > 0) & (angle - spread <= wide + SLACK)
                again = (probed[b] == home[a][:, None]).any(axis=1)  # the pair is met the other way round too
                a1, b1 = a[whole], b[whole]
                _credits(credit, qn[a1], ym[b1])
                once = whole & ~again
                _credits(credit, yn[b[once]], qm[a[once]])
                if len(a1):
                    links += _forest(qn[a1], yn[b1])
                one = part_ & (~again | (qn[a] < yn[b]))
                pairs += zip(qn[a[one]].tolist(), yn[b[one]].tolist(), strict=True)
        return _table(credit, links, pairs)

    met = scratch(kept.groupBy("home", "held", "parts").cogroup(asked.groupBy("home", "held", "parts")).applyInArrow(meet, _OUT), "met")

    def compare(table: pa.Table) -> pa.Table:
        x = matrix(table.column("v"), d, kind)
        nodes, counts, side = (table.column(c).to_numpy() for c in ("node", "cnt", "side"))
        credit: dict[int, int] = {}
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        found = False
        step = max(1, TOGETHER // max(1, len(right)))
        for at in range(0, len(left), step):
            a, b = (g.ravel() for g in np.meshgrid(left[at : at + step], right, indexing="ij"))
            linked = cosines(x[a], x[b]) >= similarity
            a, b = a[linked], b[linked]
            found |= bool(len(a))
            _credits(credit, nodes[a], counts[b])
            _credits(credit, nodes[b], counts[a])
        return _table(credit, [(table.column("p")[0].as_py(), table.column("q")[0].as_py())] if found else [], [])

    pairs = met.where(F.col("kind") == _PAIR).select(F.col("a").alias("p"), F.col("b").alias("q")).distinct()
    sides = pairs.select("p", "q", F.lit(0).alias("side"), F.col("p").alias("pivot")).union(pairs.select("p", "q", F.lit(1), F.col("q")))
    closer = sides.join(members.select("pivot", "node", "cnt", "v"), "pivot").select("p", "q", "side", "node", "cnt", "v")
    closer = scratch(closer.groupBy("p", "q").applyInArrow(compare, _OUT), "closer")
    sums = lambda t, name: t.where(F.col("kind") == _CREDIT).groupBy(F.col("a").alias(name)).agg(F.sum("b").alias(f"{name}_links"))
    links = met.where(F.col("kind") == _LINK).union(closer.where(F.col("kind") == _LINK)).select("a", "b")
    roots = scratch(components(links, "a", "b"), "roots")
    known = members.select("node", "pivot", "mass").join(nodes.select("node", "first"), "node")
    known = known.join(sums(met, "pivot"), "pivot", "left").join(sums(closer, "node"), "node", "left").join(roots.withColumnRenamed("node", "pivot"), "pivot", "left")
    known = known.select("node", "first", (F.col("mass") - 1 + F.coalesce("pivot_links", F.lit(0)) + F.coalesce("node_links", F.lit(0))).alias("n_links"), F.coalesce("root", "pivot").alias("root"))
    known = scratch(known, "known")
    lowest = known.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = join_back(known, lowest, "root", "n", number).select("node", "n_links", "component_id")
    named = scratch(nodes.select("node", "h", "cnt").join(named, "node").select("h", "cnt", "n_links", "component_id"), "named")
    drop(coded, members, met, closer, roots, known, nodes)
    linked = join_back(rows.where("h is not null").select("vec_id", "h"), named, "h", "cnt", total)
    return linked.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")).union(alone)


def _blocks(sizes: DataFrame, most: int) -> DataFrame:
    """(home, parts): in how many blocks a list's n rows are cut; there are at most LISTS lists."""
    return sizes.select("home", F.ceil(F.col("n") / most).cast("long").alias("parts"))
