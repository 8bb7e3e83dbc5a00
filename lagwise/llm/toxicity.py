r"""Toxicity by weak supervision.

1. Lexicons: words and word beginnings that the fitting rows' toxic documents hold far more often than the others
   (document counts over a bounded sample of labelled rows; likelihood-ratio test).
2. Voters: entries are dealt to lexicons by how much more often toxic documents hold them (three tiers of three); each
   lexicon votes on a text that has a hit, and so do pattern voters. Every voter casts a vote on every document, and the
   whole corpus's votes are counted by their pattern (2^voters at most).
3. Label model: a mixture of two classes with an accuracy for each voter and class, fitted to those counts by
   expectation-maximisation that starts from, and is held near, the rates on labelled rows. Voters that agree within a
   class more than independent ones would count for less.
4. Classifier: logistic regression on counts of lexicon hits and of patterns, fitted to posterior labels of two bounded
   samples: labelled rows, whose given label is one more voter of accuracy GIVEN, and rows without a label, whose
   posterior is the label model's alone; it scores every whole text.

Labels come from fitting rows only (crc32 of the doc_id as text, modulo 5, is not 0). A document with several labels is
toxic if one says so; null labels do not count. Null and empty texts get the score of a text without hits. Without
labelled rows of both classes every score is the share of toxic ones (0 without labels). Rows of equal doc_id are scored
each for itself; a null doc_id is scored too and held out. No rows: none.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, scratch, slices, turn_to

#: Labelled rows for lexicons and classifier, at most (those whose id hashes lowest).
SAMPLE = 20_000
#: Passes over all fitting rows' posteriors, size of a step, and their weight beside the labelled rows'.
PASSES, STEP, SHARE = 10, 0.03, 0.5
#: Entries of all lexicons together, at most; the best by likelihood ratio.
ENTRIES = 4_000
#: Least likelihood ratio (G squared) of an entry, and least ratio of its rates.
LEAST_G, LEAST_RATIO = 10.0, 4.0
BEGINNINGS = (4, 5, 6)
#: Least ratio of rates of the upper tiers; lexicons in each.
TIERS, IN_TIER = (50.0, 15.0), 3
LEXICONS = (len(TIERS) + 1) * IN_TIER
#: Accuracy of a given label as a voter.
GIVEN = 0.98
FOLDS = 5
WORD = re.compile(r"\w+")
SHOUT = re.compile(r"\b[A-Z]{4,}\b")
MASKED = re.compile(r"\w[*@#$]{2,}\w|[!?]{3,}")
#: Pattern voters: hits of two entries, of two lexicons, three hits or more, a hit in every hundred words, shouting, masked words and marks.
PATTERNS = 6
VOTERS = LEXICONS + PATTERNS
#: Inputs of the classifier beside the entries: different entries hit, hits, shouting and masked words in a hundred.
INPUTS = 4
ROUNDS = 50
#: Weight of the labelled rows' rates against the corpus's in the label model, as a share of all documents.
HOLD = 0.2
RIDGE = 1e-3


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(FOLDS))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 0, F.lit(True))


def features(text: str | None) -> tuple[Counter, int]:
    """Counts of the text's words and of their beginnings (marked with a final *), and the number of words."""
    words = Counter(WORD.findall((text or "").lower()))
    out, n = Counter(words), 0
    for w, k in words.items():
        n += k
        for b in BEGINNINGS:
            if len(w) >= b:
                out[w[:b] + "*"] += k
    return out, n


@dataclass
class Lexicon:
    """entries: from entry to its number; ratios: how much more often toxic documents hold each."""

    entries: dict[str, int]
    ratios: np.ndarray

    def __post_init__(self) -> None:
        tier = sum((self.ratios < t).astype(int) for t in TIERS)
        self.of = tier * IN_TIER + np.arange(len(self.ratios)) % IN_TIER  # each entry's lexicon

    def hits(self, text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
        """Entries hit, how often, and the number of words."""
        entries, found, n = self.entries, {}, 0
        get = entries.get
        for w, k in Counter(WORD.findall((text or "").lower())).items():
            n += k
            if (i := get(w)) is not None:
                found[i] = found.get(i, 0) + k
            for b in BEGINNINGS:
                if len(w) >= b and (i := get(w[:b] + "*")) is not None:
                    found[i] = found.get(i, 0) + k
        return np.fromiter(found, np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found)), n

    def votes(self, text: str | None) -> tuple[int, np.ndarray, np.ndarray]:
        """The voters that vote, as bits, and the classifier's inputs: which are not zero, and their values."""
        at, k, n = self.hits(text)
        lexicons = set(self.of[at].tolist())
        text = text or ""
        shouts, masks = len(SHOUT.findall(text)), len(MASKED.findall(text))
        patterns = (len(at) >= 2, len(lexicons) >= 2, k.sum() >= 3, k.sum() * 100 >= n > 0 and len(at) > 0, shouts >= 3, masks > 0)
        bits = sum(1 << i for i in lexicons) | sum(1 << LEXICONS + j for j, yes in enumerate(patterns) if yes)
        more = np.array([len(at), 100 * k.sum() / max(n, 1), 100 * shouts / max(n, 1), 100 * masks / max(n, 1)], float)
        size = len(self.entries)
        return bits, np.append(at, np.arange(size, size + INPUTS)), np.log1p(np.append(k, more))


def fitting_sample(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic) of at most `bound` labelled rows that are not held out. Their ids, so few, are broadcast; texts stay."""
    id_ = F.col("doc_id").cast("long").alias("doc_id")
    known = labels.where("doc_id is not null and toxic is not null").groupBy(id_).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return docs.select(id_, "text").join(F.broadcast(chosen), "doc_id")


def voted(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, held_out, votes, at, x): each text's votes, and the classifier's inputs that are not zero. One pass over the texts, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("toxicity")
        for batch in slices(batches):
            rows = [lexicon.votes(t.as_py()) for t in batch.column("text")]
            lists = [pa.array([r[i].tolist() for r in rows], pa.list_(t)) for i, t in ((1, pa.int32()), (2, pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([r[0] for r in rows], pa.int64()), *lists], names=["doc_id", "held_out", "votes", "at", "x"])

    ids = F.col("doc_id").cast("long").alias("doc_id")
    rows = docs.select(ids, held_out(F.col("doc_id")).alias("held_out"), "text")
    return scratch(rows.mapInArrow(run, "doc_id long, held_out boolean, votes long, at array<int>, x array<double>"), "votes")


def find_entries(sample: DataFrame, entries: int = ENTRIES) -> tuple[Lexicon, int, int]:
    """The lexicon, and the numbers of toxic and other documents in the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                for e in ["", *features(text.as_py())[0]]:
                    count.setdefault(e, [0, 0])[1 if toxic else 0] += 1
            n = np.array(list(count.values()), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(n[:, 1]), pa.array(n[:, 0])], names=["entry", "p", "n"])

    counts = sample.mapInArrow(run, "entry string, p long, n long").groupBy("entry").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    counts = scratch(counts.where("p >= 3"), "entries")
    try:
        whole = counts.where("entry = ''").first()
        rest = counts.where("entry <> ''")
        if whole is None:
            return Lexicon({}, np.zeros(0)), 0, sample.count()
        toxic, clean = whole["p"], whole["n"]
        if not clean:
            return Lexicon({}, np.zeros(0)), toxic, 0
        x = lambda k, n, of: f"(case when {k} > 0 then {k} * ln({k} * {toxic + clean} / (({k} + {n}) * {of})) else 0 end)"
        g = f"2 * ({x('p', 'n', f'{toxic}.0D')} + {x('n', 'p', f'{clean}.0D')} + {x(f'({toxic} - p)', f'({clean} - n)', f'{toxic}.0D')} + {x(f'({clean} - n)', f'({toxic} - p)', f'{clean}.0D')})"
        rest = rest.where(f"p / {toxic}.0D >= {LEAST_RATIO} * n / {clean}.0D").withColumn("g", F.expr(g)).where(f"g >= {LEAST_G}")
        best = rest.orderBy(F.desc("g"), "entry").select("entry", "p", "n").limit(entries).collect()
    finally:
        drop(counts)
    ratios = np.array([(r["p"] + 0.5) / (toxic + 1) / ((r["n"] + 0.5) / (clean + 1)) for r in best])
    return Lexicon({r["entry"]: i for i, r in enumerate(best)}, ratios), toxic, clean


@dataclass
class LabelModel:
    """prior of toxic, rates (2 x VOTERS) of a vote by class, and each voter's weight (1: independent)."""

    prior: float
    rates: np.ndarray
    weights: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Of rows of 0/1 votes."""
        yes = np.log(self.rates[1] / self.rates[0]) * self.weights
        no = np.log((1 - self.rates[1]) / (1 - self.rates[0])) * self.weights
        return 1 / (1 + np.exp(-np.clip(votes @ (yes - no) + no.sum() + np.log(self.prior / (1 - self.prior)), -50, 50)))


def bits(votes: np.ndarray) -> np.ndarray:
    return (votes[:, None] >> np.arange(VOTERS) & 1).astype(float)


def fit_label_model(votes: np.ndarray, count: np.ndarray, sure: np.ndarray, toxic: np.ndarray) -> LabelModel:
    """From the corpus's vote patterns and their counts, and the votes and labels of labelled rows."""
    v, w = bits(votes), count / count.sum()
    s = bits(sure)
    start = np.stack([(s[toxic == y].sum(axis=0) + 0.5) / ((toxic == y).sum() + 1) for y in (0, 1)])
    share = float(np.clip(toxic.mean(), 0.01, 0.99))
    model = LabelModel(share, start, np.ones(VOTERS))
    held = np.array([1 - share, share]) * HOLD
    for _ in range(ROUNDS):
        p = model.posterior(v)
        mass = np.stack((w * (1 - p), w * p))
        rates = (mass @ v + held[:, None] * start) / (mass.sum(axis=1) + held)[:, None]
        model = LabelModel(float(np.clip((mass[1].sum() + held[1]) / (1 + HOLD), 1e-3, 0.999)), np.clip(rates, 1e-4, 1 - 1e-4), model.weights)
        # correlation of each pair within the classes; a voter that repeats others counts for its share only
        excess = np.zeros((VOTERS, VOTERS))
        for m, r in zip(mass, model.rates, strict=True):
            c = v - r
            cov = (c * m[:, None]).T @ c / max(m.sum(), 1e-9)
            sd = np.sqrt(np.maximum(r * (1 - r), 1e-6))
            excess += m.sum() * np.maximum(cov / np.outer(sd, sd), 0)
        np.fill_diagonal(excess, 0)
        model.weights = 1 / (1 + np.minimum(excess, 1).sum(axis=1))
    return model


def fit_classifier(at: list[np.ndarray], k: list[np.ndarray], target: np.ndarray, entries: int) -> tuple[np.ndarray, float]:
    """Weights of the inputs and the constant of a logistic regression by gradient steps."""
    rows = np.repeat(np.arange(len(at)), [len(a) for a in at])
    cols = np.concatenate(at) if at else np.zeros(0, np.int64)
    vals = np.concatenate(k) if at else np.zeros(0)
    n = len(at)
    rate = float(np.clip(target.mean(), 1e-3, 1 - 1e-3))
    w, b = np.zeros(entries), float(np.log(rate / (1 - rate)))
    mw, vw, mb, vb = np.zeros(entries), np.zeros(entries), 0.0, 0.0
    for t in range(1, 401):  # Adam on the whole sample
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, weights=vals * w[cols], minlength=n) + b, -50, 50)))
        e = (p - target) / n
        gw, gb = np.bincount(cols, weights=vals * e[rows], minlength=entries) + RIDGE / n * w, e.sum()
        mw, vw = 0.9 * mw + 0.1 * gw, 0.999 * vw + 0.001 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        step = 0.1 * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w -= step * mw / (np.sqrt(vw) + 1e-8)
        b -= step * mb / (np.sqrt(vb) + 1e-8)
    return w, b


@dataclass
class Scorer:
    lexicon: Lexicon
    weights: np.ndarray
    constant: float

    def score(self, text: str | None) -> float:
        z = self.constant
        if len(self.weights):
            _, at, x = self.lexicon.votes(text)
            z = x @ self.weights[at] + z
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    """An Arrow column of lists as arrays, views of one."""
    a = column.combine_chunks()
    return np.split(a.flatten().to_numpy(), np.cumsum(pc.list_value_length(a).to_numpy())[:-1]) if len(a) else []


def _slopes(rows: DataFrame, model: LabelModel, w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
    """The mean slope of the loss on the posteriors of all rows, by weight, and that of the constant."""
    size = len(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 2)
        for batch in batches:
            if not batch.num_rows:
                continue
            at, x = (batch.column(c).flatten().to_numpy() for c in ("at", "x"))
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column("at")).to_numpy())
            z = np.bincount(row, weights=x * w[at], minlength=batch.num_rows) + b
            e = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - model.posterior(bits(batch.column("votes").to_numpy()))
            total[:size] += np.bincount(at, weights=x * e[row], minlength=size)
            total[size] += e.sum()
            total[size + 1] += batch.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["i", "v"])

    out = np.zeros(size + 2)
    for r in rows.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # a row an input
        out[r["i"]] = r["v"]
    n = max(out[size + 1], 1.0)
    return out[:size] / n, out[size] / n


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, entries: int = ENTRIES) -> tuple[Scorer, DataFrame | None]:
    """The classifier, and the table of votes and inputs of docs (None without a lexicon).

    The label model is fitted to the vote patterns of all documents. The classifier is fitted to the posteriors of the
    labelled sample, whose labels are one more voter, and then to these and the posteriors of all rows that are not held
    out, in PASSES over the table of inputs.
    """
    sample = fitting_sample(docs, labels, bound)
    lexicon, toxic, clean = find_entries(sample, entries)
    share = toxic / (toxic + clean) if toxic + clean else 0.0
    if not lexicon.entries:
        return Scorer(lexicon, np.zeros(0), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))), None
    table = voted(docs, lexicon)
    corpus = table.groupBy("votes").agg(F.count(F.lit(1)).alias("n"))
    patterns = np.array([tuple(r) for r in corpus.collect()], np.int64).reshape(-1, 2)  # 2^VOTERS rows at most
    known = sample.select("doc_id", "toxic").distinct()
    rows = table.join(F.broadcast(known), "doc_id").select("votes", "at", "x", "toxic").toArrow().combine_chunks()  # the bound at most, but for repeated ids
    votes, toxic_ = rows["votes"].to_numpy(), rows["toxic"].to_numpy() > 0
    model = fit_label_model(patterns[:, 0], patterns[:, 1].astype(float), votes, toxic_.astype(int))
    odds = model.posterior(bits(votes))
    odds = odds / np.maximum(1 - odds, 1e-12) * np.where(toxic_, GIVEN / (1 - GIVEN), (1 - GIVEN) / GIVEN)
    target, size = odds / (1 + odds), len(lexicon.entries) + INPUTS
    at, x = _lists(rows["at"]), _lists(rows["x"])
    w, b = fit_classifier(at, x, target, size)
    row, at, x = np.repeat(np.arange(len(at)), [len(a) for a in at]), np.concatenate(at), np.concatenate(x)
    others = table.where("not held_out").select("votes", "at", "x")
    m, v, n = np.zeros(size + 1), np.zeros(size + 1), max(len(target), 1)
    for t in range(1, PASSES + 1):
        slope, first = _slopes(others, model, w, b)
        e = (1 / (1 + np.exp(-np.clip(np.bincount(row, weights=x * w[at], minlength=len(target)) + b, -50, 50))) - target) / n
        own = np.bincount(at, weights=x * e[row], minlength=size) + RIDGE / n * w
        g = np.append(own + SHARE * slope, e.sum() + SHARE * first)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        move = STEP * np.sqrt(1 - 0.999**t) / (1 - 0.9**t) * m / (np.sqrt(v) + 1e-8)
        w, b = w - move[:size], b - move[size]
    return Scorer(lexicon, w, float(b)), table


def score(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, entries: int = ENTRIES) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    scorer, table = fit(docs, labels, bound, entries)
    w, b = scorer.weights, scorer.constant
    if table is None:
        ids = F.col("doc_id").cast("long").alias("doc_id")
        flat = 1 / (1 + np.exp(-b))
        return docs.select(ids, held_out(F.col("doc_id")).alias("held_out"), F.lit(float(flat)).alias("score"), F.lit(int(flat >= 0.5)).alias("predicted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = (batch.column(c).flatten().to_numpy() for c in ("at", "x"))
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column("at")).to_numpy()) if batch.num_rows else np.zeros(0, np.int64)
            z = np.bincount(row, weights=x * w[at], minlength=batch.num_rows) + b
            s = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return table.select("doc_id", "held_out", "at", "x").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, entries: int = ENTRIES) -> DataFrame:
    """The rows of docs whose text scores below 0.5, all columns kept."""
    scorer, table = fit(docs, labels, bound, entries)
    drop(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("toxicity")
        for batch in slices(batches):
            yield batch.filter(pa.array([scorer.score(t.as_py()) < 0.5 for t in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
