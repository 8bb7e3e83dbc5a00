import hashlib
import random

import numpy as np
import pyarrow as pa

from lagwise.llm import substrings

SCHEMA = "doc_id long, text string, places string"


def brute(rows, window):
    seen, out = {}, {}
    for d, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        ws = (text or "").encode().split()
        gone = set()
        for i in range(len(ws) - window + 1):
            key = tuple(ws[i : i + window])
            if seen.setdefault(key, (d, i)) != (d, i):
                gone.update(range(i, i + window))
        kept = [w for i, w in enumerate(ws) if i not in gone]
        out[d] = (len(ws), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def sample():
    r = random.Random(7)
    vocabulary = ["a", "b", "c", "dé", "e,"]
    base = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    passage = " ".join(f"w{i}" for i in range(70))
    rows += [(100 + i, f"{r.choice(base)} {passage} {r.choice(base)}") for i in range(12)]
    rows += [(200 + i, base[3]) for i in range(9)]
    rows += [(300, None), (301, ""), (302, " \n\t"), (303, "x " * 200), (304, "x"), (305, "x y\x1cz " * 25), (None, passage)]
    return rows


def test_brute_force(spark):
    rows = sample()
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA)
    for window in (4, 20, 7):
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.digests(df, window).collect()}
        assert got == brute(rows, window)


def test_rows_that_share_a_doc_id(spark):
    """Their texts are documents of their own; equal ones are one document."""
    one, other = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    rows = [(1, one), (1, other), (1, one), (2, one), (3, "x " + other)]
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, key string")
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substrings.digests(df).collect())
    assert got == [(1, 30, 0), (1, 30, 0), (1, 30, 0), (2, 30, 30), (3, 31, 30)]


def test_levels_and_a_passage_that_half_the_documents_hold(spark):
    assert substrings.levels(20) == [5, 10] and substrings.levels(7) == [] and substrings.levels(16) == [4, 8]
    r = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(30)) + (f" {passage} " if i % 2 else "") + "end of it") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in substrings.digests(df).collect()}
    assert got == brute(rows, 20) and sum(n for _, n, _ in got.values()) == 199 * 28


def test_empty_table_and_texts(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert substrings.digests(empty).count() == 0
    one = spark.createDataFrame([(1, "a b c", "x")], SCHEMA)
    assert [tuple(r) for r in substrings.dedup_words(one).collect()] == [(1, 3, 0, "a b c")]


def test_passages_double(spark):
    passage = " ".join(f"w{i}" for i in range(90))
    df = spark.createDataFrame([(1, passage), (2, "q " + passage), (3, "r s")], "doc_id long, text string")
    rows = substrings.passages(df, 20).collect()
    assert {r["length"] for r in rows} == {20, 40, 80}
    assert sum(r["length"] == 80 for r in rows) == 22 and sum(r["length"] == 20 for r in rows) == 142


def test_words_of_many_texts_at_once():
    """Neighbouring texts share no word, and words of any length have hashes of their own."""
    texts = ["ab", "", "cd  ef\x1c\t" + "g" * 63, "g" * 64 + " " + "g" * 65, " \n", "hé ab " + "12345678 123456789 " * 2, "g" * 66 + "\x85g"]
    want = [w for t in texts for w in t.encode().split()]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    w = substrings.Words(data, np.cumsum([0, *[len(t.encode()) for t in texts]]), 2)
    assert [bytes(data[a:b]) for a, b in zip(w.starts, w.ends, strict=True)] == want
    assert w.doc.tolist() == [i for i, t in enumerate(texts) for _ in t.encode().split()]
    of = {}
    for word, h in zip(want, w.hashes.tolist(), strict=True):
        assert of.setdefault(word, h) == h
    assert len(set(of.values())) == len(of)
    stays = np.arange(len(want)) % 3 != 1
    kept = [[x for x, s, d in zip(want, stays, w.doc, strict=True) if s and d == i] for i in range(len(texts))]
    assert [bytes(b) for b in substrings.joined(w, stays)] == [b" ".join(x) for x in kept]
    assert all(w.doc[i] == w.doc[i + 1] for i in np.flatnonzero(w.alive)) and w.alive.sum() == sum(max(len(t.split()) - 1, 0) for t in (x.encode() for x in texts))


def test_parts_of_a_batch(spark, monkeypatch):
    """Rows are the same whatever texts are taken together."""
    rows = sample()
    batch = pa.RecordBatch.from_pydict({"text": pa.array([t or "" for _, t in rows], pa.string())}).slice(3)
    whole = None
    for size in (1, 300, 1 << 18):
        monkeypatch.setattr(substrings, "PART", size)
        parts = list(substrings._parts(batch, 20))
        assert sum(p.num_rows for p, _ in parts) == batch.num_rows and all(p.num_rows == len(w.first) - 1 for p, w in parts)
        found = [np.concatenate([getattr(w, name) for _, w in parts]).tolist() for name in ("hashes",)] + [[n for _, w in parts for n in np.diff(w.first).tolist()]]
        whole = whole or found
        assert found == whole
    assert len(parts) == 1


def test_calls_do_not_grow_with_the_number_of_texts(monkeypatch):
    calls, mix = [], substrings.mix
    monkeypatch.setattr(substrings, "mix", lambda a, b: calls.append(1) or mix(a, b))
    for n in (2, 500):
        batch = pa.RecordBatch.from_pydict({"text": pa.array([" ".join(f"w{i}{j}" for j in range(30)) for i in range(n)], pa.string())})
        for _, w in substrings._parts(batch, 20):
            assert [len(x) for x in w.runs(5)[1:]] == [len(w.runs(5)[1])] * 3 and w.own_first().all()
        calls.append(0)
    few, many = calls.index(0), len(calls) - calls.index(0) - 2
    assert few == many
