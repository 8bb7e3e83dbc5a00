"""Embedding links, whitening and phrases against brute force; near copies in a hot band."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from lagwise.llm import nearest, phrases, simhash, whitening

SF = "/root/testdata/sf0.001"


def brute_links(vectors, ids, least=0.9):
    """{(id, links, smallest id reachable)}"""
    good = [i for i, v in enumerate(vectors) if v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    d = max([len(vectors[i]) for i in good], default=0)
    x = np.array([[*vectors[i], *[0.0] * (d - len(vectors[i]))] for i in good], float).reshape(len(good), d)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= least
    label = np.arange(len(vectors))
    while True:
        new = label.copy()
        for a, row in zip(good, near, strict=True):
            new[a] = min(new[a], *[label[good[b]] for b in np.flatnonzero(row)])
        new = new[new]
        if (new == label).all():
            break
        label = new
    count = Counter(dict(zip(good, (near.sum(axis=1) - 1).tolist(), strict=True)))
    first: dict[int, int] = {}
    for i, c in enumerate(label.tolist()):
        first[c] = min(first.get(c, ids[i]), ids[i])
    return {(ids[i], count[i], first[int(c)]) for i, c in enumerate(label)}


def planted(r, n=300, d=16):
    """Unlike vectors, near copies at many distances, a hot group with equal rows, and rows that link with nothing."""
    base = r.standard_normal((n, d))
    hot = r.standard_normal(d)
    out = [*base, *[hot + r.standard_normal(d) * r.choice([0.02, 0.1, 0.2, 0.3, 0.35]) for _ in range(260)], *[hot] * 60, *[b + r.standard_normal(d) * 0.3 for b in base[:150]]]
    return [[float(c) for c in v] for v in out] + [None, [0.0] * d, [float("nan")] * d, [float("inf"), *[0.0] * (d - 1)], [None] * d, [], [1.0, 2.0], [2.0, 4.0]]


def test_links_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 64)
    monkeypatch.setattr(nearest, "QUERIES", 100)
    vectors = planted(np.random.default_rng(5))
    ids = list(range(0, 3 * len(vectors), 3))
    df = spark.createDataFrame(list(zip(ids, vectors, ids, strict=True)), "vec_id long, embedding array<double>, node long")
    rows = nearest.near_vectors(df.repartition(3)).collect()
    got, want = {(x["vec_id"], x["n_links"], x["component_id"]) for x in rows}, brute_links(vectors, ids)
    assert {g[0] for g in got} == set(ids) and all(x["kept"] == (x["vec_id"] == x["component_id"]) for x in rows)
    assert len(got & want) >= 0.99 * len(want) and sum(g[1] for g in got) >= 0.99 * sum(w[1] for w in want)
    # nothing below the threshold: no vector has more links than it should
    true = {w[0]: w[1] for w in want}
    assert all(n <= true[i] for i, n, _ in got)


def test_recall_of_pairs_at_the_threshold(spark):
    """Each vector has one partner just above 0.9 in a direction of another vector."""
    r = np.random.default_rng(2)
    x = r.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    across = np.roll(x, 1, axis=0)
    across -= (across * x).sum(axis=1, keepdims=True) * x
    across /= np.linalg.norm(across, axis=1, keepdims=True)
    y = 0.9005 * x + np.sqrt(1 - 0.9005**2) * across
    vectors = [[float(c) for c in v] for v in np.concatenate((x, y))]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    got = sum(x["n_links"] for x in nearest.near_vectors(df).collect())
    assert got >= 0.97 * sum(w[1] for w in brute_links(vectors, list(range(len(vectors)))))


def test_links_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert nearest.near_vectors(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (5, [1.0, 0.01], 1), (7, [0.0, 1.0], 2), (9, None, 3), (4, [1.0, 0.0, 0.0], 1)]
    got = sorted((x["vec_id"], x["n_links"], x["component_id"], x["kept"]) for x in nearest.near_vectors(spark.createDataFrame(rows, schema)).collect())
    assert got == [(4, 2, 4, True), (5, 2, 4, False), (5, 2, 4, False), (7, 0, 7, True), (9, 0, 9, True)]
    only_bad = spark.createDataFrame([(1, None, 0), (2, [], 0)], schema)
    assert sorted((x["vec_id"], x["n_links"]) for x in nearest.near_vectors(only_bad).collect()) == [(1, 0), (2, 0)]


def whitened_by_eigh(vectors, d, k=4):
    x = np.array([[*np.floor(256 * np.array(v, float)).astype(int), *[0] * (d - len(v))] for v in vectors])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    a = fit - s / n
    e, v = np.linalg.eigh(a.T @ a / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return n, e / (a * a).sum() * n, np.abs((x - s / n) @ v / np.sqrt(e)), ((n * x - s) ** 2).sum(axis=1)


def test_whitening_against_a_full_decomposition(spark):
    r = np.random.default_rng(3)
    vectors = [[float(c) for c in v] for v in r.standard_normal((120, 12)) * np.linspace(3, 0.2, 12)]
    rows = [(i, v, 0) for i, v in enumerate(vectors)] + [(7, vectors[7], 0), (None, vectors[8], 0), (500, vectors[9][:5], 0)]
    bad = [(900, None, 0), (901, [None] * 12, 0), (902, [float("nan")] * 12, 0), (903, [float("-inf")] * 12, 0), (904, [1e300] * 12, 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, n int").repartition(4)
    got = whitening.whiten(df).collect()
    assert len(got) == 4 * len(rows) and not {x["vec_id"] for x in got} & {b[0] for b in bad}
    n, explained, white, far = whitened_by_eigh([v for _, v, _ in rows], 12)
    at = {i: k for k, (i, *_) in enumerate(rows)}
    for x in got:
        k = at[x["vec_id"]]
        assert (x["n"], x["deviation"]) == (n, far[k]) and x["identity_error"] < 1e-10
        assert abs(x["whitened"]) == pytest.approx(white[k, x["component"] - 1], abs=1e-9)
        assert x["explained"] == pytest.approx(explained[x["component"] - 1], rel=1e-9)


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>"
    for rows in ([], [(1, None)], [(1, []), (2, [])], [(1, [0.5, 0.5]), (2, [0.5, 0.5])]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [0.0, 1.0])], schema)).collect()
    assert sorted((x["vec_id"], x["component"], x["n"]) for x in one) == [(1, 1, 2), (2, 1, 2), (3, 1, 2)] and one[0]["explained"] == pytest.approx(1)


def test_repeated_eigenvalues_are_all_found():
    a = np.vstack([np.eye(6) * 3, -np.eye(6) * 3, np.eye(6), -np.eye(6)])
    deviations, found = whitening.bidiagonalise(lambda w, left: ((a @ left.T).T @ (a @ w), float((a @ w) @ (a @ w)), a.T @ (a @ w)), 6, 4)
    assert np.allclose(deviations, np.sqrt(20)) and np.allclose(found @ found.T, np.eye(4))


def brute_phrases(rows, least, top):
    """Every phrase counted and cut by itself."""
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        data = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\x0a\x0b\x0c\x0d":
            data = data.replace(c, "\n")
        for piece in data.split("\n"):
            ws = [w for w in piece.replace("\t", " ").split(" ") if w]
            n[lang] += len(ws)
            f.update((lang, tuple(ws[i : i + k])) for k in range(1, 6) for i in range(len(ws) - k + 1))
    cand = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    gone = {(lang, p[i : i + k]) for (lang, p), a in cand.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 100 * f[lang, p[i : i + k]]}
    out = []
    for lang in n:
        scored = []
        for (lg, p), a in cand.items():
            if lg == lang and (lg, p) not in gone:
                score, k = min((1000 * a * n[lang] // (f[lg, p[:k]] * f[lg, p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[lg, p[:k]], f[lg, p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    words = ["the", "of", "Tea", "time", "x", "é", "日本", "a\x01b", "\xa0", "the"]
    rows = []
    for _ in range(150):
        text = "".join(r.choice(words) + r.choice([" ", "  ", "\t", " ", ". ", ",", "\n", "\x0b", " "]) for _ in range(r.randint(0, 60)))
        rows.append((r.choice(["en", "en", "de", None]), text))
    return [*rows, ("en", None), ("en", ""), ("fr", "alone here"), ("de", "very long " * 5000)]


@pytest.mark.parametrize(("budget", "together"), [(1 << 20, 1 << 21), (40, 500)])
def test_phrases_against_every_count(spark, monkeypatch, budget, together):
    """With a small budget prefixes are lengthened and nodes above them have parts in several groups."""
    monkeypatch.setattr(phrases, "HEAVY", 1 << 16)
    monkeypatch.setattr(phrases, "TOGETHER", together)
    rows = corpus(4)
    df = spark.createDataFrame([(i, t, g, 1) for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string, word int").repartition(5)
    for least, top in ((4, 30), (25, 2000)):
        got = sorted(tuple(x) for x in phrases.collocations(df, least, top, budget).collect())
        assert got == brute_phrases(rows, least, top) and got


def test_phrases_of_few_documents(spark):
    schema = "doc_id long, text string, lang string"
    assert phrases.collocations(spark.createDataFrame([], schema)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, "en"), (2, "one two one two", None)], schema)).count() == 0


def test_phrases_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(phrases.ORACLE).fetchall()
    got = phrases.collocations(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_a_hot_band_of_unlike_texts_and_near_copies(spark, monkeypatch):
    """Texts that share half their shingles meet in bands and stay apart; near copies among them are found, lists being split."""
    monkeypatch.setattr(simhash, "LIST", 20)
    r = random.Random(6)
    word = lambda: f"w{r.randint(0, 10**6)}"
    shared = [word() for _ in range(60)]
    texts = [" ".join([*shared, *[word() for _ in range(55)]]) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)]
    pairs = 0
    for i in range(0, 150, 3):  # one word changed: five shingles of about 110
        ws = texts[i].split()
        ws[80] = word()
        rows.append((1000 + i, " ".join(ws)))
        pairs += 1
    sets = {d: set(simhash.shingle_hashes(t, 5).tolist()) for d, t in rows}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    assert all(alike(1000 + i, i) for i in range(0, 150, 3)) and not alike(0, 1)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in simhash.similar_texts(df).collect()}
    assert sum(got[1000 + i] == i for i in range(0, 150, 3)) >= 0.98 * pairs
    assert all(got[i] == i for i in range(150))
