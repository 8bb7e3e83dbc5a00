"""Shards, fingerprints, SimHash, lines, personal data, toxicity: against brute force."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import xxhash

from lagwise.llm import components, fingerprints, lines, pii, sharding, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(d, t, "en", "src0", None if t is None else len(t)) for d, t in rows], SCHEMA)


def prose(r, n):
    return " ".join(r.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(r.randint(0, 400)) for _ in range(n))


def jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_shards(spark):
    rows = [(i * 37 - 900, "t" * (i % 9)) for i in range(600)] + [(2**63 - 1, None), (-(2**63), "é")]
    got = sharding.shard_documents(table(spark, rows)).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    slots = {}
    for r in got:
        assert (r["shard"], r["grown_shard"]) == (jump(r["doc_id"], 8), jump(r["doc_id"], 9))
        assert r["grown_shard"] in (r["shard"], 8)
        raw = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(table(spark, rows[:0])).count() == 0


def sketch(text, k=fingerprints.K):
    hs = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.split(r"[\x20\x09-\x0D]+", text) if w]

    def long(x, seed):
        return xxhash.xxh64_intdigest(x.to_bytes(8, "little"), seed)

    def chain(xs):
        seed = 42
        for x in xs:
            seed = long(x, seed)
        return seed

    if not hs:
        return []
    windows = {chain(hs[i : i + 5]) for i in range(len(hs) - 4)} if len(hs) >= 5 else {chain(hs)}
    signed = sorted(w - (1 << 64) if w >> 63 else w for w in windows)
    return signed[:k]


def test_fingerprints(spark):
    r = random.Random(1)
    rows = [(i * 3, prose(r, r.choice([0, 1, 4, 5, 30, 400]))) for i in range(30)]
    rows += [(100, None), (101, "éé \U0001f600 x " * 30), (None, "gone"), (6, rows[2][1])]
    got = {x["doc_id"]: x for x in fingerprints.compare_with_next(table(spark, rows)).collect()}
    texts = {d: t or "" for d, t in rows if d is not None}
    ids = sorted(texts)
    assert sorted(got) == ids
    written = lambda s: "".join(f"{h & (1 << 64) - 1:016x}" for h in s)
    for d, nxt in zip(ids, [*ids[1:], ids[0]], strict=True):
        t, half = texts[d], len(texts[d]) // 2
        edited = t[: len(t) - half] + texts[nxt][:half]
        x = got[d]
        assert (x["n_chars"], x["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = sketch(t), sketch(edited), sketch(texts[nxt])
        assert (x["fingerprint"], x["edited_fingerprint"]) == (written(a), written(b))
        for name, other in (("near_edited", b), ("near_next", c)):
            both = sorted({*a, *other})[: fingerprints.K]
            want = len({*both} & {*a} & {*other}) / len(both) if both else 1.0
            assert abs(x[name] - want) < 1e-12
    assert fingerprints.compare_with_next(table(spark, [])).count() == 0


def test_fingerprints_of_texts_that_share_an_id(spark):
    """Each text of an id is a document, next to the others of that id; a document given twice gives equal rows."""
    rows = [(1, "a b c d e f"), (2, "one two three four five six seven"), (2, "x y z"), (2, "x y z"), (7, None)]
    got = fingerprints.compare_with_next(table(spark, rows)).collect()
    assert sorted(x["doc_id"] for x in got) == [1, 2, 2, 2, 7]
    twice = [tuple(x) for x in got if x["n_chars"] == 5]
    assert len(twice) == 2 and twice[0] == twice[1]
    edits = {(x["doc_id"], x["n_chars"]): x["edited_sha256"] for x in got}
    of = lambda t, u: hashlib.sha256((t[: len(t) - len(t) // 2] + u[: len(t) // 2]).encode()).hexdigest()
    a, b, c = rows[0][1], rows[1][1], "x y z"
    first, second = (b, c) if edits[(1, len(a))] == of(a, b) else (c, b)
    want = {(1, len(a)): of(a, first), (2, len(first)): of(first, second), (2, len(second)): of(second, ""), (7, 0): of("", a)}
    assert edits == want


def test_sketches_merge(spark):
    from pyspark.sql import functions as F

    r = random.Random(2)
    whole = prose(r, 300).split()
    parts = [" ".join(whole[i : i + 104]) for i in range(0, 300, 100)]
    df = spark.createDataFrame([(1, p) for p in parts], "k int, text string")
    merged = fingerprints.merge_sketches(fingerprints.with_sketch(df, "text", "sketch"), "k").first()["sketch"]
    assert merged == sketch(" ".join(whole))
    a, b = fingerprints.with_sketch(df, "text", "s").orderBy(F.desc("text")).select("s").collect()[:2]
    assert len(a["s"]) == fingerprints.K and a["s"] == sorted(a["s"]) and b["s"] != a["s"]


def brute_simhash(text):
    ws = text.encode().lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(ws[i : i + 3]), 42) for i in range(max(1, len(ws) - 2))] if ws else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_components(spark):
    r = random.Random(3)
    base = [prose(r, 900) for _ in range(6)]
    rows = [(0, ""), (1, None), (2, "\t"), (3, "One two"), (4, "one  TWO")]
    for i in range(90):
        ws = r.choice(base).split()
        for _ in range(r.randint(0, 3)):
            ws[r.randrange(len(ws))] = "edit" + str(r.randint(0, 99))
        rows.append((10 + i, " ".join(ws)))
    rows += [(10, rows[5][1]), (None, "no id")]
    got = simhash.near_duplicates(table(spark, rows)).collect()
    known = [(d, brute_simhash(t or "")) for d, t in rows if d is not None]
    assert sorted((x["doc_id"], x["fp"] & (1 << 64) - 1) for x in got) == sorted(known)
    parent = {d: d for d, _ in known}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in known:
        for b, y in known:
            if (x ^ y).bit_count() <= 2:
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    assert {x["doc_id"]: x["component_id"] for x in got} == {d: root(d) for d, _ in known}
    assert len({x["component_id"] for x in got}) < 80
    assert simhash.near_duplicates(table(spark, [])).count() == 0


def test_long_lists_and_long_chains(spark):

    r = np.random.default_rng(5)
    values = np.unique(r.integers(0, 4096, 1500)).astype(np.int64)
    left, right = simhash.pairs(values, 2)
    want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if (int(values[i]) ^ int(values[j])).bit_count() <= 2}
    assert {tuple(sorted(p)) for p in zip(left.tolist(), right.tolist(), strict=True)} == want
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    roots = {x["node"]: x["root"] for x in components.components(chain, "a", "b").collect()}
    assert roots == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500}
    assert components.components(chain.where("false"), "a", "b").count() == 0


def test_similar_texts_keep_one(spark):
    r = random.Random(4)
    base = [prose(r, 300) for _ in range(8)]
    rows = list(enumerate(base))
    for i in range(40):
        ws = base[i % 4].split()
        ws[r.randrange(300)] = "other"
        rows.append((100 + i, " ".join(ws)))
    rows += [(200, base[5]), (201, None), (202, ""), (None, base[5])]
    kept = simhash.keep_one(table(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {x["doc_id"] for x in kept.collect()}
    assert ids >= {*range(8), 201, None} and not ids & {200, 202} and len([i for i in ids if i and 100 <= i < 140]) <= 2


def test_lists_longer_than_a_tally_are_split(spark, monkeypatch):
    """All fingerprints share half of their bytes, so every first list is split; and documents that share a doc_id are apart."""
    r = random.Random(31)
    fps = {0x1234 << 48 | r.randrange(1 << 10) << 20 | r.choice([0, 1, 1 << 40, 3 << 8]) for _ in range(1500)} | {r.randrange(1 << 62) for _ in range(300)}
    fps = sorted(fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 2}
    assert len(want) > 3000
    got = {(min(x), max(x)) for x in map(tuple, simhash.links(df, 2, every=True).collect())}
    assert got == want
    roots = {x["node"]: x["root"] for x in components.components(simhash.links(df, 2), "a", "b").collect()}
    assert roots == {x["node"]: x["root"] for x in components.components(spark.createDataFrame(sorted(want), "a long, b long"), "a", "b").collect()}
    for distance in (0, 1, 3):
        some = fps[::4]
        found = {(min(x), max(x)) for x in map(tuple, simhash.links(df.where(df.fp.isin(some)), distance, every=True).collect())}
        assert found == {(a, b) for i, a in enumerate(some) for b in some[i + 1 :] if (a ^ b).bit_count() <= distance}


def test_keep_one_of_documents_that_share_a_doc_id(spark):
    r = random.Random(32)
    one, other = prose(r, 80), prose(r, 80)
    rows = [(1, one), (1, other), (1, one), (2, other), (3, one), (None, one), (4, None)]
    df = table(spark, rows).withColumnsRenamed({"lang": "key", "source": "row"})
    kept = sorted((x["doc_id"] or 0, x["text"] or "") for x in simhash.keep_one(df).collect())
    assert kept == sorted([(1, one), (1, other), (0, one), (4, "")]) and simhash.keep_one(df).columns == df.columns


def edited(r, words, places):
    """The words with new ones at places far from each other."""
    ws, step = list(words), len(words) // places
    for i in range(places):
        ws[i * step + r.randrange(step - 5)] = f"edit{r.randrange(10**9)}"
    return " ".join(ws)


def test_variants_meet_a_base_that_is_not_the_smallest(spark):
    r = random.Random(9)
    base = prose(r, 300)
    rows = [(i, edited(r, base.split(), 4)) for i in range(40)] + [(1000, base)]
    assert {x["component_id"] for x in simhash.similar_texts(table(spark, rows)).collect()} == {0}


def overlap(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def test_similar_texts_are_those_of_exact_overlap(spark):
    r = random.Random(10)
    rows, want = [], {}
    for i in range(240):
        n, places = r.choice([(49, 1), (60, 1), (99, 2), (200, 3), (200, 4), (200, 5), (350, 7), (350, 8), (350, 9)])
        base = prose(r, n)
        other = edited(r, base.split(), places)
        rows += [(2 * i, base), (2 * i + 1, other)]
        want |= {2 * i: 2 * i, 2 * i + 1: 2 * i if overlap(base, other) >= 0.8 else 2 * i + 1}
    five = " ".join(f"w{i}" for i in range(49))  # 45 shingles: 40 of 50 are shared
    rows += [(1000, five), (1001, five.replace("w20", "x20")), (1002, " "), (1003, "\t"), (1004, "one two"), (1005, "One  two")]
    want |= {1000: 1000, 1001: 1000, 1002: 1002, 1003: 1002, 1004: 1004, 1005: 1004}
    assert overlap(five, rows[-5][1]) == 0.8 and 60 < sum(d != c for d, c in want.items()) < 200
    assert {x["doc_id"]: x["component_id"] for x in simhash.similar_texts(table(spark, rows)).collect()} == want
    assert simhash.similar_texts(table(spark, [])).count() == 0


def test_lines_match_the_sql(spark):
    r = random.Random(6)
    pool = [f"line {i}" for i in range(12)] + ["", "  "]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(0, 25)))) for i in range(60)]
    rows += [(70 + i, "head %d\nlicense a\nlicense b\nlicense c\ntail" % i) for i in range(5)] + [(80, None), (81, ""), (82, "\n\n\n\n\n\n"), (83, "a\nb")]
    got = lines.dedup_lines(table(spark, rows)).select("doc_id", "text", "n_lines", "n_removed").collect()
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [d for d, _ in rows], "text": [t for _, t in rows]}))
    assert sorted(map(tuple, got)) == sorted(con.sql(lines.ORACLE).fetchall())
    assert [x["n_removed"] for x in got if x["doc_id"] in (71, 74)] == [4, 4]
    clash = table(spark, rows).withColumnsRenamed({"lang": "n_lines", "source": "places"})
    assert sorted(x["n_removed"] for x in lines.dedup_lines(clash).collect()) == sorted(x["n_removed"] for x in got)
    keep_null = lines.dedup_lines(table(spark, [(None, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc")])).orderBy("doc_id").collect()
    assert [(x["doc_id"], x["text"]) for x in keep_null] == [(None, "a\nb\nc"), (1, "a\nb\nc"), (2, "")]


def test_pii_base_and_disguises(spark):
    plain = "mail a.b@x-y.example.com or 10.0.0.255 (not 10.0.0.256), +1 (555) 123-4567, card 4111 1111 1111 1111, 4111 1111 1111 1112"
    base, every = pii.spans(plain, True)
    assert [(pii.KINDS[k], plain[a:b]) for a, b, k in base] == [("email", "a.b@x-y.example.com"), ("ip", "10.0.0.255"), ("phone", "+1 (555) 123-4567"), ("card", "4111 1111 1111 1111")]
    assert every == base
    cases = {
        "write to jane.doe [at] mail (dot) example (dot) com now": ("email", "jane.doe [at] mail (dot) example (dot) com"),
        "write to jane at mail dot example dot com now": ("email", "jane at mail dot example dot com"),
        "jаne@mаil.exаmple.com": ("email", "jаne@mаil.exаmple.com"),
        "call plus one five five five one two three four five six seven ok": ("phone", "plus one five five five one two three four five six seven"),
        "card ４１１１ 1111 1111 1111": ("card", "４１１１ 1111 1111 1111"),
        "ip 10​.0.0.1!": ("ip", "10​.0.0.1"),
    }
    for text, want in cases.items():
        assert pii.disguised(pa.array([text])) == [True]
        assert want in [(pii.KINDS[k], text[a:b]) for a, b, k in pii.spans(text, True)[1]], text
    for clean in ("we met at noon and put a dot there", "one two three go", "look at this point in time"):
        assert pii.spans(clean, True)[1] == []
    rows = [(1, plain), (2, None), (3, ""), (4, next(iter(cases)))]
    got = {x["doc_id"]: x for x in pii.find_pii(table(spark, rows)).collect()}
    assert (got[1]["n_email"], got[1]["n_ip"], got[1]["n_card"], got[1]["n_phone"]) == (1, 1, 1, 1)
    assert got[2]["spans"] == "" and got[4]["n_email"] == 0 and got[4]["n_added"] == 1
    masked = {x["doc_id"]: x for x in pii.mask_pii(table(spark, rows)).collect()}
    assert masked[4]["text"] == "write to <EMAIL> now" and masked[4]["n_chars"] == 20 and masked[2]["text"] is None


def test_pii_gate_lets_all_through_that_the_rewriter_changes(spark):
    cases = {
        "write to jane at example.com now": "jane at example.com",
        "mail jane.doe at mail.example.org today": "jane.doe at mail.example.org",
        "jane@example . com": "jane@example . com",
        "to jane [at] firma [dot] se or": "jane [at] firma [dot] se",
        "to jane (at) mail.firma (dot) com (dot) br.": "jane (at) mail.firma (dot) com (dot) br",
        "to jane [at] shop [dot] example": "jane [at] shop [dot] example",
        "jane\u2003at\u2003mail\x85dot\x0bcom": "jane\u2003at\u2003mail\x85dot\x0bcom",
    }
    rows = list(enumerate(cases))
    got = {x["doc_id"]: x["spans"] for x in pii.find_pii(table(spark, rows)).collect()}
    assert got == {i: f"email:{t.index(cases[t])}:{t.index(cases[t]) + len(cases[t])}" for i, t in rows}
    for clean in ("we came at noon. It rained", "look at home. At last", "he was at work. De facto", "be at last (see (2)) [dot] x"):
        assert pii.spans(clean, True)[1] == [], clean
    r = random.Random(12)
    blanks, changed = ["", " ", " ", "\u2003", "\x0b", "\x85", "\n", "\x1c", "\u3000"], 0
    for _ in range(4000):
        parts = ["jane", r.choice(["at", "AT", "@", "[at]", "( @ )", "arroba"]), r.choice(["x", "a.b"]), r.choice(["dot", "Punkt", ".", "[dot]", "{ . }"]), r.choice(["com", "se", "It"])]
        if r.random() < 0.3:
            parts = [r.choice(["one", "f\u0130ve", "\u017feven", "plus", "acht", "x"]) for _ in range(5)]
        text = "".join(w + r.choice(blanks) for w in parts)
        if pii.rewrite(text)[0] != text:
            changed += 1
            assert pii.disguised(pa.array([text])) == [True], text
    assert changed > 500


RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def by_the_rules(text):
    """The base spans by plain search with the rules as they are written."""

    def passes(kind, found):
        digits = [int(c) for c in found if c.isdigit()]
        doubled = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits)))
        return {"email": True, "ip": all(int(x) <= 255 for x in found.split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and doubled % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]

    return sorted((m.start(), m.end(), k) for k, (kind, rule) in enumerate(RULES.items()) for m in re.finditer(rule, text) if passes(kind, m[0]))


def test_pii_base_spans_are_those_of_the_rules(spark):
    r = random.Random(21)
    parts = ["a", "b9", ".", "@", "-", "+", "1", "23", "255", "256", " ", "_", "%", "é", "0", "4111 1111 1111 1111", "(", ")", "12345678", "x@y.z", "1.2.3.4", "٣"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(20000)]
    for t in texts:
        base = by_the_rules(t)
        assert sorted(pii.find(t)) == base, t
        assert set(base) <= set(pii.spans(t, True)[1])
    rows = [*enumerate(texts[:300]), (5, texts[6]), (5, texts[6]), (None, "a@b.c")]
    clash = table(spark, rows).withColumnsRenamed({"lang": "spans", "source": "n_email"})
    got = sorted((x["doc_id"], x["n_email"] + x["n_ip"] + x["n_card"] + x["n_phone"], x["base_sha256"]) for x in pii.find_pii(clash).collect())
    listed = lambda t: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in sorted(by_the_rules(t), key=lambda s: (s[0], s[2])))
    assert got == sorted((d, len(by_the_rules(t)), hashlib.sha256(listed(t).encode()).hexdigest()) for d, t in rows if d is not None)
    assert pii.find_pii(table(spark, [])).count() == 0 and pii.mask_pii(table(spark, [])).count() == 0
    assert [x["text"] for x in pii.mask_pii(table(spark, [(None, "a@b.c"), (1, None)])).orderBy("doc_id").collect()] == ["<EMAIL>", None]


def test_pii_time_grows_with_the_text_only():
    import time

    n = 100_000
    for unit in ["-", "a", "1", ".", "@", " ", "+", "(", "é", "1.", "one ", "[at] ", " at", "a@b.c ", "a at b dot com ", "+1", "[ ", "plus ", "1 ", " dot", "\u200b"]:
        for end in ("", "@", " at ", ".", "@b.com"):
            text = unit * (n // len(unit)) + end
            began = time.time()
            pii.spans(text, True)
            assert time.time() - began < 2, (unit, end)


def test_toxicity_held_out(spark):
    r = random.Random(8)
    bad = ["dolt", "grobnik", "grobling", "swine"]
    rows, labels = [], []
    for i in range(600):
        ws = prose(r, 60).split()
        toxic = i % 4 == 0
        if toxic:
            for w in r.sample(bad, 2):
                ws.insert(r.randrange(60), w)
        rows.append((i, " ".join(ws)))
        labels.append((i, int(toxic)))
    rows += [(900, None), (901, "")]
    marks = spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score(table(spark, rows), marks).collect()
    truth = dict(labels)
    held = [x for x in got if x["held_out"] and x["doc_id"] in truth]
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in got)
    assert sum(x["predicted"] == truth[x["doc_id"]] for x in held) >= 0.97 * len(held) > 50
    assert len(got) == 602 and all(0 <= x["score"] <= 1 for x in got)
    kept = toxicity.keep_clean(table(spark, rows), marks)
    assert 420 <= kept.count() <= 460 and kept.columns == table(spark, rows).columns
    assert all(x["score"] < 1e-6 for x in toxicity.score(table(spark, rows[:3]), marks.where("false")).collect())
    assert toxicity.score(table(spark, []), marks).count() == 0


def test_label_model_finds_planted_rates():
    """Voters with known rates in two classes, one of them cast three times over: rates, prior and posteriors come back."""

    r = np.random.default_rng(11)
    n, prior = 40_000, 0.2
    y = r.random(n) < prior
    rates = np.stack([r.uniform(0.02, 0.1, toxicity.VOTERS), r.uniform(0.5, 0.9, toxicity.VOTERS)])
    cast = r.random((n, toxicity.VOTERS)) < rates[y.astype(int)]
    cast[:, 1] = cast[:, 2] = cast[:, 0]
    rates[:, 1] = rates[:, 2] = rates[:, 0]
    votes = (cast * (1 << np.arange(toxicity.VOTERS))).sum(axis=1)
    patterns, count = np.unique(votes, return_counts=True)
    model = toxicity.fit_label_model(patterns, count.astype(float), votes[:500], y[:500].astype(int))
    assert abs(model.prior - prior) < 0.02 and np.abs(model.rates - rates).max() < 0.05
    assert model.weights[:3].max() < 0.5 < model.weights[3:].min()
    assert ((model.posterior(toxicity.bits(votes[500:])) >= 0.5) == y[500:]).mean() > 0.99


def test_every_fitting_row_trains_the_classifier(spark):
    """The labelled sample is bounded and holds no held-out row; the slopes run over all rows that are not held out."""
    rows = [(i, f"text {i} " + "dolt swine " * (i % 2)) for i in range(200)] + [(3, "text 3 dolt swine"), (None, "no id")]
    marks = spark.createDataFrame([(i, i % 2) for i in range(0, 200)], "doc_id long, toxic int")
    got = toxicity.fitting_sample(table(spark, rows), marks, bound=10).collect()
    assert len({x["doc_id"] for x in got}) == 10
    assert all(zlib.crc32(str(x["doc_id"]).encode()) % 5 for x in got)
    lexicon = toxicity.Lexicon({"dolt": 0, "swine": 1}, np.array([60.0, 60.0]))
    found = toxicity.voted(table(spark, rows), lexicon)
    assert found.count() == len(rows)
    fitting = found.where("not held_out")
    model = toxicity.LabelModel(0.5, np.full((2, toxicity.VOTERS), 0.5), np.ones(toxicity.VOTERS))
    w = np.linspace(-1, 1, 2 + toxicity.INPUTS)
    slope, first = toxicity._slopes(fitting, model, w, 0.3)
    want, n = np.zeros(len(w) + 1), 0
    for d, t in rows:
        if d is not None and zlib.crc32(str(d).encode()) % 5:
            votes, at, x = lexicon.votes(t)
            e = 1 / (1 + np.exp(-(x @ w[at] + 0.3))) - model.posterior(toxicity.bits(np.array([votes])))[0]
            np.add.at(want, at, x * e)
            want[-1] += e
            n += 1
    assert np.allclose(slope, want[:-1] / n) and np.isclose(first, want[-1] / n)
