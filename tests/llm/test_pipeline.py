"""The pipeline's stages one by one on small documents, and its run against what the stages say."""

import random

import corpus_pipeline
from lagwise.llm import packing, pii, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n):
    return " ".join(r.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(r.randint(0, 400)) for _ in range(n))


def corpus(spark, folder):
    r = random.Random(11)
    rows, labels = [], []
    for i in range(260):
        text = prose(r, r.choice([12, 60, 200]))
        if i % 5 == 1:
            ws = text.split()
            for w in ("dolt", "grobling", "swine"):
                ws.insert(r.randrange(len(ws)), w)
            text = " ".join(ws)
        if i % 40 == 2:
            text += "\nfooter one\nfooter two\nfooter three"
        if i % 50 == 3:
            text += " mail a.b@mail.example.com"
        rows.append((i, text))
        labels.append((i, int(i % 5 == 1), 1))
    rows += [(1000 + i, rows[10 + 5 * i][1]) for i in range(20)]
    rows += [(2000, None), (2001, ""), (2002, " ".join(["tail"] * 3000))]
    docs = spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in rows], SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    return dict(rows)


def test_stages_and_run(spark, tmp_path):
    folder = str(tmp_path)
    texts = corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if i < 4:
            assert out.columns == columns
        out.write.parquet(f"{folder}/stage{i}")
        docs = spark.read.parquet(f"{folder}/stage{i}")
        kept[name] = docs.collect()
    ids = {n: {r["doc_id"] for r in rows} for n, rows in kept.items()}
    toxic = {d for d in texts if d < 260 and d % 5 == 1}
    assert len(ids["toxicity"] & toxic) <= 2 and len(set(texts) - toxic - ids["toxicity"]) <= 2
    assert ids["line dedup"] == ids["toxicity"]
    footers = [r["doc_id"] for r in kept["line dedup"] if r["text"] and "footer two" in r["text"]]
    assert footers == [2] or footers == sorted(footers)[:1]
    gone = ids["line dedup"] - ids["SimHash near-dedup"]
    assert gone == {d for d in ids["line dedup"] if 1000 <= d < 1020} | {2001}
    assert not any(r["text"] and pii.find(r["text"]) for r in kept["PII"]) and sum("<EMAIL>" in (r["text"] or "") for r in kept["PII"]) > 2
    assert {r["doc_id"] for r in kept["best-fit packing"]} == ids["PII"]
    words = packing.words(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json"))
    want = sum(len(b) // 4 + 1 for b in words.encode([r["text"] or "" for r in kept["PII"]]))
    assert sum(r["length"] for r in kept["best-fit packing"]) == want
    whole = corpus_pipeline.run(spark, folder)
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, whole.collect())) == sorted(map(key, kept["best-fit packing"]))
    assert toxicity.SAMPLE > 0


def test_empty_documents(spark, tmp_path):
    folder = str(tmp_path)
    docs = spark.createDataFrame([], SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_pairs_are_verified_in_blocks_as_one_by_one(spark, monkeypatch):
    """Texts at, above and below the wanted overlap, empty ones, one in several blocks; also where no set can be kept."""
    from lagwise.llm import simhash
    from lagwise.llm.common import keyed, texts

    words = [f"w{i}" for i in range(104)]
    bodies = [" ".join(words[:n]) for n in (104, 100, 90, 84, 83, 60)] + ["", "", "one two"]
    docs = keyed(texts(spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string")))
    keys = sorted(r["key"] for r in docs.select("key").collect())
    rows = [(x, y, (x + y) % 3, 0, x % 2) for x in keys for y in keys if x < y]
    pairs = spark.createDataFrame(rows, "x long, y long, list long, p long, q long")
    packed = simhash.packed_texts(docs, pairs.select("x").union(pairs.select("y")).distinct().toDF("node"))
    want = sorted(map(tuple, simhash.verified(pairs.select("x", "y"), packed, 0.8).collect()))
    assert 0 < len(want) < len(rows)
    assert sorted(map(tuple, simhash.verified_in_blocks(pairs, packed, 0.8).collect())) == want
    monkeypatch.setattr(simhash, "KEPT", 1)
    assert sorted(map(tuple, simhash.verified_in_blocks(pairs, packed, 0.8).collect())) == want
    assert simhash.verified_in_blocks(pairs.limit(0), packed, 0.8).count() == 0


def test_stages_send_texts_to_workers_in_small_batches(spark):
    """A batch lies in the executor beside its heap: the stages bound its rows, and leave a smaller bound as it is."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def sizes(batches):
        for batch in batches:
            yield batch.from_pydict({"rows": [batch.num_rows]})

    docs = spark.createDataFrame([(i, f"text {i}", "en", "s", 8) for i in range(2500)], SCHEMA).coalesce(1)
    try:
        for given, most in ((before, 1000), ("0", 1000), ("70", 70)):
            spark.conf.set(key, given)
            out = dict(corpus_pipeline.STAGES)["PII"](spark, docs, "")
            assert out.count() == 2500
            found = [r["rows"] for r in docs.mapInArrow(sizes, "rows long").collect()]
            assert sum(found) == 2500 and max(found) <= most
    finally:
        spark.conf.set(key, before)


def test_packing_is_the_same_however_little_a_worker_remembers(monkeypatch):
    """Forgetting chunks changes no ids."""
    r = random.Random(3)
    path = corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json")
    texts = [[prose(r, 40) for _ in range(5)] for _ in range(6)]
    want = [list(packing.Words(path).encode(t)) for t in texts]
    monkeypatch.setattr(packing, "REMEMBERED", 1)
    one = packing.Words(path)
    assert [list(one.encode(t)) for t in texts] == want
    assert len(one.known) <= 5 * 40


def test_near_copies_of_a_base_that_is_not_the_smallest_and_pairs_about_the_bound(spark):
    """No text depends on a single partner: 120 variants hang together by a base in their midst alone; groups are those of exact overlap."""
    r = random.Random(21)

    def edited(ws, share):
        at = set(r.sample(range(len(ws)), max(1, round(len(ws) * share))))
        return [f"new{r.randrange(10**9)}" if i in at else w for i, w in enumerate(ws)]

    base = prose(r, 430).split()
    bodies = [edited(base, 0.019) for _ in range(120)]
    bodies.insert(60, base)
    for n in (50, 120, 320):
        for share in (0.01, 0.02, 0.022, 0.025, 0.03, 0.04):
            for _ in range(6):
                one = prose(r, n).split()
                bodies += [one, edited(one, share)]
    sets = [{tuple(b[i : i + 5]) for i in range(len(b) - 4)} for b in bodies]
    root = list(range(len(bodies)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    links = 0
    for j, b in enumerate(sets):
        for i in range(j):
            common = len(sets[i] & b)
            if common and common / (len(sets[i]) + len(b) - common) >= 0.8:
                links += 1
                root[max(top(i), top(j))] = min(top(i), top(j))
    want = {i: top(i) for i in range(len(bodies))}
    alone = sum(want[i] == i and list(want.values()).count(i) == 1 for i in want)
    assert {want[i] for i in range(121)} == {0} and links > 150 and alone > 60
    from lagwise.llm import simhash

    docs = spark.createDataFrame([(i, " ".join(b)) for i, b in enumerate(bodies)], "doc_id long, text string")
    assert {x["doc_id"]: x["component_id"] for x in simhash.similar_texts(docs).collect()} == want


def near_variants(r, number):
    """Variants of a base that is not among them: nearly all pass the tally, some overlap by 0.8; and what groups they form."""
    base = prose(r, 300).split()
    bodies = []
    for i in range(number):
        at = set(r.sample(range(300), 3 if i % 4 == 0 else 6))
        bodies.append([f"v{i}x{k}" if k in at else w for k, w in enumerate(base)])
    sets = [{tuple(b[k : k + 5]) for k in range(len(b) - 4)} for b in bodies]
    root = list(range(number))
    for j in range(number):
        for i in range(j):
            common = len(sets[i] & sets[j])
            if common / (len(sets[i]) + len(sets[j]) - common) >= 0.8 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    return [" ".join(b) for b in bodies], root


def test_tables_of_near_dedup_grow_with_the_texts_not_with_their_pairs(spark, monkeypatch):
    """A large group of near copies of which many stay apart: no table between jobs has a row for each pair of it."""
    from lagwise.llm import simhash

    bodies, root = near_variants(random.Random(5), 200)
    assert 20 < len(set(root)) < 180
    rows, plain = {}, simhash.scratch

    def counted(df, name="table"):
        out = plain(df, name)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(simhash, "scratch", counted)
    docs = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string")
    assert {x["doc_id"]: x["component_id"] for x in simhash.similar_texts(docs).collect()} == dict(enumerate(root))
    assert max(rows["links"]) <= 3 * len(bodies) and max(max(n) for n in rows.values()) <= simhash.BANDS * len(bodies)


def test_lists_in_several_blocks_give_the_links_that_connect_them(spark, monkeypatch):
    """Lists of all texts and their split ones, cut into many blocks: few links, and the groups of brute force."""
    from lagwise.llm import simhash
    from lagwise.llm.common import keyed, texts

    bodies, root = near_variants(random.Random(6), 90)
    docs = keyed(texts(spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string")))
    nodes = simhash.marks(docs).withColumnRenamed("key", "node").localCheckpoint()
    packed = simhash.packed_texts(docs, nodes.select("node"))
    left = nodes.selectExpr("node", "node as root", "posexplode(bands) as (last, list)").select("list", "node", "root", "last")
    monkeypatch.setattr(simhash, "LIST", 16)
    lists = simhash._deeper(left, nodes).localCheckpoint()
    depths = {x["depth"]: x["n"] for x in lists.selectExpr("depth", "size").groupBy("depth").agg({"size": "max"}).toDF("depth", "n").collect()}
    assert len(depths) > 1 and max(depths.values()) > 16
    links = [tuple(x) for x in simhash._linked_lists(lists, nodes, packed, 0.8).collect()]
    found = list(range(len(bodies)))
    for x, y in links:
        low, high = sorted((found[x], found[y]))
        found = [low if f == high else f for f in found]
    assert found == root
    assert simhash._linked_lists(lists.limit(0), nodes, packed, 0.8).count() == 0
