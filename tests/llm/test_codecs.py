"""Tokens, packing, AVI files: against the libraries and by round trips."""

import base64
import hashlib
import os
import subprocess
import sys
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lagwise.llm import avi, bpe, common, packing

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "a  b", " \n x", "a \n", "x\n  y  ", "　 a 　b", "don't 's  's", "a\x1c b\x1d\x1e c", "  ", "\t \t", "é  x 12 345!!  <|endoftext|> z", ".\x85\x85 a", "aaaaaaaaaaaaaaaa" * 20, "é \U0001f600"]
SCHEMA = "doc_id long, text string, ids string, length string"


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def table(spark, texts):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)] + [(None, "no id", "", "")], SCHEMA)


def test_bpe_equals_the_library(spark, library):
    texts = [None, *ODD, "long " * 5000, " ".join(ODD)]
    got = {r["doc_id"]: r for r in bpe.round_trip(table(spark, texts), RANKS, public_tokenizers.PATTERN).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    ids = bpe.encode(table(spark, texts), RANKS, public_tokenizers.PATTERN)
    back = {r["doc_id"]: bytes(r["bytes"]) for r in bpe.decode(ids, RANKS, public_tokenizers.PATTERN).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(texts)}
    assert bpe.round_trip(table(spark, []).where("doc_id is not null"), RANKS, public_tokenizers.PATTERN).count() == 0


def test_long_words_and_odd_vocabularies(tmp_path, library):
    import random
    import time

    coder = bpe.ranks(RANKS, public_tokenizers.PATTERN)
    words = [b"ab" * 200_000, b"a" * 400_000, b"thetion" * 60_000, bytes(random.Random(1).choices(b"abcdeth", k=300_000))]
    began = time.time()
    flat, ends = coder.replay(words)
    assert time.time() - began < 20
    for k, w in enumerate(words):
        assert flat[ends[k] : ends[k + 1]].tolist() == library.encode_ordinary(w.decode())
    # ranks in any order: a merge may then make a pair of a lower rank
    for seed in range(40):
        r = random.Random(seed)
        tokens = {bytes(r.choices(b"ab", k=r.randint(2, 5))) for _ in range(14)}
        tokens = [*[bytes([b]) for b in range(256)], *r.sample(sorted(tokens), len(tokens))]
        path = tmp_path / f"odd{seed}"
        path.write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(tokens)))
        odd = bpe.Ranks(str(path), public_tokenizers.PATTERN)
        other = tiktoken.Encoding("odd", pat_str=public_tokenizers.PATTERN, mergeable_ranks=odd.ranks, special_tokens={})
        words = [w for n in range(1, 40) if (w := "".join(r.choices("ab", k=n))) not in odd.words]
        flat, ends = odd.replay([w.encode() for w in words])
        for k, w in enumerate(words):
            want = other.encode_ordinary(w)
            assert flat[ends[k] : ends[k + 1]].tolist() == want == odd.one(w.encode())


def test_bpe_repeated_ids_and_clashing_columns(spark, library):
    rows = [(7, "some wrds xyzzy", 1, 2), (7, "other wrds", 3, 4), (7, "some wrds xyzzy", 1, 2), (8, None, 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, slice long, part int")
    got = sorted((r["doc_id"], bytes(r["ids"])) for r in bpe.encode(df, RANKS, public_tokenizers.PATTERN).collect())
    assert got == sorted((d, np.array(library.encode_ordinary(t or ""), "<u4").tobytes()) for d, t, *_ in rows)


def test_words_of_several_slices_and_buckets(spark, library):
    spell = lambda i: "".join("bdfghjklmn"[int(c)] for c in str(i))  # noqa: E731  the pattern parts digits from letters
    texts = [f"qu{spell(i % 50)}zz wrd{spell(i)} " * 3 for i in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = bpe.new_words(bpe.texts(df).selectExpr("*", "spark_partition_id() as part"), RANKS, public_tokenizers.PATTERN)
    assert words.select("slice").distinct().count() > 1 and words.select("bucket").distinct().count() > 1
    got = {r["doc_id"]: bytes(r["ids"]) for r in bpe.encode(df, RANKS, public_tokenizers.PATTERN).collect()}
    assert got == {i: np.array(library.encode_ordinary(t), "<u4").tobytes() for i, t in enumerate(texts)}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t 'aehlnost.!0"), st.characters(codec="utf-8")), max_size=60), max_size=4))
def test_any_text(texts):
    coder = bpe.ranks(RANKS, public_tokenizers.PATTERN)
    ranks = {t: i for i, t in enumerate(coder.tokens)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    plain = Tokenizer.from_file(JSON)
    for t, other in zip(texts, packing.words(JSON).encode(texts), strict=True):
        flat, ends = coder.replay([w.encode() for w in coder.cut(t)]) if t else ([], [])
        assert list(flat) == library.encode_ordinary(t)
        assert other == np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_special_strings_are_as_the_library_takes_them():
    plain, mine = Tokenizer.from_file(JSON), packing.words(JSON)
    texts = ["hello <|endoftext|> bye", "<|endoftext|>", "a<|endoftext|>b  <|endoftext|>", "hello <|endoftext> bye"]
    for t, ids in zip(texts, mine.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids
    assert 50256 not in np.frombuffer(next(packing.Words(JSON, special=False).encode(texts[:1])), "<u4")


def test_packing(spark):
    texts = [None, "", "one two", "word " * 3000, *[f"w{i} " * (i * 7 % 400) for i in range(120)]]
    df = table(spark, texts)
    rows = packing.pack(df, JSON).collect()
    tokenizer = Tokenizer.from_file(JSON)
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append(r)
    total = 0
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        total += len(ids)
        at = 0
        for k, r in enumerate(sorted(pieces[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and (k == 0 or r["length"] == 1024 or at + r["length"] == len(ids))
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids) and (len(ids) > 1024 or len(pieces[i]) == 1)
    for rs in bins.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert len(bins) <= -(-total // 1024) + 2
    joined = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(df, packing.pack(df, JSON), JSON).collect()}
    assert sum(map(len, joined.values())) == 4 * total
    assert packing.pack(df.where("false"), JSON).count() == 0


def test_plan_keeps_every_capacity():
    r = np.random.default_rng(3)
    lengths = r.integers(1, 65, 4000)
    counts = [(int(n), int(c)) for n, c in zip(*np.unique(lengths, return_counts=True), strict=True)]
    for by in ("norm", "dot"):
        table = packing.plan(counts, 64, max_documents=5, max_cost=4, by=by)
        used = defaultdict(list)
        for n, c in counts:
            rows = table[table[:, 0] == n]
            assert rows[0, 1] == 0
            for k, (_, rank, seq, offset) in enumerate(rows):
                end = rows[k + 1, 1] if k + 1 < len(rows) else c
                for j in range(end - rank):
                    used[seq + j].append((offset, n))
        for items in used.values():
            items.sort()
            assert all(a + n == b for (a, n), (b, _) in zip(items, items[1:], strict=False))
            assert items[0][0] == 0 and sum(n for _, n in items) <= 64 and len(items) <= 5 and sum(packing.cost(n) for _, n in items) <= 4


def test_capacities_bind_and_repeated_ids_are_documents(spark):
    rows = packing.pack(table(spark, ["w "] * 40).selectExpr("1L as doc_id", "text", "ids as length", "length as piece"), JSON).collect()
    assert len(rows) == 41  # table() adds a row
    assert max(sum(r["sequence_id"] == s for r in rows) for s in {r["sequence_id"] for r in rows}) == packing.DOCUMENTS
    assert packing.cost(128) == 1 and packing.cost(129) == 4
    for most, sequences in ((16, 4), (32, 3), (1000, 3)):  # 16 pieces of 4 tiles; 7 of 130 tokens fill a sequence
        table_ = packing.plan([(130, 16)], 1024, max_documents=99, max_cost=most)
        ends = [*table_[1:, 1].tolist(), 16]
        assert len({s + i for (_, r, s, _), e in zip(table_.tolist(), ends, strict=True) for i in range(e - r)}) == sequences


def test_avi_round_trip(spark):
    texts = [None, "", "x", "é" * 500, "abc \xff" * 3000, "y" * 192, "\x00" * 400]
    rows = {r["doc_id"]: r for r in avi.digests(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        n, payload = avi.padded(t)
        assert rows[i]["n_bytes"] == len((t or "").encode()) == n
        assert rows[i]["payload_bytes"] == len(payload) and len(payload) % 192 == 0 and len(payload) > 0
        assert rows[i]["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert rows[i]["tail_crc32"] == zlib.crc32(payload[-16:])
    media = avi.write_avi(table(spark, texts))
    for r in media.collect():
        assert rows[r["doc_id"]]["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
        assert b"".join(f.tobytes() for f in avi.read(bytes(r["media"]))) == avi.padded(texts[r["doc_id"]])[1]
    broken = media.unionByName(spark.createDataFrame([(90, 0, None), (91, 0, bytearray(b"RIFFxxxxWAVE"))], "doc_id long, n_bytes long, media binary"))
    clips = avi.clips(broken).collect()
    assert {r["doc_id"] for r in clips if r["error"]} == {90, 91}
    assert {r["doc_id"] for r in clips} == {*range(len(texts)), 90, 91}


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=900))
def test_any_bytes_survive(data):
    payload = data + b" " * (-len(data) % 192)
    assert b"".join(f.tobytes() for f in avi.read(avi.write([payload])[0])) == payload


def test_shots_at_cuts():
    scenes = [np.full((20, avi.FRAME), v, np.uint8) for v in (10, 200, 90)]
    frames = np.concatenate(scenes)
    assert avi.shots(avi.histograms(frames)) == [0, 20, 40]


def test_a_packing_worker_starts_no_threads():
    code = f"""
import os
from lagwise.llm import packing
count = lambda: len(os.listdir("/proc/self/task"))
words, before = packing.Words({JSON!r}), count()
found = list(words.encode([" ".join(f"w{{i}}-{{j}}" for j in range(300)) for i in range(300)]))
assert len(found) == 300 and count() == before, (before, count())
"""
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"}
    subprocess.run([sys.executable, "-c", code], check=True, env=env, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__))))


def test_batches_go_in_slices():
    whole = [pa.RecordBatch.from_pydict({"x": list(range(n))}) for n in (2500, 0, 1000)]
    parts = list(common.slices(iter(whole)))
    assert [p.num_rows for p in parts] == [1000, 1000, 500, 0, 1000]
    assert [x for p in parts for x in p.column("x").to_pylist()] == [*range(2500), *range(1000)]
