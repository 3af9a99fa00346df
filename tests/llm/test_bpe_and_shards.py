import collections
import hashlib
import random
import subprocess
import sys
import types
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from millrace.llm import byte_bpe, kd_sharding

TEXTS = ["", None, "Hello world, it's 2024!", "naïve café — 日本語 🙂", "   leading\n\n\ttabs  ", "a" * 3000, "ab" * 250 + " x", "<|endoftext|> ordinary", "xyz " * 400_000, "éèê" * 200, "\x00\x01 nul"]


def reference():
    path, pattern = byte_bpe.tokenizer()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.Ranks.load(path, pattern).ids, special_tokens={})


def test_bpe_matches_tiktoken(spark):
    other = reference()
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(0, ""), (None, "null id")], "doc_id long, text string").withColumn("id", F.lit(0)).withColumn("n_tokens", F.lit("x"))
    got = byte_bpe.bpe_roundtrip(docs, *byte_bpe.tokenizer(), full=True).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        text = "null id" if r.doc_id is None else TEXTS[r.doc_id] or ""
        ids = other.encode_ordinary(text)
        assert r.ids == ids and r.n_tokens == len(ids)
        assert bytes(r.decoded) == text.encode()
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert byte_bpe.bpe_roundtrip(docs.limit(0), *byte_bpe.tokenizer()).count() == 0


def test_bpe_query_over_table(spark):
    other = reference()
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = byte_bpe.op2_byte_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = other.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_long_runs_match_tiktoken():
    path, pattern = byte_bpe.tokenizer()
    coder, other, rng = byte_bpe.Coder(byte_bpe.Ranks.load(path, pattern)), reference(), random.Random(4)
    for letters in ("ACGT", "ab", "abcdefghijklmnopqrstuvwxyz", "aA", "इसकाहैमें", "的一是不了人我在", "-=", "a", " ", "zq"):
        for size in (byte_bpe.SQL_BYTES + 1, 999, 30_000):
            text = "".join(rng.choices(letters, k=size))
            assert b"".join(raw for _, raw in coder.encode([text])) == np.array(other.encode_ordinary(text), dtype="<u4").tobytes(), (letters, size)


def test_a_run_of_20_megabytes_in_bounded_memory():
    code = """
import random, resource, time
from millrace.llm import byte_bpe
coder = byte_bpe.Coder(byte_bpe.Ranks.load(*byte_bpe.tokenizer()))
text = "".join(random.Random(1).choices("ACGT", k=20_000_000))
before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
assert sum(len(raw) for _, raw in coder.encode([text])) > 20_000_000
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024, time.time() - began)
"""
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert int(got[0]) < 1500 and float(got[1]) < 90, got


class Counting:
    """A DuckDB connection that counts the rows of recursive queries and the ids of decoding ones."""

    def __init__(self, db):
        self.db, self.steps, self.ids = db, 0, 0

    def __getattr__(self, name):
        return getattr(self.db, name)

    def sql(self, query):
        if query == byte_bpe.MERGE:
            self.steps += self.db.sql(query[: query.rindex("SELECT")] + "SELECT count(*) FROM step").fetchall()[0][0]
        elif query == byte_bpe.DECODE:
            self.ids += self.db.sql("SELECT count(*) FROM ids").fetchall()[0][0]
        return self.db.sql(query)


def test_a_step_makes_one_row_for_a_piece_and_repeated_runs_are_decoded_once(monkeypatch):
    path, pattern = byte_bpe.tokenizer()
    ranks, other, rng, made = byte_bpe.Ranks.load(path, pattern), reference(), random.Random(5), []
    connect = byte_bpe.duckdb.connect
    monkeypatch.setattr(byte_bpe.duckdb, "connect", lambda *a, **k: made.append(Counting(connect(*a, **k))) or made[-1])
    alphabets = ("etaoinshr", "abcdefghijklmnopqrstuvwxyz", "aA", "éèêàß", "इसकाहैमें", "的一是不了人我在", "-=", "0123456789")
    words = ["".join(rng.choices(letters, k=rng.randint(1, 40))) for letters in alphabets for _ in range(200)]
    texts = [" ".join(rng.sample(words, len(words))) for _ in range(6)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], ["id", "text"])
    (got,) = byte_bpe._roundtrip(types.SimpleNamespace(value=ranks), True)(iter([batch]))
    assert got.column("ids").to_pylist() == [other.encode_ordinary(t) for t in texts]
    assert got.column("decoded").to_pylist() == [t.encode() for t in texts]
    pieces = {p: len(other.encode_ordinary(p)) for t in texts for p in regex.findall(pattern, t)}
    assert 0 < made[0].steps <= sum(len(p.encode()) - n + 1 for p, n in pieces.items())
    assert 0 < made[0].ids <= sum(pieces.values())


def check_shards(rows, texts, shards, slack):
    assert len(rows) == len(texts)
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert collections.Counter((r["size"], r.text_crc32) for r in rows) == collections.Counter((len(t.encode()) + 1, zlib.crc32(t.encode())) for t in texts)
    for s, own in slots.items():
        assert 0 <= s < shards and sorted(own) == list(range(len(own)))
    assert max(sizes.values()) - min(sizes[s] for s in range(shards)) <= slack
    return sizes


def test_kd_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    total = sum(len(t.encode()) + 1 for t in texts)
    check_shards(kd_sharding.op7_kd_sharding(spark, sf).collect(), texts, 16, 0.02 * total / 16 + max(len(t.encode()) for t in texts))


@pytest.mark.parametrize("shards", [1, 5])
def test_kd_hot_group_and_edges(spark, shards):
    texts = ["copy of one text"] * 3000 + [f"text {i} " * (i % 40) for i in range(3000)] + [None, None, ""]
    rows = [(i if i % 7 else None, t, None if i % 5 == 0 else "hot", "en", 1, 2) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, shard int, slot int").withColumns({"id": F.lit(1), "node": F.lit(1)})
    whole = [t or "" for t in texts]
    sizes = check_shards(kd_sharding.kd_shards(docs, shards).collect(), whole, shards, 800)
    target = sum(sizes.values()) // 3
    assert max(check_shards(kd_sharding.kd_shards(docs, None, target_bytes=target).collect(), whole, 4, 800).values()) <= target
    assert kd_sharding.kd_shards(docs.limit(0), shards).count() == 0
