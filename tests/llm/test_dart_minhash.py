import collections
import random
import re
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import dart_minhash as m
from millrace.llm.common import UPPER, WORD
from millrace.llm.components import components


LOW = str.maketrans(UPPER, UPPER.lower())


def shingle_counts(text):
    """The weighted set of a text as words: its five-word shingles, or all its words if there are fewer."""
    w = re.findall(WORD, text.translate(LOW))
    return collections.Counter(zip(*(w[i:] for i in range(5)), strict=False)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def similar(a, b):
    both = sum((a & b).values())
    return 5 * both >= 4 * (a.total() + b.total() - both) > 0


def brute_classes(rows):
    """Class (a frozenset of row numbers) of each row, comparing all rows that share a shingle."""
    sets = [shingle_counts(t or "") for _, t in rows]
    index = collections.defaultdict(list)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    by_set = {}
    for i, s in enumerate(sets):
        if not s:
            continue
        key = frozenset(s.items())
        if key in by_set:
            parent[find(i)] = find(by_set[key])
            continue
        by_set[key] = i
        for x in s:
            index[x].append(i)
    for i in by_set.values():
        for j in {j for x in sets[i] for j in index[x] if j < i}:
            if find(i) != find(j) and similar(sets[i], sets[j]):
                parent[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    return [groups[find(i)] for i in range(len(rows))]


def check(got, rows):
    want = brute_classes(rows)
    ids = lambda g: [rows[i][0] for i in g]
    top = lambda g: max((x for x in ids(g) if x is not None), default=None)
    assert collections.Counter((r.doc_id, r.class_id, r.class_size) for r in got) == collections.Counter((rows[i][0], top(g), len(g)) for i, g in enumerate(want))
    assert sum(r.kept for r in got) == len({min(g) for g in want})
    assert all(r.doc_id == r.class_id for r in got if r.kept)


def test_agreement_is_weighted_similarity():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 62, 400, dtype=np.uint64)
    a, b = np.concatenate([words[:300], words[:60]]), np.concatenate([words[40:330], words[:60], words[:30]])
    sigs = [m.signatures(x, np.array([0, len(x)])) for x in (a, b)]
    both = m.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    assert all((both[k][i] == sigs[i][k][0]).all() for k in both for i in (0, 1))
    counts = [collections.Counter(zip(*(x[i:] for i in range(5)), strict=False)) for x in (a.tolist(), b.tolist())]
    true = (counts[0] & counts[1]).total() / (counts[0] | counts[1]).total()
    hits = []
    for salt in range(40):
        pair = m.signatures(m.mix(np.concatenate([a, b]) + m.U(salt)), np.array([0, len(a), len(a) + len(b)]))
        hits.append((pair["marks"][0] == pair["marks"][1]).mean())
    assert abs(np.mean(hits) - true) < 0.02


def test_words_are_those_of_the_pattern():
    rng = random.Random(8)
    texts = ["", "A a", "x", "é É日本, naïve_x9 9", "..", "Tail ", " a"] + ["".join(rng.choice("aAbZ09 _.é日\n") for _ in range(60)) for _ in range(50)]
    raw = [t.encode() for t in texts]
    hashes, offsets = m.word_hashes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    words = [re.findall(WORD, t.translate(LOW)) for t in texts]
    assert np.diff(offsets).tolist() == list(map(len, words))
    flat = [w for ws in words for w in ws]
    assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat)) == len(set(hashes.tolist()))


def test_heavy_weights_agree_as_their_ratio():
    hits = []
    for salt in range(60):
        w = m.mix(np.full(1, salt, dtype=np.uint64))
        pair = m.signatures(np.concatenate([np.repeat(w, 104), np.repeat(w, 54)]), np.array([0, 104, 158]))
        assert pair["n"].tolist() == [100, 50]
        hits.append((pair["marks"][0] == pair["marks"][1]).mean())
    assert abs(np.mean(hits) - 0.5) < 0.03


def test_components(spark):
    rng, n = random.Random(4), 300
    edges = [(i, i + 1) for i in range(0, 120)] + [(1000, i) for i in range(1001, 1200)] + [(rng.randrange(2000, 2000 + n), rng.randrange(2000, 2000 + n)) for _ in range(200)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for u, v in edges if u != v for x in (u, v)} | {k: v for k, v in got.items() if False}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def variants(rng, base, n, edits):
    for _ in range(n):
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
        yield " ".join(w)


def test_groups_chains_and_edges(spark, monkeypatch):
    monkeypatch.setattr(m, "PAIRS", 7)
    monkeypatch.setattr(m, "BLOCK", 8)
    rng = random.Random(5)
    texts = [None, "", "!!", "one two", "One, TWO", "a b c d e", "x " * 30, "x " * 33, "x " * 90]
    base = [f"w{i}" for i in range(200)]
    texts += [" ".join(base)] * 30 + list(variants(rng, base, 60, 4))
    passage = [f"p{i}" for i in range(60)]
    texts += [" ".join(passage + [f"q{j}_{i}" for i in range(15)]) for j in range(40)]  # similarity about 0.58
    chain = [f"c{i}" for i in range(150)]
    for _ in range(12):
        texts.append(" ".join(chain))
        chain = chain[12:] + [f"n{rng.randrange(10**6)}" for _ in range(12)]
    texts += ["long " + " ".join(f"z{i}" for i in range(30_000)), "longer " + " ".join(f"z{i}" for i in range(30_000))]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(5, "a b c d e"), (5, "a b c d e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("rid", "row", "n", "c1", "label", "u", "v")})
    check(m.near_dedup(docs).collect(), rows)
    kept = m.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({min(g) for g in brute_classes(rows)})
    assert m.near_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(m.op6_dart_minhash(spark, f"/root/testdata/{sf}").collect(), rows)


def test_rows_are_found_by_bitmaps_without_a_shuffle_of_rows(spark):
    rows = m.materialize(spark.range(0, 70000, 1, 3).select(F.monotonically_increasing_id().alias("rid"), F.col("id").alias("x")), "rows")
    some = rows.filter("x % 3 = 1 or x = 69999").select("rid")
    got = m.among(rows, some)
    assert got.columns == ["rid", "x"] and {r.x for r in got.collect()} == {x for x in range(70000) if x % 3 == 1 or x == 69999}
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 1
    assert not m.among(rows, some.limit(0)).take(1)


def test_long_texts_are_hashed_in_slices(monkeypatch):
    rng = random.Random(8)
    for text in ("ab cd  ef", "x" * 500, "é" * 333 + " y", " " * 70, "one " * 40 + "z" * 90 + " two", "".join(rng.choice("ab ,é") for _ in range(3000))):
        raw = np.frombuffer(text.encode(), np.uint8)
        want, _ = m.word_hashes(raw, np.array([0, len(raw)]))
        for size in (1, 2, 7, 64, 100_000):
            monkeypatch.setattr(m, "SLICE", size)
            assert m.long_word_hashes(raw).tolist() == want.tolist()
    monkeypatch.undo()
    texts = pa.array([" ".join(str(rng.randrange(900)) for _ in range(n)) for n in (3, 40, 4000, 900)])
    whole = m._signature(texts).to_pylist()
    monkeypatch.setattr(m, "SLICE", 2000), monkeypatch.setattr(m, "THROWN", 100)
    assert m._signature(texts).to_pylist() == whole


def test_verification_by_hashes_is_that_by_words():
    rng = random.Random(5)
    texts = []
    for _ in range(60):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 90))]
        texts += [" ".join(base), " ".join(w if rng.random() > 0.03 else "new" for w in base), " ".join(base + base[: rng.randrange(len(base))])]
    sets, plain = m.shingle_sets(pa.array(texts)), [shingle_counts(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(max(0, i - 4), i)]
    got = [m.similar(sets[i], sets[j]) for i, j in pairs]
    assert got == [similar(plain[i], plain[j]) for i, j in pairs] and 0 < sum(got) < len(got)


def test_a_text_of_20_megabytes_in_bounded_memory():
    code = """
import resource, time, random, pyarrow as pa
from millrace.llm import dart_minhash as m
rng = random.Random(1)
names = [f"w{i}" for i in range(50000)]
text = pa.array([" ".join(rng.choices(names, k=3_000_000)), "q" * 20_000_000])
before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
assert m._signature(text).to_pylist()[0]["n"] == 3_000_000 - 4
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024, time.time() - began)
"""
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert int(got[0]) < 500 and float(got[1]) < 60
