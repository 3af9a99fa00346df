"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for the table operators."""

import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import decontamination, exact_dedup, line_dedup
from millrace.llm.common import WORD

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LINE = "This line is long enough to be counted, it has over forty characters."
ROWS = [
    (1, "Same TEXT"), (2, "same text"), (3, None), (4, ""), (5, "é É"), (6, "é é"), (7, "x" * 300_000), (8, "x" * 300_000), (8, "x" * 300_000),
    *[(i, f"{LINE}\nown line {i}\n  {LINE.upper()}\t") for i in range(10, 17)], (20, "a\n\nb\n"), (21, "word " * 40_000), (None, "no id"), (None, None),
]
CLASHING = "doc_id long, text string"


def table(spark, rows):
    return spark.createDataFrame(rows, CLASHING).withColumns({c: F.lit(1) for c in ("size", "kept", "keep_id", "digest", "id", "th", "rid", "w", "h", "pos", "batch", "lines", "spans", "items", "shard")})


def test_exact_dedup(spark):
    got = exact_dedup.exact_dedup(table(spark, ROWS)).collect()
    assert len(got) == len(ROWS)
    groups = collections.defaultdict(list)
    for i, t in ROWS:
        groups[hashlib.sha256((t or "").translate(LOW).encode()).hexdigest()].append(i)
    for r in got:
        own = groups[r.text_sha256]
        assert (r.group_size, r.keep_id) == (len(own), max((i for i in own if i is not None), default=None))
    kept = collections.Counter(r.text_sha256 for r in got if r.kept)
    assert kept == dict.fromkeys(groups, 1)
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0


def test_cuckoo_index():
    index = exact_dedup.CuckooIndex(capacity=4, max_kicks=8)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for i, k in enumerate(keys):
        index.insert(k, i)
    assert index.resizes > 0 and index.size == 3000
    assert all(index.get(k) == i for i, k in enumerate(keys))
    assert all(index.delete(k) for k in keys[::2]) and index.size == 1500
    assert [index.get(k) is None for k in keys] == [i % 2 == 0 for i in range(3000)]
    assert not index.delete(keys[0])
    assert sorted(v for _, v in index.items()) == list(range(1, 3000, 2))


def brute_lines(rows):
    keys = lambda t: [line.strip(" \t\n\x0b\x0c\r").translate(LOW) for line in (t or "").split("\n")]
    holders = collections.defaultdict(set)
    for i, t in rows:
        for k in keys(t):
            if len(k) >= 40:
                holders[k].add(-1 if i is None else i)
    out = []
    for i, t in rows:
        parts = (t or "").split("\n")
        stay = [p for p, k in zip(parts, keys(t), strict=True) if not (len(holders[k]) >= 5 and max(holders[k]) != (-1 if i is None else i))]
        out.append((i, len(parts), len(parts) - len(stay), "\n".join(stay)))
    return collections.Counter(out)


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_line_dedup(spark, batches):
    got = line_dedup.line_dedup(table(spark, ROWS), batches=batches)
    assert collections.Counter(map(tuple, got.collect())) == brute_lines(ROWS)
    assert line_dedup.line_dedup(table(spark, []), batches=batches).count() == 0


BENCH = [(1, " ".join(f"w{i}" for i in range(20))), (2, "short one"), (3, None), (4, "...!"), (10, " ".join(f"W{i}" for i in range(13))), (11, "short ONE")]
DOCS = [
    (1, "x " + " ".join(f"w{i}" for i in range(15)) + " y"), (2, "A Short, one! and more words here"), (3, None), (4, ""), (5, "!!"), (5, "!!"),
    (6, " ".join(f"z{i}" for i in range(500)) + " short one"), (7, " ".join(f"w{i}" for i in range(12))), (None, "short one short one"), (8, "wort " * 50_000 + "short one"),
]


def brute_hits(text, bench):
    words = lambda t: re.findall(WORD, (t or "").translate(LOW))
    w, hit, items = words(text), set(), set()
    for item, t in bench:
        b = words(t)
        n = min(13, len(b))
        grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if b else set()
        for i in range(len(w) - n + 1) if b else ():
            if tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                items.add(str(item))
    return len(w), len(hit), len(items), sorted(items), bool(hit) and 20 * len(hit) >= len(w)


def test_contamination(spark, monkeypatch):
    bench = spark.createDataFrame(BENCH, "item_id int, text string")
    for limit in (decontamination.MAX_BROADCAST_WINDOWS, 1):
        monkeypatch.setattr(decontamination, "MAX_BROADCAST_WINDOWS", limit)
        got = decontamination.contamination(table(spark, DOCS), bench).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, *brute_hits(t, BENCH))) for i, t in DOCS)
    assert decontamination.contamination(table(spark, []), bench).count() == 0
    assert decontamination.contamination(table(spark, DOCS), bench.limit(0)).filter("n_hit > 0").count() == 0


def test_remove_spans(spark):
    bench = spark.createDataFrame(BENCH, "item_id int, text string")
    got = {r.doc_id: r.text for r in decontamination.remove_spans(table(spark, DOCS), bench).collect()}
    assert got[2] == "A and more words here" and got[3] is None and got[5] == "!!" and got[1] == "x y"
