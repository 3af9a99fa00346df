import random
import zlib

from millrace.llm import kd_sharding as kd

SF = "/root/testdata/sf0.01"


def plain_tree(units, shards):
    """The same tree over Python lists: every cut from a full sort of its node's keys."""
    nodes, leaves = {0: list(range(len(units)))}, {0: shards}
    while max(leaves.values()) > 1:
        for n in [n for n, c in leaves.items() if c > 1]:
            own, c = nodes[n], leaves[n]
            spread = [max(units[i][k] >> kd.TIE_BITS for i in own) - min(units[i][k] >> kd.TIE_BITS for i in own) for k in kd.KEYS]
            key = kd.KEYS[spread.index(max(spread))]
            total = sum(units[i]["bytes"] for i in own)
            want, rows = total * (c // 2) // c, sorted(own, key=lambda i: units[i][key])
            left, right, moved = [], [], 0
            while True:
                below, across = 0, None
                for at, i in enumerate(rows):
                    if below + units[i]["bytes"] >= want:
                        across = at
                        break
                    below += units[i]["bytes"]
                if across is None:
                    left += rows
                    break
                size = units[rows[across]]["bytes"]
                under, over = want - below, below + size - want
                if size <= kd.FINE * total or min(under, over) <= kd.EVEN * total or moved == kd.MOVES:
                    cut = across if under < over else across + 1
                    left, right = left + rows[:cut], right + rows[cut:]
                    break
                alone, moved = rows.pop(across), moved + 1
                (right if under < over else left).append(alone)
                want -= 0 if under < over else size
            nodes[n], nodes[n + c // 2] = left, right
            leaves[n], leaves[n + c // 2] = c // 2, c - c // 2
    return {i: n for n, own in nodes.items() for i in own}


def test_equal_to_a_plain_tree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    _, units, n, shards = kd.kd_units(docs, 16, None, "doc_id", "text", "source", "lang")
    assert n == docs.count() and shards == 16
    rows = [r.asDict() for r in units.collect()]
    counts, tree = {0: 16}, units
    while max(counts.values()) > 1:
        splits = kd.find_splits(tree, counts)
        tree = kd.descend(tree, splits, counts)
        for m in [m for m, c in counts.items() if c > 1]:
            left = counts[m] // 2
            counts |= {m: left, m + left: counts[m] - left}
    want = plain_tree(rows, 16)
    got = {(r["h1"], r["h2"], r["piece"]): r["node"] for r in tree.collect()}
    assert got == {(rows[i]["h1"], rows[i]["h2"], rows[i]["piece"]): n for i, n in want.items()}


def test_texts_stay_together_and_sizes_are_even(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = kd.op7_kd_sharding(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    home, slots, size = {}, {}, [0] * 16
    for r in got:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        home.setdefault(docs[r.doc_id], set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
        size[r.shard] += r.size
    assert all(len(s) == 1 for s in home.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size) < 1.03 * sum(size) / 16 and min(size) > 0.97 * sum(size) / 16


def test_a_text_with_a_third_of_the_bytes_is_cut(spark):
    rng = random.Random(3)
    rows = [(i, "copy " * 40 if i % 3 == 0 else "x" * rng.randrange(60, 340), f"s{i % 5}", "en") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = kd.kd_shards(docs, 16).collect()
    size = [0] * 16
    home = {}
    for r in got:
        size[r.shard] += r.size
        home.setdefault(rows[r.doc_id][1], set()).add(r.shard)
    assert len(home["copy " * 40]) >= 5 and sum(len(s) > 1 for s in home.values()) == 1
    assert max(size) < 1.02 * sum(size) / 16


def test_nulls_repeats_clashing_names_and_no_rows(spark):
    schema = "doc_id long, text string, source string, lang string, node int, bytes string, piece string, rid int"
    rows = [(1, None, None, None, 5, "b", "p", 1), (1, None, None, None, 5, "b", "p", 1), (2, "", "s", None, None, None, None, 2), (None, "abc", "s", "en", 1, "b", "p", 3), (7, "abc", "t", "de", 1, "b", "p", 3)]
    got = kd.kd_shards(spark.createDataFrame(rows, schema), 4).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == [(False, 1, 1), (False, 1, 1), (False, 2, 1), (False, 7, 4), (True, 0, 4)]
    assert len({(r.shard, r.slot) for r in got}) == 5
    assert kd.kd_shards(spark.createDataFrame([], schema), 4).count() == 0


def test_leaves_reach_the_target(spark):
    docs = spark.createDataFrame([(i, f"{"y" * 99}{i}", "s", "en") for i in range(500)], "doc_id long, text string, source string, lang string")
    got = kd.kd_shards(docs, None, target_bytes=6000).groupBy("shard").sum("size").collect()
    assert len(got) == 9 and max(r[1] for r in got) < 6000 * 1.05
