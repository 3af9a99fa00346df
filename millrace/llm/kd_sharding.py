"""Sharding by a k-d tree over document metadata; DataFrame functions only.

The tree splits units: a unit is all rows of one text, with their bytes together and the metadata of its smallest id, so
that equal texts get one leaf. Only a text with more than ALLOWANCE of a shard's bytes is cut, into pieces that are
neighbours in every dimension. A dimension of a unit is one 63-bit key: 16 bits of the metadata value, scaled by its
range over all units, then bits of the text's hash and the piece, so that units with equal values are still in one order
and a value that holds a third of the bytes can be cut. A level of the tree takes the widest dimension of each node and
finds the key at the wanted share of the node's bytes by histograms that are summed in the cluster and refined around
the target, so that no sort is needed. A unit that lies across the wanted share is put on one side by itself and the cut
moves on over the others, so large units do not spoil the balance. A level's splits are one row
for each node, which bounds what is broadcast. Rows meet their units' leaves again by hash. Slots come from counts of small buckets and a rank within them.
"""

from __future__ import annotations

import math
import os
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import join_groups, literal_table, read
from millrace.storage import materialize, tidy

SHARDS = 16
#: Rows of histograms that a pass sends to the driver, at most, over all nodes.
BINS = 32_768
#: A split is fine enough when its last bin holds this share of the node's bytes.
FINE = 0.0005
#: A unit across the cut is put on a side by itself if the cut beside it would be uneven by more than this share of the node's bytes; so many at most.
EVEN, MOVES = 0.001, 16
#: A text with more than this share of a shard's bytes is cut, into pieces of this share.
ALLOWANCE, PIECE = 0.5, 1 / 64
SLOT_ROWS = 50_000
DIMENSIONS = ("source", "lang", "size", "id")
KEYS = tuple(f"k_{d}" for d in DIMENSIONS)
TIE_BITS, PIECE_BITS = 47, 24
TOP = (1 << 63) - 1


@dataclass
class Split:
    """The cut of a node: keys of dimension `dim` under `at` go left, but for those in `left` and `right`."""

    dim: int
    at: int
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)


def _key_of(dim: Column, keys: tuple[str, ...]) -> Column:
    out = F.col(keys[0])
    for i, k in enumerate(keys[1:], 1):
        out = F.when(dim == i, F.col(k)).otherwise(out)
    return out


def _advance(s: dict, bins: list[tuple], shift: int, fine: float) -> None:
    """Moves the search in a node on by one histogram: rows (first key, last key, bytes, bin) of the keys between lo and hi."""
    split = s["split"]
    while True:
        below = s["below"]
        for i, (a, b, size, at) in enumerate(bins):
            if below + size >= s["want"]:
                break
            below += size
        else:
            split.at, s["done"] = s["hi"] + 1, True
            return
        under, over = s["want"] - below, below + size - s["want"]
        if size <= fine * s["bytes"] or (a == b and (min(under, over) <= EVEN * s["bytes"] or len(split.left) + len(split.right) == MOVES)):
            split.at, s["done"] = (a if under < over else b + 1), True
            return
        if a != b:
            s |= {"lo": s["lo"] + (at << shift), "hi": min(s["lo"] + ((at + 1) << shift) - 1, s["hi"]), "below": below}
            return
        # one key lies across: it goes to one side by itself, and the cut is sought among the others
        del bins[i]
        if under < over:
            split.right.append(a)
        else:
            split.left.append(a)
            s["want"] -= size
        if s["want"] < s["below"] or s["want"] > s["below"] + sum(x[2] for x in bins):  # the cut is outside of these bins
            if (s["lo"], s["hi"]) != (s["low"], s["high"]):
                s |= {"lo": s["low"], "hi": s["high"], "below": 0}
                return


def find_splits(units: DataFrame, counts: dict[int, int], fine: float = FINE, keys: tuple[str, ...] = KEYS) -> dict[int, Split]:
    """A split for each node that has several leaves. units: node, bytes and the keys; counts: leaves of each node."""
    ranges = [F.struct((F.shiftright(F.max(k), TIE_BITS) - F.shiftright(F.min(k), TIE_BITS)).alias("w"), F.lit(-i).alias("i"), F.min(k).alias("lo"), F.max(k).alias("hi")) for i, k in enumerate(keys)]
    open_nodes = F.broadcast(literal_table(units.sparkSession, [{"node": n} for n, c in counts.items() if c > 1], "node: int"))
    state: dict[int, dict] = {}
    for r in units.join(open_nodes, "node").groupBy("node").agg(F.sum("bytes").alias("bytes"), F.greatest(*ranges).alias("r")).collect():  # one row for each node
        n = r["node"]
        want = r["bytes"] * (counts[n] // 2) // counts[n]
        state[n] = {"bytes": r["bytes"], "want": want, "low": r["r"]["lo"], "high": r["r"]["hi"], "lo": r["r"]["lo"], "hi": r["r"]["hi"], "below": 0, "split": Split(-r["r"]["i"], 0), "done": False}
    while todo := {n: s for n, s in state.items() if not s["done"]}:
        room = max(2, BINS // len(todo))
        shift = {n: max(0, (s["hi"] - s["lo"] + 1).bit_length() - room.bit_length() + 1) for n, s in todo.items()}
        asked = [{"node": n, "dim": s["split"].dim, "lo": s["lo"], "hi": s["hi"], "shift": shift[n], "out": s["split"].left + s["split"].right} for n, s in todo.items()]
        frame = literal_table(units.sparkSession, asked, "node: int, dim: int, lo: bigint, hi: bigint, shift: int, out: array<bigint>")
        keyed = units.join(F.broadcast(frame), "node").select("node", "bytes", "lo", "hi", "shift", "out", _key_of(F.col("dim"), keys).alias("key"))
        inside = keyed.filter("key between lo and hi and not array_contains(out, key)")
        by_node: dict[int, list[tuple]] = {}
        for r in inside.groupBy("node", F.expr("shiftright(key - lo, shift)").alias("bin")).agg(F.sum("bytes").alias("bytes"), F.min("key").alias("a"), F.max("key").alias("b")).collect():  # BINS rows and two a node, at most
            by_node.setdefault(r["node"], []).append((r["a"], r["b"], r["bytes"], r["bin"]))
        for n, s in todo.items():
            _advance(s, sorted(by_node.get(n, [])), shift[n], fine)
    return {n: s["split"] for n, s in state.items()}


def descend(units: DataFrame, splits: dict[int, Split], counts: dict[int, int]) -> DataFrame:
    """The units in the nodes of the next level: node n keeps its number on the left; on the right it becomes n + its left leaves."""
    asked = [{"node": n, "dim": s.dim, "at": min(s.at, TOP), "first": s.left, "second": s.right, "step": counts[n] // 2} for n, s in splits.items()]
    frame = literal_table(units.sparkSession, asked, "node: int, dim: int, at: bigint, first: array<bigint>, second: array<bigint>, step: int")
    keyed = units.join(F.broadcast(frame), "node", "left").withColumn("key", _key_of(F.col("dim"), KEYS))
    right = F.expr("dim is not null and not array_contains(first, key) and (array_contains(second, key) or key >= at)")
    return keyed.withColumn("node", F.when(right, F.col("node") + F.col("step")).otherwise(F.col("node"))).select(*units.columns)


def _text_code(value: Column, low: str | None, high: str | None) -> tuple[Column, float, float]:
    """An order-preserving number of a string, six bytes behind what all strings begin with, and its range; null is below all."""
    a, b = (low or "").encode(), (high or "").encode()
    skip = len(os.path.commonprefix([a, b]))

    def number(raw: bytes) -> float:
        return float(int.from_bytes(raw[skip : skip + 6].ljust(6, b"\0"), "big"))

    code = F.conv(F.hex(F.rpad(F.substring(F.encode(value, "UTF-8"), skip + 1, 6), 6, F.lit(b"\0"))), 16, 10).cast("double")
    return code, number(a), number(b)


def kd_units(docs: DataFrame, shards: int | None, target_bytes: int | None, id_col: str, text_col: str, source_col: str, lang_col: str) -> tuple[DataFrame, DataFrame, int, int]:
    """(rows, units, number of rows, shards). rows: rid, id, size, crc, h1, h2, piece; units: h1, h2, piece, bytes, n, node (0) and the keys."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    packed = docs.select(
        F.struct(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2"), F.col(source_col).alias("source"), F.col(lang_col).alias("lang")).alias("r")
    )
    rows = materialize(packed.select(F.monotonically_increasing_id().alias("rid"), "r.*"), "kd-rows")
    first = F.min(F.struct(F.col("id"), F.col("source"), F.col("lang")))
    whole = materialize(rows.groupBy("h1", "h2").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.max("size").alias("size"), first.alias("m")), "kd-texts")
    meta = {x: F.col(f"m.{x}") for x in ("id", "source", "lang")}
    got = whole.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *[f(c).alias(f"{f.__name__}_{k}") for k, c in (meta | {"size": F.col("size")}).items() for f in (F.min, F.max)]).first()
    total, n_rows = got["bytes"], got["n"]
    if target_bytes:
        shards = max(1, -(-total // target_bytes))
    target = max(1, total / shards)
    pieces = F.ceil(F.col("bytes") / (target * PIECE)).cast("int")
    # texts over the allowance: fewer than shards / ALLOWANCE
    large = whole.filter(F.col("bytes") > target * ALLOWANCE).select("h1", "h2", "m", "size", pieces.alias("pieces"))
    place = F.pmod(F.xxhash64("rid"), F.col("pieces")).cast("int")
    dealt = rows.join(F.broadcast(large.select("h1", "h2", "pieces")), ["h1", "h2"], "left").select("rid", "id", "size", "crc", "h1", "h2", F.coalesce(place, F.lit(0)).alias("piece"))
    cut = rows.select("rid", "h1", "h2", F.col("size").alias("own")).join(F.broadcast(large), ["h1", "h2"]).groupBy("h1", "h2", place.alias("piece")).agg(F.sum("own").alias("bytes"), F.count(F.lit(1)).alias("n"), F.max("size").alias("size"), F.max("m").alias("m"))
    units = whole.join(F.broadcast(large.select("h1", "h2")), ["h1", "h2"], "left_anti").withColumn("piece", F.lit(0)).unionByName(cut)

    def scaled(value: Column, low: float, high: float) -> Column:
        """Null as 0, others from 1 to 65535."""
        return F.coalesce(F.least(F.lit(65534), F.floor((value - low) / max(high - low, 1e-9) * 65534)).cast("long") + 1, F.lit(0).cast("long"))

    sizes, ids = (got["min_size"] or 1, got["max_size"] or 1), (float(got["min_id"] or 0), float(got["max_id"] or 0))
    values = [
        scaled(*_text_code(meta["source"], got["min_source"], got["max_source"])), scaled(*_text_code(meta["lang"], got["min_lang"], got["max_lang"])),
        scaled(F.log2(F.col("size").cast("double")), *map(math.log2, sizes)), scaled(meta["id"].cast("double"), *ids),
    ]
    tie = F.shiftleft(F.shiftrightunsigned(F.col("h1"), 64 - TIE_BITS + PIECE_BITS), PIECE_BITS).bitwiseOR(F.col("piece").cast("long"))
    keyed = units.select("h1", "h2", "piece", "bytes", "n", F.lit(0).alias("node"), *[F.shiftleft(v, TIE_BITS).bitwiseOR(tie).alias(k) for k, v in zip(KEYS, values, strict=True)])
    return dealt, materialize(keyed, "kd-units"), n_rows, shards


@tidy
def kd_shards(docs: DataFrame, shards: int | None = SHARDS, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """Puts every row into one shard so that the shards' bytes are near equal (law `bytes`) and equal texts stay together.

    Give the number of shards, or target_bytes for leaves of that size at most. A row's size is the UTF-8 bytes of its
    text plus 1, so null and empty texts count 1 and are equal. Rows of one text, repeated rows too, share a shard unless
    the text holds more than half of a shard's bytes; then its rows are dealt by hash into pieces that lie next to each
    other. Nulls in the metadata come before all values; ties are ordered by the hash of the text. Returns id, size,
    text_crc32, law, shard, slot (from 0 without gaps in each shard), grown_shard (null). An empty table gives no rows;
    extra columns are not read.
    """
    rows, units, n_rows, shards = kd_units(docs, shards, target_bytes, id_col, text_col, source_col, lang_col)
    counts = {0: shards}
    tree = units
    level = 0
    while n_rows and max(counts.values()) > 1:
        splits = find_splits(tree, counts)
        tree = descend(tree, splits, counts)
        for n in [n for n, c in counts.items() if c > 1]:
            left = counts[n] // 2
            counts |= {n: left, n + left: counts[n] - left}
        level += 1
        if level % 6 == 0:
            tree = materialize(tree, "kd-level")
    leaves = materialize(tree.select("h1", "h2", "piece", "n", F.col("node").alias("shard")), "kd-leaves")
    buckets = max(16, -(-n_rows // (shards * SLOT_ROWS)))
    joined = join_groups(rows, leaves, ["h1", "h2", "piece"], "n", max(1, n_rows))
    placed = materialize(joined.select("id", "size", "crc", "rid", "shard", F.pmod(F.xxhash64("rid"), F.lit(buckets)).cast("int").alias("part")), "kd-placed")
    parts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("shard", "part", before.alias("first"))  # shards * buckets rows
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id", "rid")) - 1
    return placed.withColumn("rank", rank).join(F.broadcast(offsets), ["shard", "part"]).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first") + F.col("rank")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(read(spark, sf_dir, "documents"))
