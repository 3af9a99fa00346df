"""Near-duplicate classes by DartMinHash signatures of weighted word shingles.

A document is the weighted set of its five-word shingles, each with its number of occurrences. Every shingle owns
regions of weight: [0, 1), [1, 3), [3, 7) and so on. Darts land in a region as a Poisson process along the rank axis,
drawn from hashes of shingle and region alone, so equal regions of two documents hold equal darts; a dart counts if it
lands below the shingle's weight. Only darts with rank under about t / total weight are thrown. Each dart belongs to one
of K coordinates and the earliest one of a coordinate is its entry: two entries agree with the probability of the
weighted Jaccard similarity.

Documents with equal sets are one node. Nodes that agree on all rows of a band share a bucket. In each bucket every
node is compared with the bucket's leader, the node that shares most buckets, which links a group of copies without
its pairs. In buckets that are still of several components the other pairs are compared block by block by their
signatures; only nodes of likely pairs have their texts sent, once for each block, where a forest of links is verified.
All links are verified on the weights of the shingles' 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import join_groups, read
from millrace.llm.components import components
from millrace.storage import drop_path, materialize, table_path, tidy

SHINGLE = 5
#: Similarity of a link as a fraction.
SIMILAR = (4, 5)
BANDS, ROWS = 32, 6
K = BANDS * ROWS
#: Expected darts: enough that all coordinates are hit in most documents; the others get twice as many, and so on.
DARTS = K * np.log(K) + 2 * K
#: Share of agreeing coordinates from which a pair of a block is compared by text: five standard deviations under 0.8.
LIKELY = 0.66
#: Bytes of text that are hashed at once, shingles that throw darts at once, nodes and words of a block, pairs of one leader in a task.
SLICE, THROWN, BLOCK, BLOCK_WORDS, PAIRS = 1_000_000, 300_000, 256, 4_000_000, 400

U = np.uint64


def gold(n: int) -> np.uint64:
    """A salt for each number."""
    return U(0x9E3779B97F4A7C15 * n % 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a 64-bit number."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _unit(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1]."""
    return ((x >> U(11)).astype(np.float64) + 1) * 2.0**-53


#: For each byte: whether it is part of a word once A-Z are lower-cased, and a random number for its lower case.
_LOWERED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
_IN_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b > 127 for b in _LOWERED])
_VALUE = mix(_LOWERED.astype(np.uint64) * gold(3) + gold(5))
_BASE = 0x2545F4914F6CDD1D
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n of each; kept by the process."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.cumprod(np.r_[U(1), np.full(n - 1, x, dtype=np.uint64)]) for x in (U(_BASE), U(pow(_BASE, -1, 2**64)))]
    return _powers


def _edges(inside: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of words and the bytes behind them; no word goes over a border."""
    before, behind = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], behind[:-1] = inside[:-1], inside[1:]
    before[borders], behind[borders - 1] = False, False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~behind) + 1


def _finished(sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return mix(sums + sizes.astype(np.uint64) * gold(7))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, offsets of each text's words) of UTF-8 texts that stand one after the other.

    A word's hash is a polynomial of its bytes' numbers, taken from running sums, so that no word is cut out as a string.
    """
    starts, ends = _edges(_IN_WORD[data], offsets[(offsets > 0) & (offsets < len(data))])
    power, inverse = _power_tables(max(2, len(data)))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUE[data] * power[: len(data)], out=sums[1:])
    return _finished((sums[ends] - sums[starts]) * inverse[starts], ends - starts), np.searchsorted(starts, offsets)


def long_word_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of one long text, slice by slice; a word may go on over any number of slices."""
    out, carry, held = [], 0, 0  # the sum and the length of a word that is still open
    for at in range(0, len(data), SLICE):
        part = data[at : at + SLICE]
        starts, ends = _edges(_IN_WORD[part], np.zeros(0, dtype=np.int64))
        power, inverse = _power_tables(SLICE + 1)
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_VALUE[part] * power[: len(part)], out=sums[1:])
        sums, sizes = (sums[ends] - sums[starts]) * inverse[starts], ends - starts
        if held and len(starts) and starts[0] == 0:
            sums[0] = U((carry + int(sums[0]) * pow(_BASE, held, 2**64)) % 2**64)
            sizes[0] += held
        elif held:
            sums, sizes = np.r_[U(carry), sums], np.r_[held, sizes]
        carry, held = (int(sums[-1]), int(sizes[-1])) if len(ends) and ends[-1] == len(part) else (0, 0)
        done = len(sums) - bool(held)
        out.append(_finished(sums[:done], sizes[:done]))
    return np.concatenate([*out, _finished(np.array([carry], dtype=np.uint64), np.array([held]))] if held else out)


def weighted_sets(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, weight) of distinct shingles, sorted by document; hashes: of the words of all documents."""
    if len(offsets) == 2 and len(hashes) >= SHINGLE:  # one text, which may be long
        shingle = np.empty(len(hashes) - SHINGLE + 1, dtype=np.uint64)
        for at in range(0, len(shingle), SLICE):
            part = hashes[at : at + SLICE + SHINGLE - 1]
            size = len(part) - SHINGLE + 1
            shingle[at : at + size] = mix(sum((mix(part[j : j + size] + gold(j + 1)) for j in range(SHINGLE)), np.zeros(size, dtype=np.uint64)))
        shingle.sort()
        first = np.flatnonzero(np.r_[True, shingle[1:] != shingle[:-1]])
        return np.zeros(len(first), dtype=np.int64), shingle[first], np.diff(np.r_[first, len(shingle)])
    n = np.diff(offsets)
    docs = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(hashes)) - offsets[docs]
    whole = at <= n[docs] - SHINGLE
    acc = np.zeros(len(hashes), dtype=np.uint64)
    for j in range(min(SHINGLE, len(hashes))):
        acc[: len(acc) - j] += mix(hashes[j:] + gold(j + 1))
    d, s = [docs[whole]], [mix(acc[whole])]
    for size in range(1, SHINGLE):
        own = np.flatnonzero(n == size)
        short = sum((mix(hashes[offsets[own] + j] + gold(j + 1)) for j in range(size)), np.zeros(len(own), dtype=np.uint64))
        d.append(own), s.append(mix(short + U(size)))
    doc, shingle = np.concatenate(d), np.concatenate(s)
    order = np.lexsort((shingle, doc))
    doc, shingle = doc[order], shingle[order]
    first = np.flatnonzero(np.r_[np.ones(min(1, len(doc)), bool), (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])])
    return doc[first], shingle[first], np.diff(np.r_[first, len(doc)])


def throw(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Earliest dart of each document and coordinate with rank under the document's limit; infinite where there is none."""
    best = np.full(len(limit) * K, np.inf)
    for at in range(0, len(doc), THROWN):
        _throw(doc[at : at + THROWN], element[at : at + THROWN], weight[at : at + THROWN], limit, best)
    return best.reshape(-1, K)


def _throw(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, limit: np.ndarray, best: np.ndarray) -> None:
    level = 0
    while True:
        low = 2**level - 1
        own = np.flatnonzero(weight > low)
        if not len(own):
            return
        d, w = doc[own], weight[own]
        seed = mix(element[own] + gold(level + 1))
        rank = np.zeros(len(own))
        dart = 0
        while len(seed):
            dart += 1
            draw = mix(seed ^ gold(dart))
            rank = rank - np.log(_unit(draw)) * 2.0**-level
            live = rank < limit[d]
            seed, rank, d, w, draw = seed[live], rank[live], d[live], w[live], draw[live]
            spot = (mix(draw ^ U(0x5851F42D4C957F2D)) % U(K)).astype(np.int64)
            under = low + 2**level * _unit(mix(draw ^ U(0x14057B7EF767814F))) <= w
            if under.all():
                np.minimum.at(best, d * K + spot, rank)
            else:
                np.minimum.at(best, (d * K + spot)[under], rank[under])
        level += 1


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Of each document: total weight, two hashes of its weighted set, band values, and a 16-bit mark of each coordinate."""
    n = len(offsets) - 1
    doc, shingle, weight = weighted_sets(hashes, offsets)
    total = np.bincount(doc, weight, minlength=n)
    out = {"n": total.astype(np.int64)}
    for name, salt in (("c1", 1), ("c2", 2)):
        sums = np.zeros(n, dtype=np.uint64)
        np.add.at(sums, doc, mix(shingle ^ mix(weight.astype(np.uint64) + gold(salt))))
        out[name] = sums.view(np.int64)
    best = np.full((n, K), np.inf)
    todo, darts = np.flatnonzero(total > 0), DARTS
    while len(todo):
        place = np.full(n, -1)
        place[todo] = np.arange(len(todo))
        mine = place[doc] >= 0
        best[todo] = throw(place[doc[mine]], shingle[mine], weight[mine], darts / total[todo])
        todo = todo[np.isinf(best[todo]).any(axis=1)]
        darts *= 2
    marks = mix(best.view(np.uint64) + np.arange(1, K + 1, dtype=np.uint64) * gold(1))
    out["bands"] = mix(marks.reshape(n, BANDS, ROWS).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
    out["marks"] = (marks & U(0xFFFF)).astype("<u2")
    return out


def among(rows: DataFrame, some: DataFrame) -> DataFrame:
    """The rows whose rid some has, without a shuffle of rows: both rids are marked in bitmaps of 4 KB for 32 768 numbers, which are broadcast.

    rid is monotonically_increasing_id(), dense in each partition of its table: an eighth of a byte for each row and 4 KB for each partition.
    """
    bitmaps = some.groupBy(F.bitmap_bucket_number("rid").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("rid")).alias("bits"))
    place = F.bitmap_bit_position("rid")
    byte = F.conv(F.hex(F.substring("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = rows.withColumn("bucket", F.bitmap_bucket_number("rid")).join(F.broadcast(bitmaps), "bucket")
    return marked.filter(F.call_function("shiftright", byte, F.pmod(place, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1).drop("bucket", "bits")


SIGNATURE = "n long, c1 long, c2 long, bands array<long>, marks binary"


def _hashed(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word hashes and offsets of groups of texts of about SLICE bytes together; a longer text is a group of its own."""
    texts = pc.fill_null(column, "").cast(pa.large_binary())
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
    start = 0
    while start < len(texts):
        end = int(np.searchsorted(offsets, offsets[start] + SLICE, side="right")) - 1
        end = min(max(start + 1, end), len(texts))
        part = raw[offsets[start] : offsets[end]]
        if len(part) > SLICE:
            hashes = long_word_hashes(part)
            yield hashes, np.array([0, len(hashes)])
        else:
            yield word_hashes(part, offsets[start : end + 1] - offsets[start])
        start = end


def _signature(column: pa.Array) -> pa.Array:
    parts = [signatures(*x) for x in _hashed(column)]
    if not parts:
        return pa.array([], type=pa.struct([("n", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("bands", pa.list_(pa.int64())), ("marks", pa.binary())]))
    whole = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    bands = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(column) + 1) * BANDS, BANDS), pa.int32()), pa.array(whole["bands"].reshape(-1)))
    marks = pa.array([m.tobytes() for m in whole["marks"]], pa.binary())
    return pa.StructArray.from_arrays([pa.array(whole["n"]), pa.array(whole["c1"]), pa.array(whole["c2"]), bands, marks], ["n", "c1", "c2", "bands", "marks"])


def shingle_sets(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(sorted hashes, weights) of the shingles of each text."""
    out = []
    for hashes, offsets in _hashed(texts):
        doc, shingle, weight = weighted_sets(hashes, offsets)
        edges = np.searchsorted(doc, np.arange(len(offsets)))
        out += [(shingle[a:b], weight[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return out


def similar(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> bool:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return SIMILAR[1] * both >= SIMILAR[0] * (int(a[1].sum()) + int(b[1].sum()) - both) > 0


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, held = None, None
    for whole in batches:
        for start in range(0, len(whole), 256):
            b = whole.slice(start, 256)
            sets, hubs, keep = shingle_sets(b.column("text_u")), b.column("v").to_numpy(), np.zeros(len(b), dtype=bool)
            for at, hub in enumerate(hubs):
                if hub != last:
                    last, held = hub, shingle_sets(b.column("text_v").slice(at, 1))[0]
                keep[at] = similar(held, sets[at])
            yield b.select(["u", "v"]).filter(pa.array(keep))


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) whose weighted similarity suffices. A v with many pairs is spread over as many copies of its text."""
    pairs = materialize(pairs, "dart-pairs")
    hubs = materialize(pairs.groupBy("v").agg(F.count(F.lit(1)).alias("n")), "dart-hubs")
    copies = F.ceil(F.col("n") / PAIRS).cast("int")
    salted = join_groups(pairs, hubs, ["v"], "n", max(1, pairs.count())).select("u", "v", F.pmod(F.xxhash64("u"), copies).cast("int").alias("salt"))
    spread = among(texts, hubs.select(F.col("v").alias("rid"))).join(hubs, F.col("v") == F.col("rid")).select("v", F.col("text").alias("text_v"), F.explode(F.sequence(F.lit(0), copies - 1)).alias("salt"))
    full = among(texts, pairs.select(F.col("u").alias("rid"))).join(salted, F.col("u") == F.col("rid")).select("u", "v", "salt", F.col("text").alias("text_u"))
    joined = full.join(spread, ["v", "salt"]).select("u", "v", "text_u", "text_v")
    return joined.mapInArrow(_verified, "u long, v long")


def _likely(marks: np.ndarray, label: np.ndarray, side: np.ndarray, band: int, i: int, j: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(node, other nodes, agreement) of the pairs of different components in a block, or between its two sides, whose marks mostly agree; each in the bucket of its first common band only."""
    for at in range(len(label)):
        if i != j and side[at] != i:
            continue
        other = np.flatnonzero((label != label[at]) & ((side != side[at]) if i != j else (np.arange(len(label)) > at)))
        same = marks[other] == marks[at]
        share = same.mean(axis=1)
        good = share >= LIKELY
        other, share, same = other[good], share[good], same[good]
        first = same.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band
        if first.any():
            yield at, other[first], share[first]


def _block(table: pa.Table) -> tuple[pa.Table, tuple]:
    """A block in the order of its nodes, and what _likely() asks of it."""
    table = table.sort_by("rid")
    marks = np.frombuffer(b"".join(table.column("marks").to_pylist()), dtype="<u2").reshape(len(table), K)
    band, i, j = (table.column(c)[0].as_py() for c in ("band", "i", "j"))
    return table, (marks, table.column("label").to_numpy(), table.column("side").to_numpy(), band, i, j)


def _block_nodes(table: pa.Table) -> pa.Table:
    """The nodes of a block that are in a likely pair: at most all of them, however many pairs there are."""
    table, asked = _block(table)
    hit = np.zeros(len(table), dtype=bool)
    for at, other, _ in _likely(*asked):
        hit[at] = hit[other] = True
    return table.filter(pa.array(hit))


def _block_links(table: pa.Table) -> pa.Table:
    """Verified links of a block as a forest: no link that earlier ones imply. Pairs that agree most come first, so that most others are already connected."""
    table, asked = _block(table)
    sets, rid, label = shingle_sets(table.column("text").combine_chunks()), table.column("rid").to_pylist(), table.column("label").to_pylist()
    pairs = sorted((-s, at, int(o)) for at, other, share in _likely(*asked) for o, s in zip(other, share, strict=True))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    out = []
    for _, a, b in pairs:
        if (x := root(label[a])) != (y := root(label[b])) and similar(sets[a], sets[b]):
            parent[x] = y
            out.append((rid[a], rid[b]))
    return pa.table({"u": pa.array([u for u, _ in out], pa.int64()), "v": pa.array([v for _, v in out], pa.int64())})


@tidy
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows has row (a struct of all columns of docs), rid, c1, c2; classes has c1, c2, class_id, class_size, keep_rid, n for each distinct set.

    Rows without words are not in a class.
    """
    rows = materialize(
        docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*docs.columns).alias("row"))
        .select("rid", "row", F.arrow_udf(_signature, SIGNATURE)(F.col("row")[text_col]).alias("s")).select("rid", "row", "s.*"),
        "dart-rows",
    )
    worded = rows.filter("n > 0")
    sets = materialize(worded.groupBy("c1", "c2").agg(F.min("rid").alias("rid"), F.count(F.lit(1)).alias("copies"), F.max(F.struct(F.col("row")[id_col].alias("id"), "rid")).alias("top")), "dart-sets")
    nodes = among(worded.select("rid", "bands", "n"), sets.select("rid"))
    keyed = materialize(nodes.select("rid", "n", F.posexplode("bands").alias("band", "value")).select("rid", "n", "band", F.xxhash64("band", "value").alias("key")), "dart-keys")
    buckets = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("words")).filter("size > 1"), "dart-buckets")
    total = max(1, keyed.count())
    members = materialize(join_groups(keyed.drop("n"), buckets, ["key"], "size", total), "dart-members")
    drop_path(docs.sparkSession, table_path(keyed)) if total > 1 else None

    # leaders: the node that shares most buckets, by their sizes
    weight = members.groupBy("rid").agg(F.sum("size").alias("weight"))
    ranked = members.join(weight, "rid")
    leaders = materialize(ranked.groupBy("key").agg(F.max(F.struct("weight", F.col("rid").alias("r"))).alias("top"), F.first("size").alias("size")).select("key", F.col("top.r").alias("leader"), "size"), "dart-leaders")
    pairs = join_groups(members.select("key", "rid"), leaders, ["key"], "size", total).filter("rid <> leader").select(F.col("rid").alias("u"), F.col("leader").alias("v")).distinct()
    texts = materialize(among(worded.select("rid", F.col("row")[text_col].alias("text")), weight.select("rid")), "dart-texts")
    links = materialize(_verify(pairs, texts), "dart-links")
    labels = components(links)

    # buckets that are still of several components, the leader's pairs aside
    tagged = members.filter("size > 2").join(labels.withColumnRenamed("node", "rid"), "rid", "left").withColumn("label", F.coalesce("label", "rid"))
    tagged = materialize(tagged, "dart-tagged")
    parted = materialize(tagged.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.first("size").alias("n")).filter("a <> b").select("key", "n"), "dart-parted")
    mixed = join_groups(tagged, parted, ["key"], "n", total)
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("words") / BLOCK_WORDS)).cast("int")
    full = mixed.join(worded.select("rid", "marks"), "rid")
    spread = full.select("key", "band", "rid", "label", "marks", F.pmod(F.xxhash64("rid"), blocks).cast("int").alias("side"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    spread = spread.select("key", "band", "rid", "label", "marks", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
    block = "key long, band int, rid long, label long, marks binary, side int, i int, j int"
    likely = materialize(spread.groupBy("key", "i", "j").applyInArrow(_block_nodes, block), "dart-likely")
    sent = likely.join(among(texts, likely.select("rid")), "rid").select("key", "band", "rid", "label", "marks", "side", "i", "j", "text")
    more = materialize(sent.groupBy("key", "i", "j").applyInArrow(_block_links, "u long, v long"), "dart-links-2")
    final = components(links.unionByName(more))

    labelled = materialize(sets.join(final.withColumnRenamed("node", "rid"), "rid", "left").select("c1", "c2", "copies", "top", F.coalesce("label", "rid").alias("label")), "dart-labelled")
    classes = materialize(labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n_sets"), F.sum("copies").alias("class_size"), F.max("top").alias("best")), "dart-classes")
    out = join_groups(labelled, classes, ["label"], "n_sets", max(1, labelled.count()))
    return rows.select("rid", "row", "c1", "c2", F.col("n").alias("weight")), materialize(out.select("c1", "c2", F.col("copies"), "class_size", F.col("best.id").alias("class_id"), F.col("best.rid").alias("keep_rid")), "dart-out")


@tidy
def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, class_id (largest id of its class), class_size, kept.

    Documents are linked if the weighted Jaccard similarity of their five-word shingles (weight: occurrences; words as
    in common.words; fewer than five words are one shingle) is 0.8 or more; a class is what links connect. One row of a
    class is kept: the one with the largest id; of repeated rows one. Null ids are the smallest. A null text or one
    without words is a class of its own. Extra columns are not read; an empty table gives no rows.
    """
    rows, classes = near_duplicates(docs.select(id_col, text_col), id_col, text_col)
    rows = materialize(rows.select("rid", F.col("row")[id_col].alias("id"), "c1", "c2", "weight"), "dart-ids")
    total = max(1, rows.count())
    found = join_groups(rows.filter("weight > 0"), classes, ["c1", "c2"], "copies", total).select("id", "class_id", "class_size", (F.col("rid") == F.col("keep_rid")).alias("kept"))
    alone = rows.filter("weight = 0").select("id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    return found.unionByName(alone).select(F.col("id").alias(id_col), "class_id", "class_size", "kept")


@tidy
def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with one of each class, all columns kept; rows without words stay."""
    rows, classes = near_duplicates(docs, id_col, text_col)
    kept = classes.select(F.col("keep_rid").alias("rid"))
    return rows.filter("weight > 0").join(kept, "rid", "left_semi").unionByName(rows.filter("weight = 0")).select("row.*")


def op6_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read(spark, sf_dir, "documents"))
