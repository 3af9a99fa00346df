"""Benchmark decontamination by 13-word windows; DataFrame functions only.

Plan: each document's windows are tested inside the row against two small bit sets of the benchmark's windows, one by
the hashes of three words and one by the hash of all, so that only likely windows leave the row. Those carry their words and meet the benchmark's windows
in a hash join on the words themselves, which verifies them. The join is a broadcast while the windows and their items
are few enough by count and by bytes; otherwise Spark shuffles both sides. Coverage of a document is folded from the sorted hits.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import read, words
from millrace.storage import materialize, tidy

#: The same words before lower-casing.
CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 13
#: The most windows that are broadcast, and bytes of their words and items.
MAX_BROADCAST_WINDOWS, MAX_BROADCAST_BYTES = 200_000, 100_000_000
#: Bits of the bit set for each window, and its largest size as a power of two.
BITS_A_WINDOW = 128
MAX_BITS_LOG2 = 23


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct windows (gram, len, items): an item of fewer words than a window, but not none, is one window."""
    w = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(window))
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - length + 1), lambda i: F.array_join(F.slice(F.col("w"), i, length), " "))
    return w.select("item", length.alias("len"), F.explode(grams).alias("gram")).groupBy("gram", "len").agg(F.collect_set("item").alias("items"))


def _window_hash(hashes: Column, start: Column, length: int) -> Column:
    return F.xxhash64(F.slice(hashes, start + 1, length))


def _three_words(hashes: Column, start: Column, length: int) -> Column:
    """A cheap hash of a window's first, middle and last word."""
    middle, last = F.get(hashes, start + length // 2), F.get(hashes, start + (length - 1))
    return F.get(hashes, start).bitwiseXOR(F.shiftrightunsigned(middle, 7)).bitwiseXOR(F.shiftrightunsigned(last, 13))


def _bit_set(hashes: DataFrame, count: int) -> tuple[Column, int]:
    """Bits at the values of column h, as an array of longs of a bounded size, and its size in bits."""
    bits = 1 << min(MAX_BITS_LOG2, max(10, (count * BITS_A_WINDOW - 1).bit_length()))
    at = F.col("h").bitwiseAND(bits - 1)
    rows = hashes.select(F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()
    longs = [0] * (bits >> 6)
    for row in rows:
        longs[row["word"]] = row["bits"]
    return F.split(F.lit(",".join(map(str, longs))), ",").cast("array<bigint>"), bits  # folded into one literal


def _is_set(value: Column, bit_set: tuple[Column, int]) -> Column:
    longs, bits = bit_set
    at = value.bitwiseAND(bits - 1)
    return F.call_function("shiftrightunsigned", F.get(longs, F.shiftright(at, 6).cast("int")), at.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1


def _likely(hashes: Column, length: int, cheap: tuple[Column, int], whole: tuple[Column, int]) -> Column:
    """Starts of the windows of this length that both bit sets have: first by three words, then by all of them."""
    starts = F.when(F.size(hashes) >= length, F.sequence(F.lit(0), F.size(hashes) - length)).otherwise(F.array().cast("array<int>"))
    some = F.filter(starts, lambda i: _is_set(_three_words(hashes, i, length), cheap))
    return F.filter(some, lambda i: _is_set(_window_hash(hashes, i, length), whole))


def _covered(spans: Column) -> Column:
    """Positions that sorted (pos, len) spans cover."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def step(acc: Column, s: Column) -> Column:
        end = s["pos"] + s["len"]
        return F.struct((acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], s["pos"]))).cast("long").alias("n"), F.greatest(acc["end"], end).alias("end"))

    return F.aggregate(spans, start, step)["n"]


@tidy
def find_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(scanned, hits): scanned has row (a struct of keep's columns), rid and n_words for each row; hits has rid, spans (sorted pos, len) and items."""
    windows = materialize(benchmark_windows(benchmark, window=window), "bench-windows")
    size = F.octet_length("gram") + F.aggregate("items", F.lit(0).cast("long"), lambda acc, x: acc + F.octet_length(x) + 16)
    lengths = windows.groupBy("len").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")).collect()  # at most `window` rows
    by_length = {r["len"]: r["n"] for r in lengths}
    count, sent = sum(by_length.values()), sum(r["bytes"] for r in lengths)
    w, h = F.col("w"), F.col("h")
    found: Column = F.array().cast("array<struct<pos:int,len:int,gram:string>>")
    if count:
        hashed = windows.select("len", F.transform(F.split("gram", " "), lambda x: F.xxhash64(x)).alias("hw"))
        whole = _bit_set(hashed.select(F.xxhash64("hw").alias("h")), count)
        ends = functools.reduce(lambda acc, n: F.when(F.col("len") == n, _three_words(F.col("hw"), F.lit(0), n)).otherwise(acc), by_length, F.lit(None).cast("long"))
        cheap = _bit_set(hashed.select(ends.alias("h")), count)

        def carried(length: int) -> Column:
            return F.transform(_likely(h, length, cheap, whole), lambda i: F.struct(i.alias("pos"), F.lit(length).alias("len"), F.array_join(F.slice(w, i + 1, length), " ").alias("gram")))

        found = functools.reduce(F.concat, map(carried, sorted(by_length)))
    scanned = materialize(
        docs.select(F.struct(*keep).alias("row"), words(F.col(text_col)).alias("w"))
        .withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
        .select("row", F.monotonically_increasing_id().alias("rid"), F.size("w").cast("long").alias("n_words"), found.alias("likely")),
        "bench-scan",
    )
    grams = windows.select("gram", "items")
    if count <= MAX_BROADCAST_WINDOWS and sent <= MAX_BROADCAST_BYTES:
        grams = F.broadcast(grams)
    likely = scanned.filter(F.size("likely") > 0).select("rid", F.explode("likely").alias("l")).select("rid", "l.pos", "l.len", "l.gram")
    hits = likely.join(grams, "gram").groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("pos", "len"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    return scanned.drop("likely"), hits


def _contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per input row: id, n_words, n_hit, n_items, items (sorted as strings), contaminated.

    Words are [0-9a-z and beyond ASCII]+ after lower-casing A-Z; a word in any occurrence of a benchmark window is hit.
    A document is contaminated if it has hits and at least a twentieth of its words are hit. Null and empty texts have
    no words. Repeated rows are judged alike, each by itself; null ids are carried. Items of one id are one item; items
    without words give no window; an empty benchmark hits nothing. Extra columns are not read.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scanned, hits = find_hits(named, benchmark, keep=("id",), window=window)
    n_hit = F.coalesce(_covered(F.col("spans")), F.lit(0).cast("long"))
    items = F.array_sort(F.coalesce(F.col("items"), F.array().cast("array<string>")))
    return scanned.join(hits, "rid", "left").select(F.col("row.id").alias(id_col), "n_words", n_hit.alias("n_hit"), items.alias("items")).select(
        id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", _contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated")
    )


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """All columns of docs; hit words, each with the characters up to the next word, are cut out of the text."""
    scanned, hits = find_hits(docs, benchmark, text_col, keep=tuple(docs.columns), window=window)
    old = F.col("row")[text_col]
    pieces = scanned.join(hits.select("rid", "spans"), "rid", "left").select("row", "spans", F.regexp_extract_all(old, F.lit(CASED_WORD), 0).alias("words"), F.split(old, CASED_WORD, -1).alias("gaps"))
    hit = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["pos"], s["pos"] + s["len"] - 1))))
    stay = F.array_except(F.sequence(F.lit(0), F.size("words") - 1), hit)
    cut = F.concat(F.col("gaps")[0], F.array_join(F.transform(stay, lambda i: F.concat(F.col("words")[i], F.col("gaps")[i + 1])), ""))
    return pieces.select(F.col("row").withField(text_col, F.when(F.col("spans").isNull(), old).otherwise(cut)).alias("row")).select("row.*")


def remove_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of docs that are not contaminated, all columns kept."""
    scanned, hits = find_hits(docs, benchmark, text_col, keep=tuple(docs.columns), window=window)
    covered = hits.select("rid", _covered(F.col("spans")).alias("n_hit"))
    bad = scanned.select("rid", "n_words").join(covered, "rid").filter(_contaminated(F.col("n_hit"), F.col("n_words"))).select("rid")
    return scanned.join(bad, "rid", "left_anti").select("row.*")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, w, least(len(w), 13) AS n
  FROM (SELECT item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0
), g AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)
), x AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM b) WHERE len(w) >= n)
), h AS (
  SELECT doc_id, n, i, item_id FROM x JOIN g USING (n, gram)
), p AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id
), q AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN q USING (doc_id)
"""
