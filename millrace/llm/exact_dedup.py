"""Exact deduplication over a cuckoo-filter index of live digests.

Plan: the digest of each text is computed in the JVM; digests are pre-aggregated over salts, so that a group of copies
reaches its index as a few partial rows however large it is; each task of the index holds one range of the digests in a
cuckoo filter whose buckets also store the full keys. A row joins back to its group by digest; the few groups with over
a thousandth of all rows are joined by broadcast, the rest by a shuffle.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import HOT_SHARE, ascii_lower, read, task_count
from millrace.storage import materialize, tidy

SLOTS = 4
SALTS = 16
#: Rows of one task's index; more rows make more tasks.
INDEX_ROWS = 500_000


class CuckooIndex:
    """A cuckoo filter of 16-bit fingerprints whose buckets also hold the keys and values.

    contains() reads fingerprints only and may err; get(), insert() and delete() verify a hit against the stored key.
    When no place is found after max_kicks moves, the table doubles and is filled again from the stored keys.
    """

    def __init__(self, capacity: int = 1024, max_kicks: int = 200):
        self.max_kicks, self.size, self.resizes = max_kicks, 0, 0
        self._make(max(2, 1 << (int(capacity / SLOTS / 0.85)).bit_length()))

    def _make(self, buckets: int) -> None:
        self.buckets = buckets
        self.prints = np.zeros(buckets * SLOTS, dtype=np.uint16)
        self.keys: list[bytes | None] = [None] * (buckets * SLOTS)
        self.values: list = [None] * (buckets * SLOTS)

    @staticmethod
    def _print(key: bytes) -> int:
        return struct.unpack_from("<H", key, 8)[0] or 1

    def _home(self, key: bytes) -> int:
        return struct.unpack_from("<Q", key, 0)[0] & (self.buckets - 1)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & (self.buckets - 1)

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = self._print(key)
        home = self._home(key)
        return mark, home, self._other(home, mark)

    def contains(self, key: bytes) -> bool:
        """Whether the filter has the fingerprint; false positives are possible."""
        mark, one, two = self._places(key)
        prints = self.prints
        return any(prints[b * SLOTS + s] == mark for b in (one, two) for s in range(SLOTS))

    def _find(self, key: bytes) -> int:
        _, one, two = self._places(key)
        for bucket in (one, two):
            base = bucket * SLOTS
            for at in range(base, base + SLOTS):
                if self.keys[at] == key:
                    return at
        return -1

    def get(self, key: bytes):
        """The value of the key, verified against the bucket's stored key; None if absent."""
        if not self.contains(key):
            return None
        at = self._find(key)
        return None if at < 0 else self.values[at]

    def delete(self, key: bytes) -> bool:
        at = self._find(key)
        if at < 0:
            return False
        self.prints[at], self.keys[at], self.values[at] = 0, None, None
        self.size -= 1
        return True

    def _place(self, key: bytes, value) -> bool:
        mark, bucket, two = self._places(key)
        for b in (bucket, two):
            base = b * SLOTS
            for at in range(base, base + SLOTS):
                if self.keys[at] is None:
                    self.prints[at], self.keys[at], self.values[at] = mark, key, value
                    return True
        moved: list[int] = []
        for kick in range(self.max_kicks):
            at = bucket * SLOTS + kick % SLOTS
            moved.append(at)
            key, self.keys[at] = self.keys[at], key
            value, self.values[at] = self.values[at], value
            self.prints[at], mark = mark, int(self.prints[at])
            bucket = self._other(bucket, mark)
            base = bucket * SLOTS
            for free in range(base, base + SLOTS):
                if self.keys[free] is None:
                    self.prints[free], self.keys[free], self.values[free] = mark, key, value
                    return True
        for at in reversed(moved):  # undo, so that the stored keys are whole
            key, self.keys[at] = self.keys[at], key
            value, self.values[at] = self.values[at], value
            mark, self.prints[at] = int(self.prints[at]), mark
        return False

    def insert(self, key: bytes, value) -> None:
        """Adds a key that is not there yet."""
        while not self._place(key, value):
            live = list(self.items())
            self.resizes += 1
            self._make(self.buckets * 2)
            while not all(self._place(*pair) for pair in live):
                self._make(self.buckets * 2)
        self.size += 1

    def items(self) -> Iterator[tuple[bytes, object]]:
        return ((k, v) for k, v in zip(self.keys, self.values, strict=True) if k is not None)


def _live(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Folds partial rows into an index: of a digest met again, the entry with the smaller id is deleted."""
    index = CuckooIndex()
    for batch in batches:
        for digest, top, n in zip(batch["digest"], batch["top"], batch["n"], strict=True):
            digest = bytes(digest)
            top = None if pd.isna(top) else int(top)
            old = index.get(digest)
            if old is not None:
                index.delete(digest)
                top = old[0] if top is None or (old[0] is not None and old[0] > top) else top
                n += old[1]
            index.insert(digest, (top, int(n)))
    rows = [(k, v[0], v[1]) for k, v in index.items()]
    for start in range(0, len(rows), 50_000):
        part = rows[start : start + 50_000]
        yield pd.DataFrame({"digest": [r[0] for r in part], "keep_id": pd.array([r[1] for r in part], dtype="Int64"), "group_size": [r[2] for r in part]})


@tidy
def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups rows whose texts are equal after lower-casing A-Z; the largest id of a group stays.

    Returns one row per input row: id, keep_id, group_size, kept, text_sha256. A null text counts as empty. Null ids are
    smaller than any other; a group with null ids only has a null keep_id and keeps one row. Of repeated rows with the
    same id and text one is kept. Columns other than the two named are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = materialize(
        docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256)).alias("digest")).groupBy("digest", "id").agg(F.count(F.lit(1)).alias("copies")),
        "exact-rows",
    )
    partial = materialize(
        rows.groupBy("digest", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")).agg(F.max("id").alias("top"), F.sum("copies").alias("n")).drop("salt"),
        "exact-partial",
    )
    tasks = task_count(spark, partial.count(), INDEX_ROWS)
    live = materialize(partial.repartition(tasks, "digest").mapInPandas(_live, f"digest binary, keep_id {dict(docs.dtypes)[id_col]}, group_size long"), "exact-live")
    total = live.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    hot = live.filter(F.col("group_size") > max(1, total // HOT_SHARE))  # fewer than about HOT_SHARE groups
    joined = rows.join(F.broadcast(hot), "digest").unionByName(rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(live, "digest"))
    return joined.select("id", "digest", "keep_id", "group_size", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


ORACLE = f"""
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), '{'ABCDEFGHIJKLMNOPQRSTUVWXYZ'}', '{'abcdefghijklmnopqrstuvwxyz'}') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
