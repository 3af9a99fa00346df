"""Pieces that several operators share."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words of the contracts: runs of ASCII letters and digits and of anything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A group with more than this share of the rows is hot. At most HOT_SHARE groups can be, so a table of them is bounded.
HOT_SHARE = 1000


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """Words of the lower-cased text; none if null."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)


def wide_hash(value: Column) -> list[Column]:
    """Two 64-bit hashes that together identify a value."""
    return [F.xxhash64(value).alias("h1"), F.xxhash64(F.lit(7), value).alias("h2")]


def windows(text: Column, key: Column, n: int, size: int) -> Column:
    """The text, or n stretches of `size` characters where it has more than they: one in each n-th of it, at a place by the key's hash."""
    part = F.length(text) / n
    spots = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.substr(text, (i * part + F.pmod(F.xxhash64(key, i), F.greatest(F.lit(1), part.cast("long") - size + 1))).cast("int") + 1, F.lit(size)))
    return F.when(F.length(text) <= n * size, text).otherwise(F.array_join(spots, "\n"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def task_count(spark: SparkSession, rows: int, per_task: int) -> int:
    """Tasks so that none gets more than per_task rows, and no fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """Inner join of rows with their groups (one row for each key; `size` is how many rows it has of `total`).

    The groups with over a thousandth of the rows, about HOT_SHARE at most, are broadcast; the rest are shuffled, where
    no key has more rows than that. Both inputs are read twice: pass tables.
    """
    hot = groups.filter(F.col(size) > max(1, total // HOT_SHARE))
    warm = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(groups, on)
    return rows.join(F.broadcast(hot), on).unionByName(warm)


def literal_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table out of the plan itself: no RDD and no Python on executors."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))
