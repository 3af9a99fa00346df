"""Descriptive statistics: shares, quantiles, longest rows, histograms, dataset summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import FILE_SEP, has_all_fim

QUANTILES = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def group_share(df: DataFrame, key: str, order: str, top: int | None = None) -> DataFrame:
    """(key, n, share in percent), most first, ties by first appearance."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    total = df.count()
    out = counts.select(key, "n", (F.col("n") / F.lit(total) * 100).alias("share"), "first")
    ranked = out.orderBy(F.desc("n"), "first")
    return (ranked.limit(top) if top else ranked).drop("first")


def distribution(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Count, min, quantiles by linear interpolation, max and mean, of all rows or of each group; nulls are left out."""
    v = F.col(value)
    q = F.percentile(v, list(QUANTILES))
    names = ["p25", "p50", "p75", "p90", "p95", "p99"]
    got = df.filter(v.isNotNull()).groupBy(*(keys or [])).agg(F.count(v).alias("count"), F.min(v).alias("min"), q.alias("q"), F.max(v).alias("max"), F.avg(v).alias("mean"))
    return got.select(*(keys or []), "count", "min", *[F.col("q")[i].alias(n) for i, n in enumerate(names)], "max", "mean")


def top_longest(df: DataFrame, size: str, order: str, k: int) -> DataFrame:
    """The k largest rows; equal ones in input order."""
    return df.orderBy(F.desc(size), order).limit(k)


def has_more_groups(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n_a, n_b, differ): whether two groupings have different numbers of groups."""
    return df.agg(F.count_distinct(a).alias("n_a"), F.count_distinct(b).alias("n_b")).withColumn("differ", F.col("n_a") != F.col("n_b"))


def histogram(df: DataFrame, value: str, bins: int = 60) -> DataFrame:
    """(bin, low, high, n): equal widths from min to max, the last bin closed; empty bins are left out."""
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    width = (high - low) / bins or 1.0
    at = F.least(F.floor((F.col(value) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.filter(F.col(value).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("bin", (F.lit(float(low)) + F.col("bin") * width).alias("low"), (F.lit(float(low)) + (F.col("bin") + 1) * width).alias("high"), "n")


def dataset_summary(df: DataFrame, prompt: str = "prompt", completion: str = "completion", require_fim: bool = True) -> DataFrame:
    """One row: loaded, dropped_missing, dropped_fim, kept, file_sep (rows with a separator) and its percentage of kept."""
    missing = F.col(prompt).isNull() | F.col(completion).isNull()
    no_fim = ~missing & ~has_all_fim(F.col(prompt)) if require_fim else F.lit(False)
    good = ~missing & ~no_fim
    kept, marked = F.count_if(good), F.count_if(good & F.col(prompt).contains(FILE_SEP))
    return df.agg(F.count(F.lit(1)).alias("loaded"), F.count_if(missing).alias("dropped_missing"), F.count_if(no_fim).alias("dropped_fim"), kept.alias("kept"), marked.alias("file_sep"), F.when(kept > 0, marked / kept * 100).otherwise(0.0).alias("file_sep_percent"))
