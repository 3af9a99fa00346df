"""Line deduplication over levelled sorted runs of line hashes.

Lines of at least min_chars code points are hashed in the JVM and dealt into batches of documents, largest ids first.
Each batch aggregates its own keys, merge-anti-joins them with the runs so far, and adds a sorted run: keys that no run
holds come with their holder (the largest document, since later batches have smaller ids), keys already held come as
counts only. A level with `fanout` runs is compacted into one run of the next level. After the last batch one compaction
gives each key's number of documents and holder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import HOT_SHARE, ascii_lower, read, wide_hash
from millrace.storage import drop_path, materialize, new_path, read_table, tidy

BLANKS = " \t\n\x0b\x0c\r"
BATCHES = 4
FANOUT = 2


def lines(text: Column) -> Column:
    """The lines of a text; null or empty gives one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


class LevelledRuns:
    """Sorted runs (h1, h2, n_docs, n_rows, holder) in levels, kept as Parquet in the shared folder."""

    columns = ("h1", "h2", "n_docs", "n_rows", "holder")
    schema = T.StructType([T.StructField(c, T.LongType()) for c in columns])

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[str]] = []

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths)

    def paths(self) -> list[str]:
        return [p for level in self.levels for p in level]

    def _write(self, df: DataFrame, level: int) -> None:
        path = new_path(self.spark, f"line-run-{level}")
        df.select(*self.columns).sortWithinPartitions("h1", "h2").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    @staticmethod
    def _merged(df: DataFrame) -> DataFrame:
        return df.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_rows").alias("n_rows"), F.max("holder").alias("holder"))

    def add(self, batch: DataFrame) -> None:
        """batch: one row (h1, h2, n_docs, n_rows, holder) for each key of the batch."""
        if held := self.paths():
            runs = self._read(held).select("h1", "h2").withColumn("seen", F.lit(True)).dropDuplicates(["h1", "h2"])
            batch = batch.hint("merge").join(runs, ["h1", "h2"], "left").withColumn("holder", F.when(F.col("seen").isNull(), F.col("holder"))).drop("seen")
        self._write(batch, 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            self.compact(level)
            level += 1

    def compact(self, level: int) -> None:
        """Merges all runs of a level into one of the next level."""
        old, self.levels[level] = self.levels[level], []
        self._write(self._merged(self._read(old)), level + 1)
        for path in old:
            drop_path(self.spark, path)

    def merged(self) -> DataFrame:
        """One row for each key over all runs."""
        return self._merged(self._read(self.paths()))


def _batch_edges(docs: DataFrame, id_col: str, batches: int) -> list[int]:
    """Ids that cut the documents into batches of about equal counts."""
    edges = docs.agg(F.percentile_approx(id_col, [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    return sorted({int(x) for x in edges or []}, reverse=True)


@tidy
def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, batches: int = BATCHES) -> DataFrame:
    """Drops lines whose key (stripped, A-Z lower-cased) has min_chars code points and is in min_docs documents, except in the largest id that holds it.

    Returns one row per input row: id, n_lines (before), n_dropped, kept_text. Null and empty texts are one empty line.
    Repeated rows with one id are one document when documents are counted, and each gets the same result. A null id is
    smaller than any other. Extra columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    edges = _batch_edges(base, "id", batches)
    batch = reduce(lambda acc, edge: acc + F.when(F.col("id") >= edge, 0).otherwise(1), edges, F.lit(0))
    long_lines = F.filter(F.transform(lines(F.col("text")), lambda x, i: F.struct(i.alias("pos"), line_key(x).alias("key"))), lambda x: F.length(x["key"]) >= min_chars)
    keyed = (
        base.select("id", F.xxhash64("text").alias("th"), batch.alias("batch"), F.explode(long_lines).alias("l"))
        .select("id", "th", "batch", F.col("l.pos").alias("pos"), *wide_hash(F.col("l.key")))
    )
    path = new_path(spark, "line-keys")
    keyed.write.partitionBy("batch").parquet(path)
    keys = read_table(spark, path, keyed)

    runs = LevelledRuns(spark)
    for b in range(len(edges) + 1):
        own = keys.filter(F.col("batch") == b).groupBy("h1", "h2", "id").agg(F.count(F.lit(1)).alias("n"))
        runs.add(own.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_rows"), F.max("id").alias("holder")))
    common = materialize(runs.merged().filter(F.col("n_docs") >= min_docs), "line-common")

    total = keys.count()
    hot = common.filter(F.col("n_rows") > max(1, total // HOT_SHARE)).select("h1", "h2", "holder")  # about HOT_SHARE keys at most
    common = common.select("h1", "h2", "holder")
    part = keys.select("id", "th", "pos", "h1", "h2")
    dropped = part.join(F.broadcast(hot), ["h1", "h2"]).unionByName(part.join(F.broadcast(hot.select("h1", "h2")), ["h1", "h2"], "left_anti").join(common, ["h1", "h2"]))
    gone = dropped.filter(~F.col("id").eqNullSafe(F.col("holder"))).groupBy("id", "th").agg(F.collect_set("pos").alias("gone"))
    every = base.withColumn("th", F.xxhash64("text")).alias("d")
    found = every.join(gone.alias("g"), (F.col("d.th") == F.col("g.th")) & F.col("d.id").eqNullSafe(F.col("g.id")), "left").select("d.id", lines(F.col("d.text")).alias("lines"), "g.gone")
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone")), lambda i: F.col("lines")[i]))
    return found.select(
        F.col("id").alias(id_col),
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
        F.array_join(kept, "\n").alias("kept_text"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = """
WITH l AS (
  SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
  SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), j AS (
  SELECT k.*, c.holder IS NOT NULL AND c.holder <> k.doc_id AS gone FROM k LEFT JOIN c USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
