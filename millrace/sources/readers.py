"""Sources: code trees, JSON lines with and without mercy, benchmark records, splits, prefixes and samples."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.text import decode_ignore, splitlines
from millrace.storage import materialize

#: Folders that hold no source.
SKIP_DIRS = (".git", ".idea", "target", "build", "out", ".gradle", ".mvn")


def code_files(spark: SparkSession, root: str, pattern: str = "*.java") -> DataFrame:
    """(path, text) of the files under root that match, unless a folder between root and file is to be skipped. path is relative to root."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:") + "/"
    path = F.substr(F.col("path"), F.locate(base, F.col("path")) + len(base))  # behind the root's first occurrence
    skip = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, SKIP_DIRS)))
    return files.filter(~skip).select(path.alias("path"), decode_ignore(F.col("content")).alias("text"))


def line_table(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, line_index, line): lines keep their ends; line_index counts from 0."""
    return files.select(F.col(path_col).alias("path"), F.posexplode(splitlines(F.col(text_col))).alias("line_index", "line"))


def json_type(path: str) -> Column:
    """The type of a field of v, without its arguments; null if the field is missing."""
    return F.regexp_extract(F.call_function("schema_of_variant", F.call_function("variant_get", F.col("v"), F.lit(f"$.{path}"), F.lit("variant"))), r"^\w+", 0)


def parse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Adds v (variant) and status: blank, malformed, not_object or ok."""
    blank = F.length(F.trim(F.col(value))) == 0
    parsed = lines.withColumn("v", F.try_parse_json(F.col(value)))
    kind = F.call_function("schema_of_variant", F.col("v"))
    return parsed.withColumn("status", F.when(blank, "blank").when(F.col("v").isNull(), "malformed").when(kind.startswith("OBJECT"), "ok").otherwise("not_object"))


def jsonl_lenient(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Objects of JSON lines as (value, v); blank, malformed and other lines are left out. Compressed files are read by their suffix."""
    return parse_lines(spark.read.text(path)).filter("status = 'ok'").drop("status")


def jsonl_strict(spark: SparkSession, path: str | list[str], schema: str | None = None) -> DataFrame:
    """JSON lines with a schema; a malformed line fails the query."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def field(path: str, kind: str = "string") -> Column:
    """A field of v; null if it is missing or of another type that does not cast."""
    return F.call_function("try_variant_get", F.col("v"), F.lit(f"$.{path}"), F.lit(kind))


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, file, number): lines with their number in their file, from 1. A file may be read in many pieces."""
    raw = spark.read.text(path).select("value", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("_metadata.file_path").alias("full"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    raw = materialize(raw, "numbered-lines")
    pieces = raw.groupBy("full", "block").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))  # one row for each piece of a file
    before = F.coalesce(F.sum("n").over(Window.partitionBy("full").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return raw.join(pieces.select("full", "block", "first", before.alias("before")), ["full", "block"]).select("value", "file", (F.col("before") + F.col("row") - F.col("first") + 1).alias("number"))


def benchmark_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Benchmark items (task_id, prompt, ground_truth, fpath_tuple, line_no).

    Malformed and non-object lines and items without ground truth or path are left out. A path that is one string is a
    list of one. task_id falls back to file name and line number. line_no is an integer if it is written as one.
    """
    ok = parse_lines(numbered_lines(spark, path)).filter("status = 'ok'")
    as_list = field("metadata.fpath_tuple", "array<string>")
    number = field("metadata.line_no")
    records = ok.select(
        F.coalesce(field("metadata.task_id"), F.concat_ws(":", "file", F.col("number").cast("string"))).alias("task_id"),
        F.coalesce(field("prompt"), F.lit("")).alias("prompt"),
        field("metadata.ground_truth").alias("ground_truth"),
        F.coalesce(as_list, F.when(field("metadata.fpath_tuple").isNotNull(), F.array(field("metadata.fpath_tuple")))).alias("fpath_tuple"),
        F.when(number.rlike("^[+-]*[0-9]+$"), number.try_cast("int")).alias("line_no"),
    )
    return records.filter("ground_truth is not null and fpath_tuple is not null")


def gather(spark: SparkSession, files: list[str], folder: str | None = None, pattern: str = "*.jsonl") -> list[str]:
    """Files named, and those directly in a folder that match; distinct and sorted."""
    inside = spark.read.option("pathGlobFilter", pattern).text(folder).inputFiles() if folder else []
    return sorted({*(f.removeprefix("file://") for f in inside), *(f.removeprefix("file://") for f in files)})


def find_files(spark: SparkSession, paths: list[str], pattern: str = "*.jsonl") -> list[str]:
    """Files named, and files that match below folders named; distinct and sorted. Listed by Spark's file index."""
    found: set[str] = set()
    for p in paths:
        if p.endswith(pattern.lstrip("*")) or "*" in p:
            found.add(p)
        else:
            found.update(spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(p).inputFiles())
    return sorted(found)


def load_splits(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """The rows of several JSON files with their split's name; columns that a split lacks are null."""
    parts = [spark.read.json(path).withColumn("split", F.lit(name)) for name, path in files.items()]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def limited(df: DataFrame, order: str, n: int | None) -> DataFrame:
    """The first n rows in order; all if n is missing or not positive."""
    return df.orderBy(order).limit(n) if n and n > 0 else df


def sample_key(seed: int, *keys: str) -> Column:
    """A uniform order of rows that depends on seed and keys only."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def reservoir(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, each set of n as likely, in random order; the same for the same seed and keys."""
    return df.orderBy(sample_key(seed, key), key).limit(n)


def load_policy(df: DataFrame, order: str, shuffle: bool = False, n: int | None = None, seed: int = 42) -> DataFrame:
    """First n in order, or n sampled, or all in random order."""
    if not shuffle:
        return limited(df, order, n)
    return reservoir(df, order, n, seed) if n and n > 0 else df.orderBy(sample_key(seed, order), order)
