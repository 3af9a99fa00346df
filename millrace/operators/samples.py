"""Fill-in-the-middle samples: candidate lines, exclusion masks, sampling within a file, windowed context."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import fim_prompt, good_target_line, header_end, line_fingerprints, rstrip_newlines, splitlines


@dataclass(frozen=True)
class SampleOptions:
    prefix_lines: int = 80
    suffix_lines: int = 80
    per_file: int = 60
    downweight: float = 0.25
    seed: int = 42


def order_in_file(seed: int, file: Column, index: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), file.cast("string"), index.cast("string")))


def context(lines: Column, index: Column, header: Column, opts: SampleOptions) -> tuple[Column, Column]:
    """(prefix, suffix): the header and up to prefix_lines lines before, which do not repeat the header; suffix_lines behind."""
    begin = F.greatest(header, index - opts.prefix_lines)
    before = F.when(index > begin, F.slice(lines, begin + 1, index - begin)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.slice(lines, 1, header), before), ""), F.array_join(F.slice(lines, index + 2, opts.suffix_lines), "")


def _finish(df: DataFrame, opts: SampleOptions) -> DataFrame:
    prefix, suffix = context(F.col("lines"), F.col("line_index"), F.col("header"), opts)
    target = rstrip_newlines(F.col("lines")[F.col("line_index")])
    return df.select(
        F.concat_ws(":", F.col("file").cast("string"), F.col("line_index").cast("string")).alias("id"), "file", F.col("line_index").cast("long").alias("line_index"), fim_prompt(prefix, suffix).alias("prompt"), target.alias("completion")
    )


def fim_samples(files: DataFrame, opts: SampleOptions = SampleOptions(), path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(id, file, line_index, prompt, completion): up to per_file random good lines of each file. One pass over rows, no shuffle."""
    base = files.select(F.col(path_col).alias("file"), splitlines(F.coalesce(F.col(text_col), F.lit(""))).alias("lines")).withColumn("header", header_end(F.col("lines")))
    numbered = F.transform(F.col("lines"), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    good = F.filter(numbered, lambda s: (s["i"] >= F.col("header")) & good_target_line(s["x"]))
    ranked = F.array_sort(F.transform(good, lambda s: F.struct(order_in_file(opts.seed, F.col("file"), s["i"]).alias("h"), s["i"].alias("i"))))
    return _finish(base.select("file", "lines", "header", F.explode(F.slice(ranked, 1, opts.per_file)).alias("s")).withColumn("line_index", F.col("s.i")), opts)


def candidates(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(file, line_index, line) of the good lines behind each header."""
    base = files.select(F.col(path_col).alias("file"), splitlines(F.coalesce(F.col(text_col), F.lit(""))).alias("lines"))
    return base.select("file", header_end(F.col("lines")).alias("header"), F.posexplode("lines").alias("line_index", "line")).filter((F.col("line_index") >= F.col("header")) & good_target_line(F.col("line"))).drop("header")


def exclusion_reason(lines: DataFrame, line_mask: DataFrame, file_prints: DataFrame, global_prints: DataFrame) -> DataFrame:
    """Adds reason (bench_line, bench_text_file, bench_text_global or null), the first that applies.

    line_mask: (file, line_index); file_prints: (file, fp); global_prints: (fp). What the masks hit becomes one table by
    file and line, which the lines with their text meet once. Joins are Spark's choice: by broadcast while a side is small
    by statistics, by a shuffle beyond.
    """
    spots = lines.select("file", "line_index", F.explode(line_fingerprints(F.col("line"))).alias("fp"))
    by_file = spots.join(file_prints.select("file", "fp").distinct(), ["file", "fp"], "left_semi").select("file", "line_index", F.lit(1).alias("why"))
    by_any = spots.join(global_prints.select("fp").distinct(), "fp", "left_semi").select("file", "line_index", F.lit(2).alias("why"))
    by_line = line_mask.select("file", F.col("line_index").cast("int").alias("line_index"), F.lit(0).alias("why"))
    found = by_line.unionByName(by_file).unionByName(by_any).groupBy("file", "line_index").agg(F.min("why").alias("why"))
    reason = F.get(F.array(F.lit("bench_line"), F.lit("bench_text_file"), F.lit("bench_text_global")), F.col("why"))
    return lines.join(found, ["file", "line_index"], "left").withColumn("reason", reason).drop("why")


def sample_lines(lines: DataFrame, opts: SampleOptions, referenced: DataFrame | None = None) -> DataFrame:
    """Up to per_file lines of each file by random rank; files in `referenced` (file) get max(1, int(per_file * downweight))."""
    limit = F.lit(opts.per_file)
    if referenced is not None:
        lines = lines.join(referenced.select("file", F.lit(True).alias("__ref")).distinct(), "file", "left")
        limit = F.when(F.col("__ref"), max(1, int(opts.per_file * opts.downweight))).otherwise(limit)
    rank = F.row_number().over(Window.partitionBy("file").orderBy(order_in_file(opts.seed, F.col("file"), F.col("line_index"))))
    return lines.withColumn("__rank", rank).filter((F.col("__rank") <= opts.per_file) & (F.col("__rank") <= limit)).drop("__rank", "__ref")


def masked_samples(files: DataFrame, masks: tuple[DataFrame, DataFrame, DataFrame], opts: SampleOptions = SampleOptions(), referenced: DataFrame | None = None, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """As fim_samples, without excluded lines, which leave before sampling. Files meet their sampled lines again for context."""
    return clean_samples(files, exclusion_reason(candidates(files, path_col, text_col), *masks), opts, referenced, path_col, text_col)


def clean_samples(files: DataFrame, told: DataFrame, opts: SampleOptions = SampleOptions(), referenced: DataFrame | None = None, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """Samples of the candidate lines in told that have no reason."""
    chosen = sample_lines(told.filter("reason is null"), opts, referenced).select("file", "line_index")
    base = files.select(F.col(path_col).alias("file"), splitlines(F.coalesce(F.col(text_col), F.lit(""))).alias("lines"))
    return _finish(base.join(chosen, "file").withColumn("header", header_end(F.col("lines"))), opts)


def line_windows(n: Column, size: int = 30, overlap: int = 10) -> Column:
    """Starts of windows of `size` positions over n, `overlap` of them shared; the last one reaches the end."""
    size = size if size > 0 else 30
    step = max(1, size - max(0, overlap))
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int") * step
    return F.when(n > 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))


def line_chunks(files: DataFrame, size: int = 30, overlap: int = 10, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(file, start, end, text, lines): windows of lines; start and end count from 0 and are both inside."""
    base = files.select(F.col(path_col).alias("file"), splitlines(F.coalesce(F.col(text_col), F.lit(""))).alias("all"))
    width = size if size > 0 else 30
    part = base.select("file", F.size("all").alias("n"), "all", F.explode(line_windows(F.size("all"), size, overlap)).alias("start"))
    return part.select("file", "start", (F.least(F.col("start") + width, F.col("n")) - 1).alias("end"), F.slice("all", F.col("start") + 1, width).alias("lines")).withColumn("text", F.array_join("lines", ""))


def text_chunks(files: DataFrame, size: int = 30, overlap: int = 10, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """line_chunks() without lines: texts are cut in Python over Arrow arrays, since str.splitlines is far faster than its pattern."""
    width = size if size > 0 else 30
    step = max(1, width - max(0, overlap))
    base = files.select(F.col(path_col).alias("file"), F.col(text_col).alias("text"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, start, end, text = [], [], [], []
            for row, x in enumerate(batch.column(1).to_pylist()):
                lines = (x or "").splitlines(keepends=True)
                for at in range(0, max(0, -(-(len(lines) - width) // step)) * step + 1, step) if lines else ():
                    rows.append(row)
                    start.append(at)
                    end.append(min(at + width, len(lines)) - 1)
                    text.append("".join(lines[at : at + width]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(text, pa.string())], ["file", "start", "end", "text"])

    return base.mapInArrow(cut, f"file {base.schema['file'].dataType.simpleString()}, start int, end int, text string")


def brace_chunks(files: DataFrame, size: int = 30, overlap: int = 10, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """As line_chunks, but a file whose braces balance is cut where its first level closes; longer parts are cut by windows.

    A file without such a part falls back to line windows. Depth is a running sum over the lines, folded inside the row;
    braces in quotes and comments do not count.
    """
    base = files.select(F.col(path_col).alias("file"), splitlines(F.coalesce(F.col(text_col), F.lit(""))).alias("all"))
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<int>").alias("cuts"), F.lit(0).alias("at"), F.lit(False).alias("comment"))

    def step(acc: Column, x: Column) -> Column:
        rest = F.when(acc["comment"], F.regexp_replace(x, r"^.*?(\*/|$)", "")).otherwise(x)
        code = F.regexp_replace(rest, r"""(?s)"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|/\*.*?\*/|//.*""", "")
        opens = F.locate("/*", code)
        bare = F.when(opens > 0, F.substr(code, F.lit(1), opens - 1)).otherwise(code)
        depth = acc["depth"] + F.regexp_count(bare, F.lit(r"\{")) - F.regexp_count(bare, F.lit(r"\}"))
        closes = (acc["depth"] >= 2) & (depth == 1)
        comment = (opens > 0) | (acc["comment"] & ~x.contains("*/"))
        return F.struct(depth.alias("depth"), F.when(closes, F.concat(acc["cuts"], F.array(acc["at"] + 1))).otherwise(acc["cuts"]).alias("cuts"), (acc["at"] + 1).alias("at"), comment.alias("comment"))

    cuts = F.aggregate("all", start, step)["cuts"]
    edges = F.array_distinct(F.concat(F.array(F.lit(0)), cuts, F.array(F.size("all"))))
    parts = base.filter(F.size("all") > 0).select("file", "all", edges.alias("edges")).select("file", "all", "edges", F.posexplode(F.slice("edges", 1, F.size("edges") - 1)).alias("k", "from"))
    parts = parts.select("file", "all", "from", (F.col("edges")[F.col("k") + 1] - F.col("from")).alias("n"))
    width = size if size > 0 else 30
    cut = parts.select("file", "all", "from", "n", F.explode(line_windows(F.col("n"), size, overlap)).alias("s"))
    return cut.select("file", (F.col("from") + F.col("s")).alias("start"), (F.col("from") + F.least(F.col("s") + width, F.col("n")) - 1).alias("end"), F.slice("all", F.col("from") + F.col("s") + 1, F.least(F.lit(width), F.col("n") - F.col("s"))).alias("lines")).withColumn("text", F.array_join("lines", ""))


def bernoulli_split(df: DataFrame, keys: list[str], val_ratio: float, seed: int = 42) -> DataFrame:
    """Adds split: each row is in val with probability val_ratio, by a hash of its keys."""
    share = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])), 1, 8), 16, 10).cast("double") / 2.0**32
    return df.withColumn("split", F.when(share < val_ratio, "val").otherwise("train"))


def group_split(df: DataFrame, group: str, val_ratio: float, seed: int = 42) -> DataFrame:
    """Adds split: max(1, int(n * val_ratio)) of the n groups are val, all rows of a group together."""
    groups = df.select(group).distinct()
    n = groups.count()
    chosen = groups.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(group).cast("string"))), group).limit(max(1, int(n * val_ratio)) if n else 0)
    return df.join(chosen.select(group, F.lit("val").alias("split")), group, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def quotas(strata: list[str], total: int) -> dict[str, int]:
    """Equal quotas, the remainder to the first strata."""
    return {s: total // len(strata) + (i < total % len(strata)) for i, s in enumerate(strata)}


def stratified_top(df: DataFrame, stratum: str, quota: dict[str, int], keys: list[str], seed: int = 42) -> DataFrame:
    """Up to quota[s] rows of each stratum, those with the least hash of seed and keys: a top-k for each, no sort of a stratum."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    parts = [df.filter(F.col(stratum) == s).orderBy(order, *keys).limit(q) for s, q in quota.items()]
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


def stratified_quota(df: DataFrame, stratum: str, strata: list[str], total: int, keys: list[str], seed: int = 42) -> DataFrame:
    """total rows by quotas(); fails if a stratum is short."""
    quota = quotas(strata, total)
    have = {r[0]: r[1] for r in df.groupBy(stratum).agg(F.count(F.lit(1))).collect()}  # one row for each stratum
    short = {s: (have.get(s, 0), q) for s, q in quota.items() if have.get(s, 0) < q}
    if short:
        raise RuntimeError(f"not enough candidates (have, need): {short}")
    return stratified_top(df, stratum, quota, keys, seed)
