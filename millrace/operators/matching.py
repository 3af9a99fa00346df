"""Matching benchmark items to source lines: a cascade of joins, and the masks that follow from it."""

from __future__ import annotations

from dataclasses import dataclass
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from millrace.functions.text import ground_truth_forms, line_fingerprints, rstrip_newlines, splitlines, suffix_score, ws_norm
from millrace.storage import materialize

CONTEXT_LINES = 10
PROMPT_MARGIN = 0.05
FUZZY_RATIO, FUZZY_MARGIN = 0.90, 0.05


@dataclass(frozen=True)
class MatchOptions:
    window: int = 60
    fuzzy: bool = False
    suffix: str = ".java"
    global_blocklist: bool = True


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio of two texts, a first; null if either is. Equal pairs of a batch are compared once."""
    pairs = list(zip(a, b, strict=True))
    ratio = {(x, y): SequenceMatcher(None, x, y).ratio() for x, y in set(pairs) if x is not None and y is not None}
    return pd.Series([ratio.get(p) for p in pairs], dtype="float64")


def ratio_bound(a: Column, b: Column) -> Column:
    """The most that the ratio can be, from the lengths."""
    return 2 * F.least(F.length(a), F.length(b)) / F.greatest(F.lit(1), F.length(a) + F.length(b))


def record_key(records: DataFrame) -> Column:
    """What tells items apart: all of their columns that matching reads."""
    return F.md5(F.to_json(F.struct(*[c for c in ("task_id", "prompt", "ground_truth", "fpath_tuple", "line_no") if c in records.columns]), {"ignoreNullFields": "false"}))


def keyed(records: DataFrame) -> DataFrame:
    """Adds rec, the item's key."""
    return records.withColumn("rec", record_key(records))


def candidate_files(records: DataFrame, paths: DataFrame, suffix: str = ".java") -> DataFrame:
    """(rec, file, rank): files whose path is a suffix of the item's, longest first; without one, files of its name by fit.

    records: (rec, fpath_tuple); paths: (file), relative to the repository.
    """
    size = F.size("fpath_tuple")
    cut = records.select("rec", "fpath_tuple", F.explode(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)))).alias("i")).select(
        "rec", F.col("i").alias("rank"), F.array_join(F.slice("fpath_tuple", F.col("i") + 1, F.greatest(size, F.lit(1))), "/").alias("file")
    )
    exact = materialize(cut.filter(F.col("file").endswith(suffix)).join(paths.select("file").hint("merge"), "file"), "match-exact")
    rest = records.select("rec", "fpath_tuple").join(exact.select("rec").distinct().hint("merge"), "rec", "left_anti")
    by_name = rest.withColumn("name", F.element_at("fpath_tuple", -1)).join(paths.select("file", F.element_at(F.split("file", "/"), -1).alias("name")).hint("merge"), "name")
    ranked = by_name.withColumn("rank", F.row_number().over(Window.partitionBy("rec").orderBy(suffix_score(F.col("file"), F.col("fpath_tuple")))) - 1)
    return exact.select("rec", "file", "rank").unionByName(ranked.select("rec", "file", "rank"))


def _context_ratio(hits: DataFrame, lines: DataFrame, records: DataFrame) -> DataFrame:
    """Of items with several equal lines in a file, the line whose surroundings fit the prompt best, if by a margin."""
    spots = hits.select("rec", "file", "rank", F.col("line_index").alias("hit"), F.explode(F.sequence(F.col("line_index") - CONTEXT_LINES, F.col("line_index") + CONTEXT_LINES - 1)).alias("at"))
    near = spots.join(lines.select("file", F.col("line_index").alias("at"), "line").hint("merge"), ["file", "at"])
    text = near.groupBy("rec", "file", "rank", "hit").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "").alias("context"))
    parts = splitlines(F.coalesce("prompt", F.lit("")), keepends=False)
    tail = records.select("rec", F.array_join(F.slice(parts, F.greatest(F.size(parts) - CONTEXT_LINES + 1, F.lit(1)), CONTEXT_LINES), "\n").alias("tail")).filter(F.length(ws_norm(F.col("tail"))) > 0)
    scored = text.join(tail.hint("merge"), "rec").withColumn("ratio", sequence_ratio("tail", "context"))
    w = Window.partitionBy("rec", "file").orderBy(F.desc("ratio"), F.desc("hit"))
    first = scored.withColumn("n", F.row_number().over(w)).withColumn("next", F.lead("ratio").over(w)).filter("n = 1")
    return first.filter(F.col("next").isNull() | (F.col("ratio") - F.col("next") > PROMPT_MARGIN)).select("rec", "file", "rank", F.col("hit").alias("line_index"))


def match_records(records: DataFrame, lines: DataFrame, opts: MatchOptions = MatchOptions()) -> DataFrame:
    """(rec, task_id, status, resolved_path, line_index, strategy, confidence, reason) for each item.

    records: (task_id, prompt, ground_truth, fpath_tuple, line_no); lines: (file, line_index, line). Items are told apart by
    record_key(), not by task_id, which several may share. Equal lines are one equality join on file and text, written once; the stages of all candidate files are ranked, and the first that matched counts.
    Joins merge sorted sides: repeated texts make files small, so their size is no sign that a table may be broadcast.
    A file without a match but with an ambiguity does not stop a later one; the last ambiguity is told if none matched.
    """
    every_record, records = keyed(records).select("rec", "task_id"), materialize(keyed(records).dropDuplicates(["rec"]), "match-records")
    forms = records.withColumn("g", ground_truth_forms(F.col("ground_truth"))).select("rec", "line_no", F.col("g.gt_nl_stripped").alias("key"), F.col("g.gt_ws_norm").alias("gt_ws"))
    files = materialize(candidate_files(records, materialize(lines.select("file").distinct(), "match-paths"), opts.suffix), "match-files")
    wanted = files.join(forms.hint("merge"), "rec")
    by_text = lines.select("file", "line_index", rstrip_newlines(F.col("line")).alias("key"))
    hits = materialize(wanted.join(by_text.hint("merge"), ["file", "key"]).select("rec", "file", "rank", "line_no", "line_index"), "match-hits")
    off = F.abs(F.col("line_index") - F.col("line_no"))
    off_one = F.abs(F.col("line_index") - (F.col("line_no") - 1))

    def stage(found: DataFrame, number: int, strategy: str, confidence: int, status: str = "matched", reason: str | None = None) -> DataFrame:
        return found.select(
            "rec", "rank", F.lit(number).alias("stage"), F.lit(status).alias("status"), F.col("file").alias("resolved_path"), F.col("line_index").cast("int").alias("line_index"),
            F.lit(strategy).alias("strategy"), F.lit(confidence).alias("confidence"), F.lit(reason).cast("string").alias("reason"),
        )

    def nearest(distance: Column) -> Column:
        return F.min(F.when(distance <= opts.window, F.struct(distance.alias("d"), F.col("line_index").alias("i"))))

    # one row for each item and file: the nearest lines by either count of lines, how many lines are equal, and one of them
    groups = hits.groupBy("rec", "file", "rank").agg(nearest(off).alias("zero"), nearest(off_one).alias("one"), F.count(F.lit(1)).alias("hits"), F.min("line_index").alias("any"))
    groups = materialize(groups, "match-groups")
    many = hits.join(groups.filter("hits > 1").select("rec", "file", "rank").hint("merge"), ["rec", "file", "rank"])
    no_index = F.lit(None).cast("int")
    stages = [
        stage(groups.filter("zero.d = 0").withColumn("line_index", F.col("zero.i")), 0, "line_no_exact_0based", 100),
        stage(groups.filter("zero is not null").withColumn("line_index", F.col("zero.i")), 1, "window_search", 95),
        stage(groups.filter("one.d = 0").withColumn("line_index", F.col("one.i")), 2, "line_no_exact_1based", 100),
        stage(groups.filter("one is not null").withColumn("line_index", F.col("one.i")), 3, "window_search", 95),
        stage(groups.filter("hits = 1").withColumn("line_index", F.col("any")), 4, "global_exact", 90),
        stage(_context_ratio(many, lines, records), 5, "prompt_disambiguation", 80),
        stage(groups.filter("hits > 1").withColumn("line_index", no_index), 9, "global_exact", 30, "unmatched_ambiguous", "multiple_matches"),
    ]
    if opts.fuzzy:
        fuzzy = fuzzy_matches(wanted, lines)
        stages += [
            stage(fuzzy.filter("not ambiguous"), 6, "fuzzy", 60),
            stage(fuzzy.filter("ambiguous").withColumn("line_index", no_index), 10, "fuzzy", 30, "unmatched_ambiguous", "ambiguous_fuzzy"),
        ]
    every = stages[0]
    for s in stages[1:]:
        every = every.unionByName(s)
    # matches: first file, first stage; ambiguities: last file, last stage
    order = F.when(F.col("status") == "matched", F.struct(F.lit(0).alias("a"), F.col("rank").alias("b"), F.col("stage").alias("c"))).otherwise(F.struct(F.lit(1).alias("a"), (-F.col("rank")).alias("b"), (-F.col("stage")).alias("c")))
    columns = ["status", "resolved_path", "line_index", "strategy", "confidence", "reason"]
    best = every.groupBy("rec").agg(F.min_by(F.struct(*columns), order).alias("m")).select("rec", *[F.col(f"m.{c}").alias(c) for c in columns])
    first = files.groupBy("rec").agg(F.min_by("file", "rank").alias("first_file"))
    told = every_record.join(best.hint("merge"), "rec", "left").join(first.hint("merge"), "rec", "left")
    no_file = F.col("first_file").isNull()
    return told.select(
        "rec", "task_id",
        F.when(F.col("status").isNotNull(), F.col("status")).when(no_file, "unmatched_file").otherwise("unmatched_line").alias("status"),
        F.when(F.col("status").isNotNull(), F.col("resolved_path")).otherwise(F.col("first_file")).alias("resolved_path"),
        "line_index", "strategy", F.coalesce("confidence", F.lit(0)).alias("confidence"),
        F.when(F.col("status").isNotNull(), F.col("reason")).when(no_file, "no_candidate_file").otherwise("no_line_match").alias("reason"),
    )


def fuzzy_matches(wanted: DataFrame, lines: DataFrame) -> DataFrame:
    """(rec, file, rank, line_index, ambiguous): the most similar line of each candidate file with ratio 0.9 or more.

    wanted: (rec, file, rank, gt_ws). Distinct text pairs whose lengths allow the ratio are compared once.
    """
    texts = lines.select("file", "line_index", ws_norm(F.col("line")).alias("cand")).filter("cand <> ''")
    pairs = wanted.select("rec", "file", "rank", "gt_ws").join(texts, "file").filter(ratio_bound(F.col("gt_ws"), F.col("cand")) >= FUZZY_RATIO)
    scores = pairs.select("gt_ws", "cand").distinct().withColumn("ratio", quick_ratio("gt_ws", "cand")).filter(F.col("ratio") >= FUZZY_RATIO)
    w = Window.partitionBy("rec", "file").orderBy(F.desc("ratio"), "line_index")
    ranked = pairs.join(scores, ["gt_ws", "cand"]).withColumn("n", F.row_number().over(w)).withColumn("next", F.lead("ratio").over(w)).filter("n = 1")
    return ranked.select("rec", "file", "rank", "line_index", F.coalesce(F.col("ratio") - F.col("next") < FUZZY_MARGIN, F.lit(False)).alias("ambiguous"))


@F.pandas_udf(DoubleType())
def quick_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The ratio, or 0 where its quick bound rules out FUZZY_RATIO."""
    def one(x: str, y: str) -> float:
        m = SequenceMatcher(None, x, y)
        return m.ratio() if m.quick_ratio() >= FUZZY_RATIO else 0.0
    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def benchmark_masks(records: DataFrame, matches: DataFrame, lines: DataFrame, opts: MatchOptions = MatchOptions()) -> dict[str, DataFrame]:
    """line_mask (file, line_index), file_prints (file, fp), global_prints (fp), referenced (file).

    Files of ambiguous and unmatched lines are referenced too, and the global prints cover unmatched items.
    """
    found = matches.filter("status = 'matched'").select("rec", F.col("resolved_path").alias("file"), "line_index").distinct()
    truths = keyed(records).select("rec", F.explode(line_fingerprints(F.col("ground_truth"))).alias("fp"))
    own = found.join(lines.select("file", "line_index", "line"), ["file", "line_index"]).select("file", F.explode(line_fingerprints(F.col("line"))).alias("fp"))
    given = found.join(truths, "rec").select("file", "fp")
    every = truths.select("fp").distinct()
    return {
        "line_mask": found.select("file", "line_index").distinct(),
        "file_prints": own.unionByName(given).distinct(),
        "global_prints": every if opts.global_blocklist else every.limit(0),
        "referenced": matches.filter("status <> 'unmatched_file'").select(F.col("resolved_path").alias("file")).filter("file is not null").distinct(),
    }


def leak_count(samples: DataFrame, line_mask: DataFrame) -> DataFrame:
    """One row (leaked): samples that lie on masked lines."""
    return samples.join(line_mask, ["file", "line_index"], "left_semi").agg(F.count(F.lit(1)).alias("leaked"))


def bench_file_counts(samples: DataFrame, referenced: DataFrame) -> DataFrame:
    """(file, n): samples of each file that an item refers to."""
    return samples.join(referenced.select("file").distinct(), "file", "left_semi").groupBy("file").agg(F.count(F.lit(1)).alias("n"))


def mask_report(matches: DataFrame) -> DataFrame:
    """Items by status and strategy."""
    return matches.groupBy("status", "strategy").agg(F.count(F.lit(1)).alias("items"))
