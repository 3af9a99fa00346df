"""End-to-end plans: from sources to written datasets and reports."""

from __future__ import annotations

import contextlib
import dataclasses
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators import bm25, codefix, convert, matching, modelfilter, samples, stats, tensors
from millrace.sources import readers, sinks
from millrace.storage import materialize


def fim_dataset(
    spark: SparkSession, repo: str, out: str, benchmarks: list[str] | None = None, val_ratio: float = 0.02, split_by_file: bool = False, rag: bool = False, after_prefix: bool = False,
    opts: samples.SampleOptions = samples.SampleOptions(), match: matching.MatchOptions = matching.MatchOptions(), retrieval: bm25.RetrieveOptions = bm25.RetrieveOptions(), chunk_lines: int = 30, chunk_overlap: int = 10,
    chunks: str = "lines", report_path: str | None = None, downweight: bool = True,
) -> dict:
    """Samples of a code tree without benchmark lines, with retrieved context if wanted; writes splits and returns the report.

    A context shows no chunk that a benchmark's masks touch. The report of a run with benchmarks is written to report_path.
    """
    files = materialize(readers.code_files(spark, repo), "plan-files")
    masks = None
    if benchmarks:
        records = materialize(readers.benchmark_records(spark, benchmarks), "plan-records")
        lines = materialize(readers.line_table(files).withColumnRenamed("path", "file"), "plan-lines")
        matches = materialize(matching.match_records(records, lines, match), "plan-matches")
        masks = {k: materialize(v, f"plan-{k}") for k, v in matching.benchmark_masks(records, matches, lines, match).items()}
        told = materialize(samples.exclusion_reason(samples.candidates(files), masks["line_mask"], masks["file_prints"], masks["global_prints"]), "plan-told")
        drawn = samples.clean_samples(files, told, opts, masks["referenced"] if downweight else None)
    else:
        drawn = samples.fim_samples(files, opts)
    drawn = materialize(drawn, "plan-samples")
    shown = None
    if rag:
        cut = (samples.brace_chunks if chunks == "ast" else samples.line_chunks)(files, chunk_lines, chunk_overlap)
        drawn, shown = with_context(files, drawn, retrieval, cut, after_prefix, masks)
        drawn = materialize(drawn, "plan-context")
    split = samples.group_split(drawn, "file", val_ratio, opts.seed) if split_by_file else samples.bernoulli_split(drawn, ["file", "line_index"], val_ratio, opts.seed)
    split = materialize(split, "plan-split")
    sinks.write_splits(split, out)
    report = {"samples": {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}}
    if shown is not None:
        report["rag_exclusions"] = {r["reason"]: r["n"] for r in shown.collect()}
    if benchmarks:
        report |= bench_report(matches, told, split, masks, benchmarks)
        if report_path:
            sinks.write_report(spark, report, report_path)
    return report


def bench_report(matches: DataFrame, told: DataFrame, split: DataFrame, masks: dict[str, DataFrame], paths: list[str]) -> dict:
    """What became of the benchmark's items and of the lines they mask; its size is that of the benchmark."""
    items = [r.asDict() for r in matches.select("task_id", "status", "resolved_path", "line_index", "strategy", "confidence", "reason").collect()]
    return {
        "total_records": len(items), "matched": sum(r["status"] == "matched" for r in items), "unmatched": sum(r["status"] != "matched" for r in items),
        "matched_items": [r for r in items if r["status"] == "matched"], "unmatched_items": [r for r in items if r["status"] != "matched"],
        "items": [r.asDict() for r in matching.mask_report(matches).collect()],
        "referenced_files": sorted(r["file"] for r in masks["referenced"].collect()),
        "excluded_line_hits": {r["reason"]: r["n"] for r in told.filter("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n")).collect()},
        "bench_file_sample_counts": {r["file"]: r["n"] for r in matching.bench_file_counts(split, masks["referenced"]).collect()},
        "bench_paths": list(paths), "leaked": matching.leak_count(split, masks["line_mask"]).first()["leaked"],
    }


def with_context(files: DataFrame, drawn: DataFrame, opts: bm25.RetrieveOptions, cut: DataFrame, after_prefix: bool = False, masks: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(samples, excluded). Adds a block of chunks to the prompts that have one, before or behind the prefix, with rag, rag_query and rag_k_used.

    cut: chunks as samples.line_chunks() gives them; excluded: (reason, n) of the chunks that filters left out.
    """
    chunks = materialize(cut.withColumn("chunk_id", F.struct("file", "start", "end")).withColumn("tokens", tx.code_tokens(F.col("text"))), "context-chunks")
    all_lines = files.select(F.col("path").alias("file"), tx.splitlines(F.col("text")).alias("l"))
    at = F.col("line_index").cast("int")
    asked = drawn.join(all_lines, "file").select(F.col("id").alias("query_id"), "file", at.alias("line_index"), "completion", tx.build_query(F.slice("l", 1, at), F.slice("l", at + 2, F.size("l"))).alias("rag_query"))
    asked = materialize(asked.withColumn("tokens", tx.code_tokens(F.col("rag_query"))), "context-queries")
    contexts, excluded = bm25.retrieve(asked, chunks, opts, masks)
    d = drawn.join(contexts.join(asked.select("query_id", "rag_query"), "query_id").withColumnRenamed("query_id", "id"), "id", "left")
    d = d.withColumn("prompt", insert_context(F.col("prompt"), F.coalesce(tx.render_context(F.col("rag")), F.lit("")), after_prefix))
    d = d.withColumn("rag_k_used", F.size("rag")).withColumn("rag", F.transform("rag", lambda r: F.struct(r["file"].alias("file"), r["start"].alias("start"), r["end"].alias("end"))))
    return d, excluded


def insert_context(prompt: Column, block: Column, after_prefix: bool = False) -> Column:
    """The prompt with a block before or behind its whole prefix; as it is if the block is empty."""
    rest_at = F.locate(tx.FIM_SUFFIX, prompt)
    prefix = F.substr(prompt, F.lit(len(tx.FIM_PREFIX) + 1), rest_at - len(tx.FIM_PREFIX) - 1)
    placed = F.concat(prefix, block) if after_prefix else F.concat(block, prefix)
    return F.when(block == "", prompt).otherwise(F.concat(F.lit(tx.FIM_PREFIX), placed, F.substr(prompt, rest_at)))


def codefix_dataset(spark: SparkSession, repo: str, out: str, opts: codefix.CodefixOptions = codefix.CodefixOptions()) -> dict:
    """Statement-repair records of a code tree; writes splits and returns counts by mutation."""
    lines = readers.line_table(readers.code_files(spark, repo)).withColumnRenamed("path", "file")
    parsed = materialize(codefix.statements(lines), "plan-statements")
    pool = materialize(codefix.candidates(parsed, opts.seed), "plan-pool")
    chosen = materialize(codefix.exact_split(pool, opts.total, opts.val, opts.seed, opts.attempts), "plan-chosen")
    hints = codefix.augmentations(chosen, parsed.select("file", "line_index", "text"), opts)
    sinks.write_splits(codefix.records(chosen.join(hints, "id")), out)
    return {r["mutation_type"]: r.asDict() for r in codefix.mutation_counts(chosen).collect()}


def three_field_rows(rows: DataFrame, keep: bool = True) -> DataFrame:
    """Rows of (prompt, expectedCode, completedCode) with the expected code as completion; other columns stay if wanted."""
    named = rows.withColumn("completion", F.col("expectedCode"))
    return named if keep else named.select("prompt", "completion", *[c for c in ("split",) if c in rows.columns])


def converted_dataset(spark: SparkSession, files: dict[str, str], out: str, opts: convert.ConvertOptions = convert.ConvertOptions(), three_fields: bool = False) -> dict:
    """Prompts rewritten to a budget in two variants; writes splits and returns statistics and reasons."""
    rows = readers.load_splits(spark, files)
    if three_fields:
        rows = three_field_rows(rows)
    named = [c for c in ("id", "source_id") if c in rows.columns]
    fallback = F.concat_ws(":", "split", F.monotonically_increasing_id().cast("string"))
    rows = materialize(rows.withColumn("source_id", F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in named], fallback)), "plan-rows")
    done = materialize(convert.convert(rows, opts), "plan-converted")
    sinks.write_splits(done.filter("drop_reason is null").drop("drop_reason", "emitted"), out)
    return {"splits": [r.asDict() for r in convert.split_stats(done).collect()], "drop_reasons": [r.asDict(True) for r in convert.drop_maps(done).collect()], "originals": [r.asDict() for r in convert.emission_tally(done).collect()]}


def filtered_dataset(spark: SparkSession, path: str, kept: str, rejected: str | None, ask=None, opts: modelfilter.FilterOptions = modelfilter.FilterOptions(), shuffle: bool = False, limit: int | None = None, seed: int = 42, max_keep: int | None = None, progress_seconds: float = 0.0) -> dict:
    """Samples that a model completes as expected; writes both sinks and the manifest, and returns the manifest.

    With max_keep the outputs and counts end at the row that was kept last; rows behind it have been asked in vain.
    """
    started = sinks.now_utc()
    parsed = readers.jsonl_lenient(spark, path)
    rows = materialize(parsed.select(F.monotonically_increasing_id().alias("pos"), "value", *[F.when(readers.json_type(c) == "STRING", readers.field(c)).alias(c) for c in ("prompt", "completion")]), "plan-input")
    rows = readers.load_policy(rows, "pos", shuffle, limit, seed)
    with modelfilter.Progress(spark, progress_seconds) if progress_seconds else contextlib.nullcontext() as progress:
        done = materialize(modelfilter.evaluate(modelfilter.ask_model(rows, ask or modelfilter.http_client(opts), opts, progress=progress), opts), "plan-evaluated")
    done = modelfilter.until_kept(done, "pos", max_keep)
    sinks.write_routed(done, kept, rejected)
    stats_row = modelfilter.run_stats(done).first().asDict() | {"reasons": {r["reason"]: r["n"] for r in modelfilter.reason_counts(done).collect()}}
    stats_row |= {"reached_max_samples": bool(limit and limit > 0 and rows.count() >= limit), "reached_max_keep": bool(max_keep and stats_row["kept"] >= max_keep)}
    manifest = sinks.run_manifest(dataclasses.asdict(opts), stats_row, started, opts.model, opts.endpoint, sys.argv)
    sinks.write_report(spark, manifest, sinks.manifest_path(kept))
    return manifest


def corpus_report(spark: SparkSession, paths: list[str], top: int = 50, longest: int = 20, plot_projects: int = 20) -> dict:
    """Counts, quantiles, longest prompts, histograms and bars of JSON lines with metadata; sinks.corpus_text() renders it."""
    rows = readers.parse_lines(spark.read.text(readers.find_files(spark, paths)).withColumn("file_name", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))).filter("status = 'ok'")
    parts = readers.field("metadata.fpath_tuple", "array<string>")
    size, truth = tx.text_size(readers.field("prompt")), tx.text_size(readers.field("metadata.ground_truth"))
    task = tx.task_project(readers.field("metadata.task_id"))
    d = rows.select(
        F.monotonically_increasing_id().alias("pos"), "file_name", readers.field("metadata.task_id").alias("task_id"), F.coalesce(F.nullif(task, F.lit("")), F.lit("unknown")).alias("task_project"), tx.path_project(parts).alias("path_project"),
        tx.canonical_project(task, tx.path_project(parts)).alias("project"), size["chars"].alias("prompt_chars"), size["lines"].alias("prompt_lines"), truth["chars"].alias("truth_chars"), truth["lines"].alias("truth_lines"),
    )
    d = materialize(d, "plan-report")
    projects = stats.group_share(d, "project", "pos", top)
    guard = stats.has_more_groups(d, "task_project", "project").first().asDict()
    first = [r.asDict() for r in projects.collect()]
    by_project = stats.distribution(d.join(F.broadcast(projects.select("project")), "project", "left_semi"), "prompt_chars", ["project"])  # `top` rows
    return {
        "total": d.count(), "files": [r.asDict() for r in stats.group_share(d, "file_name", "pos").collect()], "projects": first, "guard": guard,
        "task_projects": [r.asDict() for r in stats.group_share(d, "task_project", "pos", top).collect()] if guard["differ"] else [],
        **{c: stats.distribution(d, c).first().asDict() for c in ("prompt_chars", "prompt_lines", "truth_chars", "truth_lines")},
        "by_project": {r["project"]: r.asDict() for r in by_project.collect()},
        "longest": [r.asDict() for r in stats.top_longest(d, "prompt_chars", "pos", longest).collect()],
        "histogram": [r.asDict() for r in stats.histogram(d, "prompt_chars").collect()], "histogram_lines": [r.asDict() for r in stats.histogram(d, "prompt_lines").collect()],
        "bars": [{"project": r["project"], "n": r["n"]} for r in first[:plot_projects]],
    }


def training_rows(rows: DataFrame, encode, max_length: int, eos_id: int) -> DataFrame:
    """Label rows of prompts and completions; encode is a column function from text to ids."""
    return tensors.label_rows(rows.withColumn("prompt_ids", encode(F.col("prompt"))).withColumn("completion_ids", encode(F.col("completion"))), max_length, eos_id)
