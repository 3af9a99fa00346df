"""python -m millrace {samples,convert,codefix,filter,report} ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from millrace.operators.bm25 import RetrieveOptions
from millrace.operators.codefix import CodefixOptions
from millrace.operators.convert import ConvertOptions
from millrace.operators.matching import MatchOptions
from millrace.operators.modelfilter import MODES, FilterOptions
from millrace.operators.samples import SampleOptions
from millrace.plans import pipelines
from millrace.sources import sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="millrace")
    sub = p.add_subparsers(dest="plan", required=True)
    s = sub.add_parser("samples")
    s.add_argument("repo"), s.add_argument("out")
    s.add_argument("--benchmark", action="append"), s.add_argument("--val-ratio", type=float, default=0.02), s.add_argument("--seed", type=int, default=42)
    s.add_argument("--prefix-lines", type=int, default=80), s.add_argument("--suffix-lines", type=int, default=80), s.add_argument("--per-file", type=int, default=60)
    s.add_argument("--match-window", type=int, default=60), s.add_argument("--fuzzy", action="store_true"), s.add_argument("--downweight", type=float, default=0.25)
    s.add_argument("--split-by-file", action="store_true"), s.add_argument("--rag", action="store_true"), s.add_argument("--after-prefix", action="store_true")
    s.add_argument("--k", type=int, default=4), s.add_argument("--max-chars", type=int, default=2000), s.add_argument("--max-snippet-chars", type=int, default=600), s.add_argument("--same-file-window", type=int, default=80)
    s.add_argument("--chunk-lines", type=int, default=30), s.add_argument("--chunk-overlap", type=int, default=10)
    s.add_argument("--chunks", choices=("lines", "ast"), default="lines"), s.add_argument("--report"), s.add_argument("--leak-policy", choices=("mask_only", "downweight_files"), default="downweight_files")
    flag = argparse.BooleanOptionalAction
    s.add_argument("--global-blocklist", action=flag, default=True), s.add_argument("--exclude-bench", action=flag, default=True), s.add_argument("--exclude-completion", action=flag, default=True)
    c = sub.add_parser("convert")
    c.add_argument("train"), c.add_argument("validation"), c.add_argument("out")
    c.add_argument("--max-length", type=int, default=2048), c.add_argument("--policy", choices=("drop_file_sep_prefix_then_left", "left"), default="drop_file_sep_prefix_then_left")
    c.add_argument("--min-completion-tokens", type=int, default=1), c.add_argument("--max-iters", type=int, default=128), c.add_argument("--conflict", choices=("keep_one", "skip"), default="keep_one"), c.add_argument("--three-fields", action="store_true")
    f = sub.add_parser("codefix")
    f.add_argument("repo"), f.add_argument("out")
    f.add_argument("--total", type=int, default=5000), f.add_argument("--val", type=int, default=100), f.add_argument("--k", type=int, default=4), f.add_argument("--same-file-window", type=int, default=80), f.add_argument("--seed", type=int, default=42), f.add_argument("--attempts", type=int, default=300)
    m = sub.add_parser("filter")
    m.add_argument("path"), m.add_argument("kept"), m.add_argument("--rejected"), m.add_argument("--model", required=True), m.add_argument("--endpoint", required=True)
    m.add_argument("--match-mode", choices=MODES, default="ws_norm"), m.add_argument("--fuzzy-threshold", type=float, default=0.98), m.add_argument("--concurrency", type=int, default=8), m.add_argument("--qps", type=float, default=0.0)
    m.add_argument("--retries", type=int, default=5), m.add_argument("--backoff", type=float, default=0.5), m.add_argument("--shuffle", action="store_true"), m.add_argument("--limit", type=int), m.add_argument("--seed", type=int, default=42)
    m.add_argument("--max-keep", type=int), m.add_argument("--progress-seconds", type=float, default=0.0)
    r = sub.add_parser("report")
    r.add_argument("paths", nargs="+"), r.add_argument("--top", type=int, default=50), r.add_argument("--longest", type=int, default=20), r.add_argument("--plot-projects", type=int, default=20), r.add_argument("--text", action="store_true")
    return p


def check(a: argparse.Namespace, fail) -> None:
    """Arguments that no run can mean end it before it starts."""
    if a.plan == "codefix":
        for name in ("total", "k", "attempts"):
            if getattr(a, name) <= 0:
                fail(f"--{name} must be positive")
        if not 0 <= a.val < a.total or a.same_file_window < 0:
            fail("--val must lie between 0 and --total, and --same-file-window must not be negative")
    if a.plan == "filter":
        if a.concurrency <= 0 or a.retries < 0 or a.qps < 0 or not 0 <= a.fuzzy_threshold <= 1:
            fail("--concurrency must be positive, --retries and --qps not negative, --fuzzy-threshold from 0 to 1")
    if a.plan == "samples" and not 0 <= a.val_ratio <= 1:
        fail("--val-ratio must lie between 0 and 1")


def main(argv: list[str] | None = None) -> None:
    p = parser()
    a = p.parse_args(argv)
    check(a, p.error)
    spark = SparkSession.builder.appName(f"millrace-{a.plan}").getOrCreate()
    if a.plan == "samples":
        out = pipelines.fim_dataset(
            spark, a.repo, a.out, a.benchmark, a.val_ratio, a.split_by_file, a.rag, a.after_prefix, SampleOptions(a.prefix_lines, a.suffix_lines, a.per_file, a.downweight, a.seed),
            MatchOptions(a.match_window, a.fuzzy, global_blocklist=a.global_blocklist), RetrieveOptions(a.k, a.max_chars, a.max_snippet_chars, a.same_file_window, a.exclude_completion, a.exclude_bench), a.chunk_lines, a.chunk_overlap,
            a.chunks, a.report, a.leak_policy == "downweight_files",
        )
    elif a.plan == "convert":
        out = pipelines.converted_dataset(spark, {"train": a.train, "validation": a.validation}, a.out, ConvertOptions(max_length=a.max_length, policy=a.policy, min_completion_tokens=a.min_completion_tokens, max_iters=a.max_iters, conflict=a.conflict), a.three_fields)
    elif a.plan == "codefix":
        out = pipelines.codefix_dataset(spark, a.repo, a.out, CodefixOptions(a.total, a.val, a.k, a.same_file_window, a.seed, a.attempts))
    elif a.plan == "filter":
        opts = FilterOptions(a.model, a.endpoint, a.match_mode, a.fuzzy_threshold, concurrency=a.concurrency, qps=a.qps, retries=a.retries, backoff=a.backoff)
        out = pipelines.filtered_dataset(spark, a.path, a.kept, a.rejected, None, opts, a.shuffle, a.limit, a.seed, a.max_keep, a.progress_seconds)
    else:
        out = pipelines.corpus_report(spark, a.paths, a.top, a.longest, a.plot_projects)
    print(sinks.console_summary(a.plan, out), file=sys.stderr)
    print(sinks.corpus_text(out) if a.plan == "report" and a.text else json.dumps(out, ensure_ascii=False, indent=2, default=str))


if __name__ == "__main__":
    main()
