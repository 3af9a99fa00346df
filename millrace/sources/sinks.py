"""Sinks: JSON lines, routed outputs, reports and manifests."""

from __future__ import annotations

import json
import platform
import subprocess
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, keep_nulls: bool = True, gzip: bool = False) -> None:
    """UTF-8 JSON lines, characters unescaped."""
    writer = df.write.mode("overwrite").option("ignoreNullFields", str(not keep_nulls).lower())
    (writer.option("compression", "gzip") if gzip else writer).json(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One folder for each split."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").partitionBy(split).json(path)


def write_routed(df: DataFrame, kept_path: str, rejected_path: str | None, passed: str = "passed") -> None:
    """Rows that passed to one sink and the others to another, if it is wanted. df should be a written table: it is read for each."""
    write_jsonl(df.filter(F.col(passed)), kept_path)
    if rejected_path:
        write_jsonl(df.filter(~F.coalesce(F.col(passed), F.lit(False))), rejected_path)


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """A report as one JSON text file; values come from aggregates."""
    spark.createDataFrame([(json.dumps(report, ensure_ascii=False, indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def manifest_path(output: str) -> str:
    """X.jsonl or X.jsonl.gz becomes X.run_manifest.json."""
    stem = output.removesuffix(".gz").removesuffix(".jsonl")
    return f"{stem}.run_manifest.json"


def now_utc() -> str:
    return datetime.now(UTC).isoformat()


def git_commit() -> str | None:
    got = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, check=False)
    return got.stdout.strip() if got.returncode == 0 else None


def run_manifest(args: dict, stats: dict, started: str, model: str, endpoint: str, argv: list[str]) -> dict:
    return {"started_at": started, "finished_at": now_utc(), "args": args, "argv": argv, "git_commit": git_commit(), "python_version": platform.python_version(), "model": model, "endpoint": endpoint, **stats}


def text_report(title: str, rows: list[tuple[str, object]]) -> str:
    """Aligned lines; floats with one digit, numbers that are not finite left out."""
    shown = [(k, f"{v:.1f}" if isinstance(v, float) else str(v)) for k, v in rows if not (isinstance(v, float) and (v != v or abs(v) == float("inf")))]
    width = max((len(k) for k, _ in shown), default=0)
    return "\n".join([title, *[f"  {k.ljust(width)}  {v}" for k, v in shown]])


def _spread(title: str, d: dict) -> str:
    if not d.get("count"):
        return f"{title}: no rows"
    shown = [(k, d[k]) for k in ("count", "min", "p25", "p50", "p75", "p90", "p95", "p99", "max", "mean") if d.get(k) is not None and d[k] == d[k]]
    return f"{title}: " + ", ".join(f"{k}={v:.2f}" if k == "mean" else f"{k}={v:.1f}" if isinstance(v, float) else f"{k}={v}" for k, v in shown)


def corpus_text(report: dict) -> str:
    """The corpus report as text: shares by file and project, spreads, quantiles of projects, longest prompts."""
    share = lambda key, rows: [f"  {r[key]}: {r['n']} ({r['share']:.2f}%)" for r in rows]
    out = [f"Samples: {report['total']}", "", "Files:", *share("file_name", report["files"]), "", "Projects:", *share("project", report["projects"]), ""]
    if report["task_projects"]:
        out += ["Projects by task:", *share("task_project", report["task_projects"]), ""]
    out += [_spread(title, report[key]) for title, key in (("Prompt characters", "prompt_chars"), ("Prompt lines", "prompt_lines"), ("Ground truth characters", "truth_chars"), ("Ground truth lines", "truth_lines"))]
    rows = [report["by_project"][r["project"]] for r in report["projects"] if r["project"] in report["by_project"]]
    out += ["", "Prompt characters by project:", *[f"  {r['project']}: p50={r['p50']:.1f}, p90={r['p90']:.1f}, p99={r['p99']:.1f}, count={r['count']}" for r in rows], "", "Longest prompts:"]
    out += [f"  {i}. chars={r['prompt_chars']}, lines={r['prompt_lines']}, project={r['project']}, file={r['file_name']}, task={r['task_id']}, path={r['path_project'] or ''}" for i, r in enumerate(report["longest"], 1)]
    return "\n".join(out)


def console_summary(plan: str, report: dict) -> str:
    """A run's totals in a few lines: numbers and texts as they are, maps and lists by their sizes or numbers."""
    def value(v: object) -> str:
        if isinstance(v, dict):
            return ", ".join(f"{k}={x}" for k, x in v.items() if isinstance(x, (int, float, str))) or f"{len(v)} entries"
        return f"{len(v)} entries" if isinstance(v, list) else str(v)

    return text_report(plan, [(k, value(v) if isinstance(v, (dict, list)) else v) for k, v in report.items()])


def preview(df: DataFrame, columns: list[str], n: int = 3, width: int = 80) -> list[str]:
    """The first n rows as short lines for a log."""
    rows = df.select(*[F.substring(F.regexp_replace(F.col(c).cast("string"), "\\s+", " "), 1, width).alias(c) for c in columns]).limit(n).collect()
    return [" | ".join(str(v) for v in r) for r in rows]
