"""Filtering samples against a model's answers: request, compare, route, count."""

from __future__ import annotations

import json
import random
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import first_line, normalize_for_mode
from millrace.operators.matching import sequence_ratio

MODES = ("exact", "trimmed", "ws_norm", "fuzzy")
TRANSIENT_CODES = (429, 502, 503, 504)


@dataclass(frozen=True)
class FilterOptions:
    model: str = ""
    endpoint: str = ""
    match_mode: str = "ws_norm"
    fuzzy_threshold: float = 0.98
    first_line_only: bool = True
    concurrency: int = 8
    qps: float = 0.0
    retries: int = 5
    backoff: float = 0.5
    timeout: float = 60.0
    params: dict = field(default_factory=lambda: {"max_tokens": 64, "temperature": 0.0, "top_p": 1.0, "stop": ["\n"]})


class RequestFailed(Exception):
    """A request that has no answer: reason, and whether another try may help."""

    def __init__(self, reason: str, transient: bool, detail: str = ""):
        super().__init__(f"{reason}: {detail}"[:300])
        self.reason, self.transient, self.detail = reason, transient, detail[:300]


def completions_url(endpoint: str) -> str:
    base = endpoint.rstrip("/")
    if base.endswith("/completions"):
        return base
    return f"{base}/completions" if base.endswith("/v1") else f"{base}/v1/completions"


def parse_completion(body: str) -> str:
    """The text of the first choice: its text, or its message's content, or the joined texts of a content list that has any."""
    try:
        data = json.loads(body)
    except ValueError as e:
        raise RequestFailed("bad_response_json", False, str(e)) from e
    choices = data.get("choices") if isinstance(data, dict) else None
    first = choices[0] if isinstance(choices, list) and choices else None
    if isinstance(first, dict):
        if isinstance(first.get("text"), str):
            return first["text"]
        message = first.get("message")
        content = message.get("content") if isinstance(message, dict) else None
        if isinstance(content, str):
            return content
        texts = [p["text"] for p in content if isinstance(p, dict) and isinstance(p.get("text"), str)] if isinstance(content, list) else []
        if texts:
            return "".join(texts)
    raise RequestFailed("bad_response_schema", False, "no text in the first choice")


def parse_completion_column(body: Column) -> Column:
    """The same over a column of response bodies; null where it has no such text."""
    v = F.try_parse_json(body)

    def get(path: str, kind: str) -> Column:
        return F.call_function("try_variant_get", v, F.lit(path), F.lit(kind))

    def kind(value: Column) -> Column:
        return F.call_function("schema_of_variant", value)

    def text(path: str) -> Column:
        return F.when(kind(get(path, "variant")) == "STRING", get(path, "string"))

    parts = F.filter(get("$.choices[0].message.content", "array<variant>"), lambda p: F.coalesce(kind(F.call_function("try_variant_get", p, F.lit("$.text"), F.lit("variant"))) == "STRING", F.lit(False)))
    joined = F.array_join(F.transform(parts, lambda p: F.call_function("try_variant_get", p, F.lit("$.text"), F.lit("string"))), "")
    return F.coalesce(text("$.choices[0].text"), text("$.choices[0].message.content"), F.when(F.size(parts) > 0, joined))


def classify_error(error: BaseException) -> tuple[str, bool, str]:
    """(reason, whether another try may help, detail of at most 300 characters); the detail of an HTTP error is its body."""
    detail = str(error)[:300]
    if isinstance(error, RequestFailed):
        return error.reason, error.transient, error.detail
    if isinstance(error, urllib.error.HTTPError):
        try:
            body = error.read().decode(errors="replace").strip()
        except Exception:  # noqa: BLE001  a body that cannot be read is none
            body = ""
        return f"http_{error.code}", error.code in TRANSIENT_CODES, body[:300] or detail
    inner = error.reason if isinstance(error, urllib.error.URLError) else error
    wrapped = inner is not error
    if isinstance(inner, TimeoutError) or (wrapped and "timed out" in str(inner).lower()):
        return "timeout", True, str(inner)[:300]
    if isinstance(inner, ConnectionResetError):
        return "connection_reset", True, str(inner)[:300]
    if wrapped:
        return "network_error", True, str(inner)[:300]
    if isinstance(error, json.JSONDecodeError):
        return "bad_response_json", False, detail
    return "bad_response_schema" if isinstance(error, ValueError) else "request_error", False, detail


def http_client(opts: FilterOptions) -> Callable[[str], str]:
    """A client that posts a prompt to a completions endpoint."""

    def ask(prompt: str) -> str:
        body = json.dumps({"model": opts.model, "prompt": prompt, **opts.params}).encode()
        request = urllib.request.Request(completions_url(opts.endpoint), body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=opts.timeout) as got:
            return parse_completion(got.read().decode())

    return ask


def ask_with_retries(ask: Callable[[str], str], prompt: str, opts: FilterOptions, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, int | None, str | None, str | None]:
    """(text, latency in ms, error reason, its detail): transient errors are tried again after growing pauses with jitter."""
    for attempt in range(opts.retries + 1):
        began = time.monotonic()
        try:
            return ask(prompt), int((time.monotonic() - began) * 1000), None, None
        except Exception as e:  # noqa: BLE001  any failure of a client becomes a reason
            reason, transient, detail = classify_error(e)
            if not transient or attempt == opts.retries:
                return None, None, reason, detail
            sleep(opts.backoff * 2**attempt + random.uniform(0, opts.backoff))
    return None, None, "request_error", "no attempt was made"


class Progress:
    """Counts of a run that tasks add to; a thread of the driver prints them every `seconds` until the block ends."""

    def __init__(self, spark: SparkSession, seconds: float = 30.0, say: Callable[[str], None] = print):
        self.asked, self.failed = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
        self.seconds, self.say, self._end = seconds, say, threading.Event()

    def line(self) -> str:
        return f"[progress] asked={self.asked.value} errors={self.failed.value}"

    def __enter__(self) -> Progress:
        def watch() -> None:
            while not self._end.wait(self.seconds):
                self.say(self.line())

        threading.Thread(target=watch, daemon=True).start()
        return self

    def __exit__(self, *_) -> None:
        self._end.set()
        self.say(self.line())


def ask_model(df: DataFrame, ask: Callable[[str], str], opts: FilterOptions, prompt: str = "prompt", progress: Progress | None = None) -> DataFrame:
    """Adds teacher_raw, latency_ms, request_error and error_detail. Rows whose prompt is null are not asked.

    Each task keeps up to `concurrency` requests in flight. A qps limit is shared by the tasks that can run at once, so it
    is never exceeded. A batch's prompts that are equal are asked once.
    """
    at_once = df.sparkSession.sparkContext.defaultParallelism
    added = [T.StructField("teacher_raw", T.StringType()), T.StructField("latency_ms", T.IntegerType()), T.StructField("request_error", T.StringType()), T.StructField("error_detail", T.StringType())]
    counters = (progress.asked, progress.failed) if progress else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pause = at_once / opts.qps if opts.qps else 0.0
        with ThreadPoolExecutor(opts.concurrency) as pool:
            for b in batches:
                jobs = {}
                for p in b[prompt].dropna().unique():
                    jobs[p] = pool.submit(ask_with_retries, ask, p, opts)
                    time.sleep(pause)
                got = [jobs[p].result() if p in jobs else (None,) * 4 for p in b[prompt]]
                if counters:
                    counters[0].add(len(got)), counters[1].add(sum(g[2] is not None for g in got))
                yield b.assign(teacher_raw=[g[0] for g in got], latency_ms=pd.array([g[1] for g in got], dtype="Int32"), request_error=[g[2] for g in got], error_detail=[g[3] for g in got])

    return df.mapInPandas(run, T.StructType([*df.schema.fields, *added]))


def compare(df: DataFrame, mode: str, threshold: float = 0.98, truth: str = "gt_raw", answer: str = "teacher_raw", one_line: bool = True) -> DataFrame:
    """Adds gt_norm, teacher_norm, similarity (fuzzy only) and equal. Null answers are not equal; one_line compares the first line of both."""
    if mode not in MODES:
        raise ValueError(f"unknown match mode {mode}")

    def taken(name: str) -> Column:
        return first_line(F.replace(F.col(name), F.lit("\r\n"), F.lit("\n"))) if one_line else F.col(name)

    d = df.withColumn("gt_norm", normalize_for_mode(taken(truth), mode)).withColumn("teacher_norm", normalize_for_mode(taken(answer), mode))
    if mode == "fuzzy":
        d = d.withColumn("similarity", sequence_ratio("gt_norm", "teacher_norm"))
        return d.withColumn("equal", F.coalesce(F.col("similarity") >= threshold, F.lit(False)))
    return d.withColumn("similarity", F.lit(None).cast("double")).withColumn("equal", F.coalesce(F.col("gt_norm") == F.col("teacher_norm"), F.lit(False)))


def evaluate(answered: DataFrame, opts: FilterOptions = FilterOptions(), prompt: str = "prompt", truth: str = "completion") -> DataFrame:
    """Adds passed, is_error, reason and teacher_filter to rows with teacher_raw, latency_ms and request_error."""
    d = compare(answered.withColumn("gt_raw", F.col(truth)), opts.match_mode, opts.fuzzy_threshold, one_line=opts.first_line_only)
    bad = F.col(prompt).isNull() | F.col(truth).isNull()
    reason = F.when(bad, "error:bad_input").when(F.col("request_error").isNotNull(), F.concat(F.lit("error:"), F.col("request_error"))).when(F.col("equal"), "passed").otherwise("mismatch")
    d = d.withColumn("reason", reason).withColumn("passed", F.col("reason") == "passed").withColumn("is_error", F.col("reason").startswith("error:"))
    stop = F.array(*map(F.lit, opts.params.get("stop", []))).cast("array<string>")
    params = F.struct(*[F.lit(v).alias(k) for k, v in opts.params.items() if k != "stop"], stop.alias("stop"))
    meta = F.struct(
        F.lit(opts.model).alias("model"), F.lit(opts.endpoint).alias("endpoint"), params.alias("params"), F.lit(opts.match_mode).alias("match_mode"), F.col("passed").alias("passed"), F.col("teacher_raw").alias("teacher_text"),
        F.col("teacher_norm").alias("teacher_text_norm"), F.col("gt_norm").alias("gt_norm"), F.when(F.col("is_error"), F.expr("substring(reason, 7)")).alias("error"), F.col("similarity").alias("similarity"), F.col("latency_ms").alias("latency_ms"),
    )
    return d.withColumn("teacher_filter", meta).drop("gt_raw", "gt_norm", "teacher_norm", "similarity", "equal")


def run_stats(evaluated: DataFrame) -> DataFrame:
    """One row: processed, kept, rejected, errors, keep_rate (0 if there is nothing), avg_latency_ms."""
    kept, n = F.count_if(F.col("passed")), F.count(F.lit(1))
    return evaluated.agg(n.alias("processed"), kept.alias("kept"), (n - kept).alias("rejected"), F.count_if(F.col("is_error")).alias("errors"), F.when(n == 0, 0.0).otherwise(kept / n).alias("keep_rate"), F.avg("latency_ms").alias("avg_latency_ms"))


def reason_counts(evaluated: DataFrame) -> DataFrame:
    return evaluated.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def until_kept(evaluated: DataFrame, order: str, n: int | None) -> DataFrame:
    """Rows up to the n-th that passed, in input order: what a run that stops early has seen. All rows if fewer pass."""
    if not n or n <= 0:
        return evaluated
    last = first_kept(evaluated, order, n).agg(F.count(F.lit(1)).alias("n"), F.max(order).alias("at")).first()
    return evaluated.filter(F.col(order) <= F.lit(last["at"])) if last["n"] == n else evaluated


def first_kept(evaluated: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows that passed, in input order."""
    return evaluated.filter("passed").orderBy(order).limit(n)
