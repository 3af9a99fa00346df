"""Text functions as Spark columns, with Python's rules for white space, line ends and lengths."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters that Python's str.isspace accepts, as a class of Java's regular expressions.
PY_WS = r"[\t-\r\x1c-\x1f\x85\p{Z}]"
_ENDS = r"\n\r\x0b\x0c\x1c-\x1e\x85  "
FIM_PREFIX, FIM_SUFFIX, FIM_MIDDLE, FILE_SEP = "<|fim_prefix|>", "<|fim_suffix|>", "<|fim_middle|>", "<|file_sep|>"

#: Words that carry no meaning in code and prose.
JAVA_STOPWORDS = (
    "public private protected class interface enum return static final void int long double float boolean char byte short new if "
    "else switch case default break continue for while do try catch finally throws throw extends implements this super null "
    "true false package import var assert instanceof yield record"
).split()
EN_STOPWORDS = "a an the and or but with without on in at by to of for from as is are was were be been being it that this these those".split()
STOPWORDS = sorted({*JAVA_STOPWORDS, *EN_STOPWORDS})


@F.arrow_udf(StringType())
def _without_invalid(content: pa.Array) -> pa.Array:
    return pa.array([None if x is None else x.decode(errors="ignore") for x in content.to_pylist()], pa.string())


def decode_ignore(content: Column) -> Column:
    """Bytes as text; invalid bytes are deleted and all line ends become a newline. Only rows with invalid bytes leave the JVM."""
    valid = F.call_function("is_valid_utf8", content.cast("string"))
    text = F.when(valid, content.cast("string")).otherwise(_without_invalid(F.when(~valid, content)))
    return F.regexp_replace(text, "\r\n?", "\n")


def splitlines(text: Column, keepends: bool = True) -> Column:
    """Python's str.splitlines."""
    lines = F.regexp_extract_all(text, F.lit(rf"[^{_ENDS}]*(?:\r\n|[{_ENDS}])|[^{_ENDS}]+$"), 0)
    return lines if keepends else F.transform(lines, lambda x: F.regexp_replace(x, rf"(?:\r\n|[{_ENDS}])$", ""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once for a row however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rstrip_newlines(text: Column) -> Column:
    return F.rtrim(text, F.lit("\r\n"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{PY_WS}+|{PY_WS}+$", "")


def ws_norm(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.regexp_replace(strip(text), f"{PY_WS}+", " ")


def good_target_line(line: Column, min_chars: int = 4) -> Column:
    """Whether a line is worth completing: not short, not brackets and semicolons only, no package or import line."""
    s = strip(line)
    return (F.length(s) >= min_chars) & ~s.rlike(r"^[{}();]+$") & ~s.startswith("package ") & ~s.startswith("import ")


def ground_truth_forms(raw: Column) -> Column:
    """The four normal forms of a ground truth."""
    no_newline = rstrip_newlines(raw)
    return F.struct(raw.alias("gt_raw"), no_newline.alias("gt_nl_stripped"), strip(no_newline).alias("gt_trimmed"), ws_norm(no_newline).alias("gt_ws_norm"))


def line_fingerprints(line: Column) -> Column:
    """The line without its end, and with white space collapsed."""
    base = rstrip_newlines(line)
    return F.array_distinct(F.array(base, ws_norm(base)))


def lines_equal(a: Column, b: Column) -> Column:
    return rstrip_newlines(a) == rstrip_newlines(b)


def header_end(lines: Column) -> Column:
    """How many first lines are the header.

    A package line on line 0 with blank lines behind it, then import lines with blanks between and behind them. Anything
    else, a licence comment too, ends the header. Folded over the lines: state 0 is the start, 1 behind a package line,
    2 in the imports, 3 past the header.
    """

    def step(acc: Column, line: Column) -> Column:
        text = F.regexp_replace(line, f"^{PY_WS}+", "")
        state = (
            F.when(acc["state"] == 3, 3)
            .when((acc["at"] == 0) & text.startswith("package "), 1)
            .when(text.startswith("import "), 2)
            .when((F.length(text) == 0) & acc["state"].isin(1, 2), acc["state"])
            .otherwise(3)
        )
        return F.struct((acc["at"] + 1).alias("at"), state.alias("state"), F.when(state == 3, acc["end"]).otherwise(acc["at"] + 1).alias("end"))

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("state"), F.lit(0).alias("end"))
    return F.aggregate(lines, start, step)["end"]


def fim_prompt(prefix: Column, suffix: Column) -> Column:
    return F.concat(F.lit(FIM_PREFIX), prefix, F.lit(FIM_SUFFIX), suffix, F.lit(FIM_MIDDLE))


def has_all_fim(prompt: Column) -> Column:
    return prompt.contains(FIM_PREFIX) & prompt.contains(FIM_SUFFIX) & prompt.contains(FIM_MIDDLE)


def fim_in_order(prompt: Column) -> Column:
    """First prefix, after it a suffix, after that a middle token."""
    first = F.locate(FIM_PREFIX, prompt)
    second = F.when(first > 0, F.call_function("locate", F.lit(FIM_SUFFIX), prompt, first + len(FIM_PREFIX))).otherwise(0)
    third = F.when(second > 0, F.call_function("locate", F.lit(FIM_MIDDLE), prompt, second + len(FIM_SUFFIX))).otherwise(0)
    return third > 0


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_HUMP = "\x01"


def code_tokens(text: Column, drop_stopwords: bool = True, identifiers_only: bool = False) -> Column:
    """Lower-cased tokens of code: runs of letters, digits, `_` and `.`, cut at `_`; a camel-case hump becomes a blank inside its token.

    The text is marked at its humps, lower-cased and split once; a token is only looked at to drop it or to set its blanks.
    """
    marked = F.regexp_replace(F.translate(text, _HUMP, " "), "([a-z0-9])(?=[A-Z])", f"$1{_HUMP}")
    parts = F.split(F.translate(marked, _UPPER, _UPPER.lower()), f"[^a-z0-9.{_HUMP}]+")
    parts = F.filter(parts, lambda x: ~x.isin("", *(STOPWORDS if drop_stopwords else [])))
    parts = F.transform(parts, lambda x: F.translate(x, _HUMP, " "))
    return F.filter(parts, lambda x: x.rlike("^[a-z_][a-z0-9_]*$")) if identifiers_only else parts


#: For code_tokens_arrow(): letters are lower-cased, bytes that no token has become blanks.
_TOKEN_BYTES = bytes(ord(_UPPER[c - 65].lower()) if 65 <= c <= 90 else c if chr(c) in f"abcdefghijklmnopqrstuvwxyz0123456789.{_HUMP}" else 32 for c in range(256))
_KINDS = bytes(65 if chr(c) in _UPPER else 97 if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))
_HUMPS, _STOP_BYTES = re.compile(rb"(?<=[a-z0-9])(?=[A-Z])"), frozenset(w.encode() for w in STOPWORDS)


def code_tokens_arrow(texts: pa.Array) -> pa.ListArray:
    """code_tokens() of Arrow's texts, for tasks that only count tokens: bytes are translated and split, a fraction of the column's time."""
    flat, ends = [], [0]
    for raw in texts.cast(pa.binary()).to_pylist():
        if raw is not None:
            marked = raw.replace(b"\x01", b" ")
            if b"aA" in marked.translate(_KINDS):
                marked = _HUMPS.sub(b"\x01", marked)
            tokens = [t for t in marked.translate(_TOKEN_BYTES).split() if t not in _STOP_BYTES]
            flat += tokens if len(marked) == len(raw) else [t.replace(b"\x01", b" ") for t in tokens]
        ends.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.binary()).cast(pa.string()), mask=texts.is_null() if texts.null_count else None)


def truncate_snippet(text: Column, max_chars: int) -> Column:
    """Head and tail around an ellipsis line, of max_chars together; max_chars must be over 10."""
    if max_chars <= 10:
        raise ValueError("max_chars must be over 10")
    head = max_chars // 2
    tail = max_chars - head - 5
    return F.when(F.length(text) <= max_chars, text).otherwise(F.concat(F.substring(text, 1, head), F.lit("\n...\n"), F.right(text, F.lit(tail))))


def build_query(before: Column, after: Column, mode: str = "hybrid", window: int = 20) -> Column:
    """The retrieval query of a place, from arrays of the lines around it. window 0 takes all lines."""
    tail = F.when(F.size(before) > window, F.slice(before, F.greatest(F.size(before) - window + 1, F.lit(1)), window)).otherwise(before) if window else before
    head = F.slice(after, 1, window) if window else after
    text = F.concat(F.array_join(tail, ""), F.lit("\n"), F.array_join(head, ""))
    names = F.array_join(F.regexp_extract_all(text, F.lit("[A-Za-z_][A-Za-z0-9_]*"), 0), " ")
    return {"ast_symbols": names, "hybrid": F.concat(text, F.lit("\n"), names)}.get(mode, text)


def first_line(text: Column) -> Column:
    """Up to the first newline, or the first carriage return if there is none."""
    return F.when(text.contains("\n"), F.substring_index(text, "\n", 1)).otherwise(F.substring_index(text, "\r", 1))


def normalize_for_mode(text: Column, mode: str) -> Column:
    unix = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    if mode == "exact":
        return rstrip_newlines(unix)
    return strip(unix) if mode == "trimmed" else ws_norm(unix)


def text_size(text: Column) -> Column:
    """Characters and lines; none for null and empty texts."""
    some = F.length(F.coalesce(text, F.lit(""))) > 0
    return F.struct(F.when(some, F.length(text)).otherwise(0).alias("chars"), F.when(some, F.regexp_count(text, F.lit("\n")) + 1).otherwise(0).alias("lines"))


def task_project(task_id: Column) -> Column:
    return F.substring_index(F.coalesce(task_id, F.lit("")), "/", 1)


def path_project(parts: Column) -> Column:
    """The first of a path's parts, with the second behind it if that looks like a repository's name; null without parts."""
    second = F.get(parts, F.lit(1))
    return F.when(F.size(parts) > 0, F.when(second.rlike(r"[/\-_]"), F.concat_ws("/", parts[0], second)).otherwise(parts[0]))


def canonical_project(task: Column, path: Column) -> Column:
    """The path's project if the task's name is a spelling of it, else the task's; the path's, or `unknown`, if the task has none."""
    task = strip(F.coalesce(task, F.lit("")))
    path = F.nullif(path, F.lit(""))
    single, double = F.replace(task, F.lit("_"), F.lit("/")), F.replace(F.replace(task, F.lit("__"), F.lit("/")), F.lit("_"), F.lit("/"))
    return F.when(task == "", F.coalesce(path, F.lit("unknown"))).when((single == path) | (double == path), path).otherwise(task)


def render_context(snippets: Column) -> Column:
    """A Java comment block of ranked snippets (file, start, end, text); line numbers are shown from 1. Empty without snippets."""
    parts = F.transform(
        snippets,
        lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] path: "), s["file"], F.lit(" (lines "), (s["start"] + 1).cast("string"), F.lit("-"), (s["end"] + 1).cast("string"), F.lit(")\n"), F.rtrim(s["text"], F.lit("\n")), F.lit("\n\n")),
    )
    return F.when(F.size(snippets) == 0, "").otherwise(F.concat(F.lit("/* RAG_CONTEXT\n"), F.array_join(parts, ""), F.lit("END_RAG_CONTEXT */\n")))


def suffix_score(path: Column, wanted: Column) -> Column:
    """(−common last parts, depth, path): the order in which paths fit a wanted path, best first."""
    a, b = F.reverse(F.split(path, "/")), F.reverse(wanted)
    same = F.transform(F.arrays_zip(F.slice(a, 1, 64).alias("a"), F.slice(b, 1, 64).alias("b")), lambda z: F.coalesce(z["a"] == z["b"], F.lit(False)))
    common = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda acc, x: F.struct((acc["n"] + (acc["go"] & x).cast("int")).alias("n"), (acc["go"] & x).alias("go")))["n"]
    return F.struct((-common).alias("common"), F.size(a).alias("depth"), path.alias("path"))


def any_of(conditions: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a | b, conditions)
