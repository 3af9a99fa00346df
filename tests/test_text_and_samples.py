import re
import string

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators import samples


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")
    return [r.o for r in rows.select("i", expr(F.col("t")).alias("o")).orderBy("i").collect()]


def test_splitlines_and_blanks_follow_python(spark):
    values = ["a\r\nb\x0bc\x85d e\n", "", "\n\n", "x", "a\x1cb\x1db\x1e", "tail "]
    assert column(spark, values, tx.splitlines) == [v.splitlines(keepends=True) for v in values]
    assert column(spark, values, lambda c: tx.splitlines(c, False)) == [v.splitlines() for v in values]
    spaced = [" \t a b  c \x1c", " x ", "", " \n", "no"]
    assert column(spark, spaced, tx.strip) == [v.strip() for v in spaced]
    assert column(spark, spaced, tx.ws_norm) == [" ".join(v.split()) for v in spaced]
    assert column(spark, ["x\r\n", "x\n\n", "x"], tx.rstrip_newlines) == ["x", "x", "x"]


def test_decode_drops_bad_bytes(spark):
    assert column(spark, [b"a\xffb\r\nc\rd", "é".encode()], tx.decode_ignore, "binary") == ["ab\nc\nd", "é"]


def test_headers(spark):
    cases = {
        "package a;\n\nimport b;\n\nimport c;\n\nclass X {\n": 6, "import b;\nclass X {}": 1, "class X {}": 0, "// c\npackage a;\n": 0,
        "package a;\n\n\n": 3, "\nimport b;\n": 0, "package a;\nclass X": 1, "": 0, "import a;\n\n\nint x;\nimport b;\n": 3,
    }
    assert column(spark, list(cases), lambda c: tx.header_end(tx.splitlines(c))) == list(cases.values())


def test_target_lines(spark):
    values = ["  int x;", "});", "{}", "package a.b;", "import a.b;", "abc", "abcd", "   ", "returns"]
    assert column(spark, values, tx.good_target_line) == [True, False, False, False, False, False, True, False, True]


def test_tokens(spark):
    def plain(text, identifiers=False):
        out = []
        for run in re.split(r"[^A-Za-z0-9_.]+", text):
            for part in re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", run).split("_"):
                low = part.lower()
                if low and low not in tx.STOPWORDS and not (identifiers and not re.match(r"^[a-z_][a-z0-9_]*$", low)):
                    out.append(low)
        return out

    values = ["getUserName(user_id, foo.bar)", "public static int MAX_VALUE = 3;", "", "a the X1y2Z", "__init__ 9lives"]
    assert column(spark, values, tx.code_tokens) == [plain(v) for v in values]
    assert column(spark, values, lambda c: tx.code_tokens(c, identifiers_only=True)) == [plain(v, True) for v in values]


def test_snippets_queries_and_blocks(spark):
    text = string.ascii_letters
    assert column(spark, [text, "short"], lambda c: tx.truncate_snippet(c, 21)) == [text[:10] + "\n...\n" + text[-6:], "short"]
    with pytest.raises(ValueError):
        tx.truncate_snippet(F.lit("x"), 10)
    row = spark.range(1).select(
        tx.build_query(F.array(F.lit("a b\n"), F.lit("c\n")), F.array(F.lit("d1 = e;\n")), "hybrid", 1).alias("q"),
        tx.render_context(F.array(F.struct(F.lit("f").alias("file"), F.lit(0).alias("start"), F.lit(2).alias("end"), F.lit("x\n\n").alias("text")))).alias("b"),
    ).first()
    assert row.q == "c\n\nd1 = e;\n\nc d1 e"
    assert row.b == "/* RAG_CONTEXT\n[1] path: f (lines 1-3)\nx\n\nEND_RAG_CONTEXT */\n"


def test_fim_order(spark):
    p, s, m = tx.FIM_PREFIX, tx.FIM_SUFFIX, tx.FIM_MIDDLE
    values = [f"{p}a{s}b{m}", f"{s}{p}a{m}", f"{p}{m}{s}", f"x{p}{p}{s}{m}", ""]
    assert column(spark, values, tx.fim_in_order) == [True, False, False, True, False]
    assert column(spark, values, tx.has_all_fim) == [True, True, True, True, False]


def test_normal_forms_and_projects(spark):
    assert column(spark, ["a\r\nb", "a\rb", "a"], tx.first_line) == ["a\r", "a", "a"]
    assert column(spark, [" a  b \r\n"], lambda c: tx.normalize_for_mode(c, "exact")) == [" a  b "]
    assert column(spark, [" a  b \r\n"], lambda c: tx.normalize_for_mode(c, "ws_norm")) == ["a b"]
    rows = spark.createDataFrame([("a_b-c/1", ["a", "b-c", "x"]), ("a__b_c/1", ["a", "b_c", "x"]), ("zz/1", ["a", "b-c", "x"]), (None, ["a", "b-c", "x"]), (None, None), ("t/1", ["a", "b", "x"]), ("", ["a", "b"]), (" a_b_c ", ["a/b", "c"]), ("a_b", ["a/b"])], "t string, p array<string>")
    got = [r[0] for r in rows.select(tx.canonical_project(tx.task_project(F.col("t")), tx.path_project(F.col("p")))).collect()]
    assert got == ["a/b-c", "a__b_c", "zz", "a/b-c", "unknown", "t", "a", "a_b_c", "a/b"]
    sizes = column(spark, ["", None, "a\nb", "x\n"], tx.text_size)
    assert [(s.chars, s.lines) for s in sizes] == [(0, 0), (0, 0), (3, 2), (2, 2)]


def test_windows_equal_the_loop(spark):
    def loop(n, size, overlap):
        out, start, step = [], 0, max(1, size - overlap)
        while n:
            out.append(start)
            if start + size >= n:
                return out
            start += step
        return out

    for size, overlap in ((30, 10), (5, 4), (3, 9), (4, 0)):
        got = column(spark, list(range(0, 70)), lambda c: samples.line_windows(c, size, overlap), "int")
        assert got == [loop(n, size, overlap) for n in range(0, 70)]


def test_samples_masks_and_chunks(spark):
    text = "package a;\nimport b;\n\n" + "".join(f"line number {i};\n" for i in range(20))
    files = spark.createDataFrame([("A.java", text), ("B.java", ""), ("C.java", "only one line here")], "path string, text string")
    opts = samples.SampleOptions(prefix_lines=2, suffix_lines=1, per_file=50)
    got = {(r.file, r.line_index): r for r in samples.fim_samples(files, opts).collect()}
    assert set(got) == {("A.java", i) for i in range(3, 23)} | {("C.java", 0)}
    r = got["A.java", 10]
    assert r.prompt == "<|fim_prefix|>package a;\nimport b;\n\nline number 5;\nline number 6;\n<|fim_suffix|>line number 8;\n<|fim_middle|>" and r.completion == "line number 7;"
    mask = spark.createDataFrame([("A.java", 3)], "file string, line_index int")
    own = spark.createDataFrame([("A.java", "line number 1;"), ("C.java", "line number 2;")], "file string, fp string")
    every = spark.createDataFrame([("line number 5;",)], "fp string")
    referenced = spark.createDataFrame([("A.java",)], "file string")
    told = samples.exclusion_reason(samples.candidates(files), mask, own, every)
    assert {(x.line_index, x.reason) for x in told.filter("reason is not null").collect()} == {(3, "bench_line"), (4, "bench_text_file"), (8, "bench_text_global")}
    less = samples.masked_samples(files, (mask, own, every), samples.SampleOptions(per_file=20), referenced)
    assert less.filter("file = 'A.java'").count() == 5 and less.filter("line_index in (3, 4, 8) and file = 'A.java'").count() == 0
    chunks = samples.brace_chunks(spark.createDataFrame([("A", "class A {\n void f() {\n }\n void g() {\n x\n }\n}\n")], "path string, text string"), 30, 10).orderBy("start").collect()
    assert [(c.start, c.end) for c in chunks] == [(0, 2), (3, 5), (6, 6)]


def test_splits_and_quota(spark):
    df = spark.createDataFrame([(f"f{i % 10}", i, "ab"[i % 2]) for i in range(200)], "file string, i int, kind string")
    split = samples.group_split(df, "file", 0.25)
    assert split.select("file", "split").distinct().filter("split = 'val'").count() == 2 and split.count() == 200
    quota = samples.stratified_quota(df, "kind", ["a", "b"], 31, ["file", "i"])
    assert {r.kind: r["count"] for r in quota.groupBy("kind").count().collect()} == {"a": 16, "b": 15}
    with pytest.raises(RuntimeError):
        samples.stratified_quota(df, "kind", ["a", "c"], 10, ["i"])
    share = samples.bernoulli_split(df, ["i"], 0.3).filter("split = 'val'").count()
    assert 30 < share < 95
