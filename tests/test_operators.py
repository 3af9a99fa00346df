import gzip
import io
import json
import random
import urllib.error
from difflib import SequenceMatcher

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.functions.text import code_tokens, code_tokens_arrow
from millrace.operators import bm25, codefix, convert, matching, modelfilter, samples, tensors
from millrace.plans import queries
from millrace.sources import readers, sinks
from millrace.storage import materialize
from millrace.streaming import events


def test_code_tree(spark, tmp_path):
    for path, data in {"build/x/src/A.java": b"a\r\nb\xff\n", "build/x/target/B.java": b"no", "build/x/.git/C.java": b"no", "build/x/D.txt": b"no", "build/x/y/build/x/E.java": "z\ufffd".encode()}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(data)
    files = readers.code_files(spark, str(tmp_path / "build/x"))
    assert [(r.path, r.text) for r in files.collect()] == [("src/A.java", "a\nb\n")]  # the other's folder is skipped
    assert readers.code_files(spark, str(tmp_path / "build/x/y/build"), "E.*").first().text == "z\ufffd"
    assert [(r.line_index, r.line) for r in readers.line_table(files).collect()] == [(0, "a\n"), (1, "b\n")]


def test_json_lines(spark, tmp_path):
    lines = ['{"prompt": "a", "metadata": {"task_id": "t", "ground_truth": "g", "fpath_tuple": ["r", "A.java"], "line_no": 3}}', "", "not json", "[1]", '{"prompt": 5, "metadata": {"ground_truth": "h", "fpath_tuple": "B.java", "line_no": "+-5"}}', '{"metadata": {"ground_truth": null, "fpath_tuple": ["x"]}}', '{"metadata": {"ground_truth": "k", "fpath_tuple": ["x"], "line_no": 3.5}}']
    path = tmp_path / "b.jsonl.gz"
    with gzip.open(path, "wt") as f:
        f.write("\n".join(lines))
    ok = readers.jsonl_lenient(spark, str(path))
    assert ok.count() == 4
    assert [r[0] for r in ok.select(readers.json_type("prompt")).collect()][:2] == ["STRING", "BIGINT"]
    got = {r.ground_truth: r for r in readers.benchmark_records(spark, str(path)).collect()}
    assert set(got) == {"g", "h", "k"} and got["g"].line_no == 3 and got["g"].task_id == "t" and got["g"].fpath_tuple == ["r", "A.java"]
    assert got["h"].line_no is None and got["h"].fpath_tuple == ["B.java"] and got["h"].task_id.startswith("b.jsonl.gz:") and got["k"].line_no is None
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception):
        readers.jsonl_strict(spark, str(tmp_path / "bad.jsonl"), "a int").collect()
    assert [p.rsplit("/", 1)[1] for p in readers.find_files(spark, [str(tmp_path)])] == ["bad.jsonl"]
    assert readers.gather(spark, [f"{tmp_path}/bad.jsonl", "/z/q.jsonl"], str(tmp_path)) == [f"{tmp_path}/bad.jsonl", "/z/q.jsonl"]


def test_splits_and_policies(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"a": 1}\n')
    (tmp_path / "v.json").write_text('{"a": 2, "b": "x"}\n')
    got = {(r.a, r.b, r.split) for r in readers.load_splits(spark, {"train": str(tmp_path / "t.json"), "validation": str(tmp_path / "v.json")}).collect()}
    assert got == {(1, None, "train"), (2, "x", "validation")}
    df = spark.range(100).withColumnRenamed("id", "k")
    assert [r.k for r in readers.load_policy(df, "k", n=3).collect()] == [0, 1, 2]
    drawn = [r.k for r in readers.load_policy(df, "k", True, 10, 1).collect()]
    assert len(set(drawn)) == 10 and drawn != sorted(drawn) and readers.load_policy(df, "k", True).count() == 100 and readers.limited(df, "k", 0).count() == 100


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", True, None), (2, "b", False, "x")], "i int, t string, passed boolean, n string")
    sinks.write_routed(df, str(tmp_path / "kept"), str(tmp_path / "rejected"))
    kept = [x for p in (tmp_path / "kept").glob("*.json") for x in p.read_text(encoding="utf-8").splitlines()]
    assert [json.loads(x) for x in kept] == [{"i": 1, "t": "é", "passed": True, "n": None}] and "é" in kept[0]
    sinks.write_jsonl(df, str(tmp_path / "z"), gzip=True)
    assert spark.read.json(str(tmp_path / "z")).count() == 2 and list((tmp_path / "z").glob("*.gz"))
    sinks.write_splits(df.withColumn("split", F.lit("val")), str(tmp_path / "s"))
    assert (tmp_path / "s/split=val").exists()
    sinks.write_report(spark, {"a": 1}, str(tmp_path / "r"))
    assert sinks.manifest_path("a/x.jsonl.gz") == "a/x.run_manifest.json" == sinks.manifest_path("a/x.jsonl")
    manifest = sinks.run_manifest({"a": 1}, {"kept": 2}, sinks.now_utc(), "m", "e", ["x"])
    assert manifest["kept"] == 2 and manifest["python_version"]
    assert sinks.text_report("T", [("a", 1.25), ("bb", float("nan")), ("c", 3)]) == "T\n  a  1.2\n  c  3"


def test_calls():
    assert codefix.parse_call("foo(bar(a,b), map.get(k));")["args"] == ["bar(a,b)", "map.get(k)"]
    assert codefix.parse_call("  x.y.<T>run(a, \"(,\", '(');  \n")["args"] == ["a", '"(,"', "'('"]
    assert codefix.parse_call("f();")["args"] == [] and codefix.parse_call("void f(int a);")["args"] == ["int a"]
    for bad in ("// f(a);", "/* f(a); */", "* f(a);", "f(a)", "if (a) { b; }", "int x;", "f(a,);", "f('a);", "if (x);", "", None, "f(a]);"):
        assert codefix.parse_call(bad) is None, bad
    assert codefix.parse_call("if (ok) run(a, b);")["args"] == ["a", "b"]
    assert codefix.split_args("Map<A,B> x, new int[]{1,2}") == ["Map<A", "B> x", "new int[]{1,2}"]
    assert codefix.parenthesis_pairs("(a(b)')')(") == [(2, 4), (0, 8)]


def test_mutations_keep_their_promise():
    call = codefix.parse_call("svc.call(a, b, c);")
    for seed in range(30):
        swap, less, more = (codefix.parse_call(codefix.mutate(call, m, codefix.row_random(seed, "F.java", 7, m)))["args"] for m in codefix.MUTATIONS)
        assert sorted(swap) == ["a", "b", "c"] and swap != call["args"] and len(less) == 2 and len(more) == 4 and set(more) == {"a", "b", "c"}
    same = codefix.parse_call("f(a, a);")
    assert codefix.mutate(same, "swap_args", random.Random(1)) is None and codefix.mutate(codefix.parse_call("f();"), "extra_arg", random.Random(1)) is None


def test_subset_sums():
    rng = random.Random(6)
    for _ in range(50):
        counts = {f"f{i}": rng.randrange(1, 30) for i in range(12)}
        target = rng.randrange(0, 150)
        got = codefix.subset_with_sum(counts, target)
        sums = {0}
        for n in counts.values():
            sums |= {s + n for s in sums}
        assert (got is not None) == (target in sums) and (got is None or sum(counts[k] for k in got) == target)


def test_exact_split_of_5000(spark):
    pool = spark.range(50 * 120).select(F.concat(F.lit("F"), (F.col("id") % 50).cast("string"), F.lit(".java")).alias("file"), (F.col("id") / 50).cast("int").alias("line_index"), F.explode(F.array(*map(F.lit, codefix.MUTATIONS))).alias("mutation_type"))
    got = codefix.exact_split(pool, 5000, 100, attempts=200).cache()
    assert {r.split: r["count"] for r in got.groupBy("split").count().collect()} == {"train": 4900, "val": 100}
    assert got.groupBy("file").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    assert [(r.total, r.train + r.val) for r in codefix.mutation_counts(got).orderBy(F.desc("total")).collect()] == [(1667, 1667), (1667, 1667), (1666, 1666)]
    with pytest.raises(RuntimeError):
        codefix.exact_split(pool.limit(2), 6, 2)


def test_similar_statements_leave_out_their_own(spark):
    corpus = spark.createDataFrame([("A", 1, "svc.call(a, b);"), ("A", 3, "svc.call(x, y);"), ("B", 9, "svc.call(c, d);"), ("C", 4, "other(z);")], "file string, line_index int, text string")
    chosen = spark.createDataFrame([("A::1::swap_args", "A", 1, "svc.call(a, b);", "svc.call(b, a);", "swap_args", ["p"])], "id string, file string, line_index int, original_line string, broken_line string, mutation_type string, compiler_problems array<string>")
    got = codefix.augmentations(chosen, corpus, codefix.CodefixOptions(k=3, same_file_window=5)).first()
    assert got.augmentations == ["svc.call(c, d);", "other(z);"]
    record = codefix.records(chosen.join(codefix.augmentations(chosen, corpus), "id")).first()
    assert record.completion == "```java\nsvc.call(a, b);\n```" and record.messages[1].content.startswith("With these similar correct statements:\n1. ") and record.prompt.endswith("<|im_start|>assistant\n")
    assert "Fix this problems:\n1. p\n" in record.prompt


def test_scores_against_a_loop(spark):
    import math
    from collections import Counter

    texts = {1: "alpha beta beta gamma", 2: "beta delta", 3: "", 4: "alpha alpha zeta"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id int, text string").withColumn("tokens", code_tokens(F.col("text")))
    asked = spark.createDataFrame([(9, "beta alpha beta none")], "query_id int, text string").withColumn("tokens", code_tokens(F.col("text")))
    got = {r.doc: r.score for r in bm25.scores(asked, docs).collect()}
    bags = {k: Counter(v.split()) for k, v in texts.items()}
    avg = sum(b.total() for b in bags.values()) / 4
    for k, b in bags.items():
        want = 0.0
        for t, qf in {"beta": 2, "alpha": 1}.items():
            df = sum(t in x for x in bags.values())
            if b[t]:
                want += math.log(1 + (4 - df + 0.5) / (df + 0.5)) * b[t] * 2.5 / (b[t] + 1.5 * (0.25 + 0.75 * b.total() / avg)) * qf
        assert abs(got.get(k, 0.0) - want) < 1e-10
    assert {(r.token, r.doc): r.tf for r in bm25.postings(docs).collect()} == {(r.token, r.doc): r.tf for r in bm25.counted_postings(docs).collect()}


def test_best_are_the_first_of_all_scores(spark, monkeypatch):
    rng = random.Random(3)

    def bag(size):
        return [rng.choice("abcdefgh") if rng.random() < 0.7 else f"r{rng.randrange(60)}" for _ in range(rng.randrange(size))]

    rows = [((i % 7, i), bag(6)) for i in range(300)] + [((i % 7, i), ["a", "b", "c"]) for i in range(300, 350)]
    docs = materialize(spark.createDataFrame(rows, "doc_id struct<f: long, i: long>, tokens array<string>"), "best-docs")
    asked = spark.createDataFrame([(i, bag(9)) for i in range(50)], "query_id long, tokens array<string>")
    twice = docs.unionByName(docs.filter("doc_id.i < 30")).unionByName(spark.createDataFrame([((1, 8), ["a", "b", "x"])], docs.schema))
    monkeypatch.setattr(bm25, "COMMON", 30)
    monkeypatch.setattr(bm25, "COMMON_SHARE", 10**6)

    def told(found):
        return sorted((r["query"], r["rank"], tuple(r["doc"]), r["score"], r["first"]) for r in found.collect())

    want = told(bm25.top_k(bm25.scores(asked, docs), 20))
    assert told(bm25.best(asked, docs, 20)) == want == told(bm25.best_by_profile(asked, docs, 20)) and len(want) > 800
    assert told(bm25.best(asked, docs, 3, 6)) == told(bm25.top_k(bm25.scores(asked, docs), 3, 6))
    assert told(bm25.best(asked, twice, 20)) == told(bm25.top_k(bm25.scores(asked, twice), 20)) == told(bm25.best_by_profile(asked, twice, 20))


def test_best_over_many_blocks_shuffles_no_document(spark, monkeypatch):
    rng = random.Random(5)
    words = ["Alpha", "betaGamma", "x_y", "delta.", "the", "\u00e9t\u00e9", "a\x01b", "IOError", "zz9Top"] + [f"w{i}" for i in range(80)]

    def text(size):
        return " ".join(rng.choice(words[: rng.choice((9, 89))]) for _ in range(rng.randrange(size)))

    docs = materialize(spark.createDataFrame([(i, text(30)) for i in range(400)] + [(i, "Alpha betaGamma w1") for i in range(400, 460)], "doc_id long, text string").repartition(3), "block-docs")
    asked = spark.createDataFrame([(i, text(40)) for i in range(60)], "query_id long, text string").select("query_id", code_tokens(F.col("text")).alias("tokens"))
    told = docs.withColumn("tokens", code_tokens(F.col("text")))
    plans = []
    monkeypatch.setattr(bm25, "materialize", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or materialize(df, name))
    for name, value in {"DOC_BLOCK": 50, "QUERY_BLOCK": 25, "DENSE": 4, "OUTER": 20, "PAIRS": 100}.items():
        monkeypatch.setattr(bm25, name, value)
    got = [sorted(map(tuple, found.select("query", "doc", "score", "first", "rank").collect())) for found in (bm25.best(asked, docs, 7, tokens_col=None), bm25.best(asked, told, 7), bm25.top_k(bm25.scores(asked, told), 7))]
    assert got[0] == got[1] == got[2] and len(got[0]) > 300
    searches = [plan for name, plan in plans if name == "bm25-best"]
    assert len(searches) >= 6 and not any("Exchange" in x for x in searches)


def test_tokens_and_chunks_in_python_are_those_of_the_columns(spark):
    texts = ["", None, "getHTTPName_x.y return\x01Null a1B", "\u00c9tat \u0130x the\tFOO__bar\x0bq\x85r\u2028s", "a\r\nb\rc\n" * 25, "\n" * 50, "x\n" * 30, "x\n" * 31]
    df = spark.createDataFrame(list(enumerate(texts)), "path int, text string")
    want = [r.t for r in df.select(code_tokens(F.col("text")).alias("t"), "path").orderBy("path").collect()]
    assert code_tokens_arrow(pa.array(texts)).to_pylist() == want
    for size, overlap in ((30, 10), (7, 0), (3, 5), (0, 2)):
        cut = [sorted(map(tuple, x.select("file", "start", "end", "text").collect())) for x in (samples.text_chunks(df, size, overlap), samples.line_chunks(df, size, overlap))]
        assert cut[0] == cut[1] and cut[0]


def test_searches_make_no_row_for_each_pair(spark):
    n = 2000  # every query shares a token with every document: 50 * 2000 pairs
    docs = materialize(spark.range(n).select(F.col("id").alias("doc_id"), F.array(F.lit("call"), F.col("id").cast("string")).alias("tokens")), "pair-docs")
    asked = spark.range(50).select(F.col("id").alias("query_id"), F.array(F.lit("call"), (F.col("id") + 7).cast("string")).alias("tokens"))
    for search in (bm25.best, bm25.best_by_profile):
        found = search(asked, docs, 2)
        assert [(r["query"], r["doc"]) for r in found.filter("rank = 1").orderBy("query").collect()] == [(i, i + 7) for i in range(50)]
        assert {r["doc"] for r in found.filter("rank = 2").collect()} == {0}
        sizes = [spark.read.parquet(f).count() for f in {x.rsplit("/", 1)[0] for x in found.inputFiles()}]
        assert max(sizes) < 50 * n / 10


def test_retrieval_filters_and_budget(spark):
    rows = [(i, f"F{i}", i * 10, i * 10 + 1, [f"word common {i}\n", "x\n"], f"word common {i}\nx\n") for i in range(8)]
    chunks = spark.createDataFrame(rows, "chunk_id int, file string, start int, end int, lines array<string>, text string").withColumn("tokens", code_tokens(F.col("text")))
    asked = spark.createDataFrame([(1, "F0", 5, "word common 1", ["common", "word"])], "query_id int, file string, line_index int, completion string, tokens array<string>")
    masks = {"line_mask": spark.createDataFrame([("F2", 20), ("F3", 5)], "file string, line_index int"), "file_prints": spark.createDataFrame([("F2", "nothing"), ("F3", "word common 3"), ("F4", "word common 5")], "file string, fp string"), "global_prints": spark.createDataFrame([("nowhere",)], "fp string")}
    contexts, excluded = bm25.retrieve(asked, chunks, bm25.RetrieveOptions(k=3, max_chars=40, max_snippet_chars=20), masks)
    assert {r.reason: r.n for r in excluded.collect()} == {"proximity": 1, "completion_text": 1, "bench_line": 1, "bench_text": 1}
    assert [x.file for x in contexts.first().rag] == ["F4", "F5"]


def test_cascade_order_and_ambiguity(spark):
    lines = spark.createDataFrame([(f, i, x) for f, text in {"a/A.java": "x\ny\nx\nz\n", "b/A.java": "q\nw\n", "c/C.java": "let value = compute(first, second);\nother\n"}.items() for i, x in enumerate(text.splitlines(keepends=True))], "file string, line_index int, line string")
    records = spark.createDataFrame(
        [("exact", "", "y", ["r", "a", "A.java"], 1), ("near", "", "y\n", ["r", "a", "A.java"], 3), ("twice", "", "x", ["a", "A.java"], None), ("later", "", "w", ["zz", "A.java"], None), ("none", "", "nope", ["a", "A.java"], 1), ("file", "", "y", ["Q.java"], 0), ("prompt", "w\ny", "x", ["a", "A.java"], None), ("fuzzy", "", "let value = compute(first, second)", ["c", "C.java"], None)],
        "task_id string, prompt string, ground_truth string, fpath_tuple array<string>, line_no int",
    )
    got = {r.task_id: (r.status, r.line_index, r.strategy, r.confidence, r.reason) for r in matching.match_records(records, lines, matching.MatchOptions(window=2, fuzzy=True)).collect()}
    assert got["exact"] == ("matched", 1, "line_no_exact_0based", 100, None) and got["near"] == ("matched", 1, "window_search", 95, None)
    assert got["twice"][0] == "unmatched_ambiguous" and got["twice"][3:] == (30, "ambiguous_fuzzy") and got["later"] == ("matched", 1, "global_exact", 90, None)
    assert got["none"][:2] == ("unmatched_line", None) and got["file"] == ("unmatched_file", None, None, 0, "no_candidate_file") and got["fuzzy"][:4] == ("matched", 0, "fuzzy", 60)
    masks = matching.benchmark_masks(records, matching.match_records(records, lines), lines)
    assert ("a/A.java", 1) in {(r.file, r.line_index) for r in masks["line_mask"].collect()} and masks["global_prints"].filter("fp = 'nope'").count() == 1
    assert {r.file for r in masks["referenced"].collect()} >= {"a/A.java", "b/A.java"}


def test_items_of_one_task_are_matched_each_by_itself(spark):
    lines = spark.createDataFrame([("A.java", i, x) for i, x in enumerate(["one\n", "two\n", "three\n"])], "file string, line_index int, line string")
    records = spark.createDataFrame([("t", "", "one", ["A.java"], None), ("t", "", "three", ["A.java"], None), ("t", "", "three", ["A.java"], None)], "task_id string, prompt string, ground_truth string, fpath_tuple array<string>, line_no int")
    got = matching.match_records(records, lines)
    assert sorted((r.task_id, r.line_index) for r in got.collect()) == [("t", 0), ("t", 2), ("t", 2)]
    masks = matching.benchmark_masks(records, got, lines)
    assert sorted(r.line_index for r in masks["line_mask"].collect()) == [0, 2] and {r.fp for r in masks["file_prints"].collect()} == {"one", "three"}


def test_matching_broadcasts_no_table_that_repeated_texts_make_small(spark):
    n = 3000
    lines = materialize(spark.range(n).select(F.concat(F.lit("F"), "id", F.lit(".java")).alias("file"), F.posexplode(F.split(F.lit("same\nother\nsame"), "\n")).alias("line_index", "line")), "lines")
    records = materialize(spark.range(n).select(F.col("id").cast("string").alias("task_id"), F.lit("other").alias("prompt"), F.lit("same").alias("ground_truth"), F.array(F.concat(F.lit("F"), "id", F.lit(".java"))).alias("fpath_tuple"), F.lit(None).cast("int").alias("line_no")), "records")
    got = matching.match_records(records, lines)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and plan.count("FileScan") < 20
    assert got.groupBy("status", "line_index").count().collect() == [("unmatched_ambiguous", None, n)]


def test_prompt_tails_follow_splitlines(spark):
    lines = spark.createDataFrame([("A.java", i, f"{x}\n") for i, x in enumerate(["a", "b", "x", "c", "d", "e", "f", "g", "h", "i", "j", "k", "l", "m", "n", "x", "o"])], "file string, line_index int, line string")
    for prompt, want in (("l\r\nm\r\nn", 15), ("a\nb\n", 2), ("\n\n", None)):
        records = spark.createDataFrame([("t", prompt, "x", ["A.java"], None)], "task_id string, prompt string, ground_truth string, fpath_tuple array<string>, line_no int")
        assert matching.match_records(records, lines).first().line_index == want


def test_line_numbers_of_a_file_in_pieces(spark, tmp_path):
    (tmp_path / "big.jsonl").write_text("".join(json.dumps({"metadata": {"ground_truth": f"g{i}", "fpath_tuple": ["A.java"]}}) + "\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    got = readers.benchmark_records(spark, str(tmp_path / "big.jsonl")).collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(r.task_id for r in got) == sorted(f"big.jsonl:{i + 1}" for i in range(3000)) and all(r.task_id == f"big.jsonl:{int(r.ground_truth[1:]) + 1}" for r in got)


def test_early_stop_ends_at_the_last_kept_row(spark):
    rows = spark.createDataFrame([(i, i % 3 == 0) for i in range(20)], "pos int, passed boolean")
    assert [r.pos for r in modelfilter.until_kept(rows, "pos", 3).orderBy("pos").collect()] == list(range(7))
    assert modelfilter.until_kept(rows, "pos", 99).count() == modelfilter.until_kept(rows, "pos", None).count() == 20


def test_match_modes(spark):
    def equal(gt, answer, mode, threshold=0.9, one_line=True):
        df = spark.createDataFrame([(gt, answer)], "gt_raw string, teacher_raw string")
        return modelfilter.compare(df, mode, threshold, one_line=one_line).first()

    assert equal("int x = 1;\r\n", "int x = 1;\n", "exact").equal and equal("  a b", "a b  ", "trimmed").equal and equal("a   b", " a b", "ws_norm").equal
    fuzzy = equal("return value;", "return values;", "fuzzy")
    assert fuzzy.equal and fuzzy.similarity == SequenceMatcher(None, "return value;", "return values;").ratio()
    assert equal("a", "a\nextra", "exact").equal and not equal("a", "a\nextra", "exact", one_line=False).equal and not equal("a", None, "ws_norm").equal


def test_filter_run_with_canned_client(spark):
    samples = spark.createDataFrame([("p1", "int a;", 1), ("p2", "int b;", 2), ("p3", "int c;", 3), (None, "x", 4), ("p5", "int e;", 5)], "prompt string, completion string, pos int")

    def ask(prompt):
        if prompt == "p5":
            raise TimeoutError("slow")
        return {"p1": "int a;\nmore", "p2": " int b; ", "p3": "int z;"}[prompt]

    opts = modelfilter.FilterOptions(match_mode="trimmed", retries=0, model="m", endpoint="e")
    got = modelfilter.evaluate(modelfilter.ask_model(samples, ask, opts), opts).cache()
    assert {r.pos: r.reason for r in got.collect()} == {1: "passed", 2: "passed", 3: "mismatch", 4: "error:bad_input", 5: "error:timeout"}
    stats = modelfilter.run_stats(got).first()
    assert (stats.processed, stats.kept, stats.rejected, stats.errors, stats.keep_rate) == (5, 2, 3, 2, 0.4)
    assert [r.pos for r in modelfilter.first_kept(got, "pos", 1).collect()] == [1]
    meta = got.filter("pos = 1").first().teacher_filter
    assert meta.gt_norm == "int a;" and meta.passed and meta.params.stop == ["\n"] and meta.error is None
    assert modelfilter.run_stats(got.limit(0)).first().keep_rate == 0.0


def test_client_parts():
    assert modelfilter.completions_url("http://h/v1/") == "http://h/v1/completions" == modelfilter.completions_url("http://h")
    assert modelfilter.parse_completion('{"choices":[{"message":{"content":[{"text":"a"},{"x":1},{"text":"b"}]}}]}') == "ab"
    assert modelfilter.parse_completion('{"choices":[{"message":{"content":["a",{"text":5},{"text":"b"}]}}]}') == "b"
    for body, reason in (("{", "bad_response_json"), ('{"choices":[]}', "bad_response_schema"), ("[]", "bad_response_schema"), ('{"choices":[{"text":5}]}', "bad_response_schema"), ('{"choices":[{"message":{"content":[{"x":1}]}}]}', "bad_response_schema")):
        with pytest.raises(modelfilter.RequestFailed) as e:
            modelfilter.parse_completion(body)
        assert e.value.reason == reason and not e.value.transient
    error = lambda code: urllib.error.HTTPError("u", code, "m", None, None)
    assert modelfilter.classify_error(error(503))[:2] == ("http_503", True) and modelfilter.classify_error(error(400))[:2] == ("http_400", False)
    assert modelfilter.classify_error(ConnectionResetError())[:2] == ("connection_reset", True) and modelfilter.classify_error(urllib.error.URLError("x"))[:2] == ("network_error", True)
    assert modelfilter.classify_error(ValueError("x")) == ("bad_response_schema", False, "x") and modelfilter.classify_error(KeyError())[:2] == ("request_error", False)
    with pytest.raises(ValueError) as e:
        json.loads("{")
    assert modelfilter.classify_error(e.value)[:2] == ("bad_response_json", False)
    for inner, want in ((ConnectionResetError(), "connection_reset"), (TimeoutError(), "timeout"), ("The read timed out", "timeout"), (OSError("no route"), "network_error")):
        assert modelfilter.classify_error(urllib.error.URLError(inner))[:2] == (want, True)
    body = urllib.error.HTTPError("u", 500, "m", None, io.BytesIO(b" broken " + b"x" * 400))
    assert modelfilter.classify_error(body) == ("http_500", False, ("broken " + "x" * 400)[:300])
    tries, pauses = [], []

    def flaky(prompt):
        tries.append(prompt)
        if len(tries) < 3:
            raise error(429)
        return "ok"

    assert modelfilter.ask_with_retries(flaky, "p", modelfilter.FilterOptions(retries=3), pauses.append)[0] == "ok" and len(pauses) == 2 and pauses[1] > pauses[0]


def test_strip_and_trim(spark):
    s, p, f, m = "<|file_sep|>", "<|fim_prefix|>", "<|fim_suffix|>", "<|fim_middle|>"

    def strip(prompt, **k):
        return spark.createDataFrame([(prompt,)], "p string").select(convert.strip_blocks(F.col("p"), **k).alias("s")).first().s

    def plain(prompt, prefix_only=False, most=128):
        n = 0
        while n < most and (a := prompt.find(s)) >= 0 and (b := prompt.find(s, a + len(s))) >= 0:
            rest = prompt[:a] + prompt[b + len(s) :]
            if (prefix_only and -1 < prompt.find(p) <= a) or not all(x in rest for x in (p, f, m)):
                break
            prompt, n = rest, n + 1
        return prompt, n

    for prompt in (f"{s}a{s}b{s}c{s}{p}x{f}y{m}", f"{s}a{s}{p}x{f}y{s}z{s}{m}", f"{s}{p}{s}x{f}{m}", f"{p}{f}{m}{s}", f"{s}a{s}{p}{f}", "none", f"{s}a{s}{s}b{s}{p}{f}{m}{s}odd"):
        for only in (False, True):
            assert tuple(strip(prompt, prefix_only=only))[:2] == plain(prompt, only), (prompt, only)
    assert strip(f"{s}a{s}{s}b{s}{p}{f}{m}", max_iters=1).hit_max
    assert strip(f"{s}a{s}{p}{f}{m}{s}odd").unmatched == 1 and strip(f"{s}{p}{s}x{f}{m}{s}odd").unmatched == 0 and strip(f"{s}a{s}{p}{f}{m}{s}odd", max_iters=1).unmatched == 0
    rng = random.Random(2)
    prompts = ["".join(rng.choice([s, s, "t ", p, f, m, "<|fim_", "prefix|>"]) for _ in range(rng.randrange(2, 16))) for _ in range(300)]
    for only in (False, True):
        got = spark.createDataFrame([(x,) for x in prompts], "p string").select("p", convert.strip_blocks(F.col("p"), only, 3).alias("s")).collect()
        assert all(tuple(r.s)[:2] == plain(r.p, only, 3) for r in got)

    def trim(prompt, budget):
        return spark.createDataFrame([(prompt,)], "p string").select(convert.left_trim(F.col("p"), F.lit(budget)).alias("s")).first().s

    assert trim(f"a b c{p}x{f}y{m}", 8) == (f"b c{p}x{f}y{m}", 2, None)
    assert trim(f"a{p}x{f}y{m}", 4)[1:] == (0, "budget_too_small_for_fim") and trim("a b c", 2)[1:] == (0, "fim_tokens_lost_after_truncation")


def test_conversion_maps(spark):
    d = spark.createDataFrame([(1, "train", None, "x"), (2, "train", "<|fim_prefix|>a<|fim_suffix|>b<|fim_middle|>", ""), (3, "val", "<|fim_prefix|>a<|fim_suffix|>b<|fim_middle|>", "ok")], "source_id int, split string, prompt string, completion string")
    got = convert.convert(d).cache()
    assert {(r.source_id, r.variant): r.drop_reason for r in got.collect()} == {(1, "norag"): "missing_required_fields", (1, "rag"): "missing_required_fields", (2, "norag"): "min_completion_tokens", (2, "rag"): "min_completion_tokens", (3, "norag"): None, (3, "rag"): None}
    maps = {r.split: r for r in convert.drop_maps(got).collect()}
    assert maps["train"].drop_reasons == {"missing_required_fields": 2, "min_completion_tokens": 2} == maps[None].drop_reasons
    assert maps[None].drop_reasons_by_variant["rag"] == {"missing_required_fields": 1, "min_completion_tokens": 1}
    assert all(r.variant_id == f"3::{r.variant}" for r in got.filter("source_id = 3").collect())


def test_tensors(spark):
    d = spark.createDataFrame([([1, 2, 3], [7, 8]), ([1], []), ([], [5, 6, 7, 8])], "prompt_ids array<int>, completion_ids array<int>")
    got = [(r.input_ids, r.labels) for r in tensors.label_rows(d, 4, 0).collect()]
    assert got == [([3, 7, 8, 0], [-100, 7, 8, 0]), ([5, 6, 7, 0], [5, 6, 7, 0])] and tensors.truncatable(d).count() == 2
    assert tensors.training_steps(10, 2, 2, 0.5, 0.1) == {"steps_per_epoch": 3, "total_steps": 1, "warmup_steps": 0}


def test_first_lines_of_truth_and_answer_are_compared(spark):
    df = spark.createDataFrame([(0, "p", "a  b\r\nc", "a b\nd", None, 1), (1, "p", "a\nb\nc", "a\nb\nc", None, 1), (2, "p", "x\na", "a", None, 1), (3, "p", "a\rb", "a", None, 1)], "pos int, prompt string, completion string, teacher_raw string, request_error string, latency_ms int")
    got = {r.pos: (r.reason, r.teacher_filter.gt_norm) for r in modelfilter.evaluate(df).collect()}
    assert got == {0: ("passed", "a b"), 1: ("passed", "a"), 2: ("mismatch", "x"), 3: ("passed", "a")}
    whole = modelfilter.evaluate(df, modelfilter.FilterOptions(first_line_only=False)).filter("passed").collect()
    assert [r.pos for r in whole] == [1]


def test_filter_queries_get_whole_turns(spark):
    sf = "/root/testdata/sf0.001"
    texts = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    got = {(r.conv_id, r.turn): r for r in queries._answers(spark, sf).collect()}
    assert got.keys() == texts.keys() and any("\n" in t for t in texts.values())
    for key, text in texts.items():
        assert got[key].completion == text
        assert got[key].teacher_raw == [text, f"  {text}  \nmore", text.replace(" ", "  "), f"no {text}"][key[0] % 4]


def test_streamed_filter(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("".join(json.dumps({"prompt": f"p{i}", "completion": f"c{i}"}) + "\n" for i in range(4)))
    stream = spark.readStream.schema("prompt string, completion string").json(str(tmp_path / "in"))
    q = events.filter_stream(stream, lambda p: "c1" if p == "p1" else "no", modelfilter.FilterOptions(retries=0), str(tmp_path / "k"), str(tmp_path / "r"), str(tmp_path / "c"))
    q.awaitTermination()
    assert spark.read.json(str(tmp_path / "k")).count() == 1 and spark.read.json(str(tmp_path / "r")).count() == 3
