import json
from pathlib import Path

import pytest

from millrace import storage
from millrace.__main__ import main, parser
from millrace.operators.bm25 import RetrieveOptions
from millrace.operators.codefix import CodefixOptions
from millrace.operators.convert import ConvertOptions
from millrace.operators.modelfilter import FilterOptions
from millrace.operators.samples import SampleOptions
from millrace.plans import pipelines
from millrace.sources import sinks


def tree(tmp_path):
    for i in range(6):
        body = "".join(f"    service.call(first{j}, second{i});\n    int value{i}_{j} = {j};\n" for j in range(8))
        (tmp_path / f"src/F{i}.java").parent.mkdir(exist_ok=True)
        (tmp_path / f"src/F{i}.java").write_text(f"package p;\nimport q;\n\nclass F{i} {{\n{body}}}\n")
    return str(tmp_path / "src")


def test_samples_without_leaks(spark, tmp_path):
    repo = tree(tmp_path)
    record = {"prompt": "", "metadata": {"task_id": "t", "ground_truth": "    int value1_3 = 3;", "fpath_tuple": ["r", "F1.java"], "line_no": 11}}
    (tmp_path / "b.jsonl").write_text(json.dumps(record))
    report = pipelines.fim_dataset(spark, repo, str(tmp_path / "out"), [str(tmp_path / "b.jsonl")], val_ratio=0.2, split_by_file=True, rag=True, opts=SampleOptions(per_file=9))
    assert report["leaked"] == 0 and report["items"][0]["status"] == "matched" and set(report["samples"]) == {"train", "val"}
    rows = spark.read.json(str(tmp_path / "out")).collect()
    assert all(r.completion != "    int value1_3 = 3;" for r in rows) and any(r.prompt.startswith("<|fim_prefix|>/* RAG_CONTEXT") for r in rows)
    assert {r.file: 0 for r in rows if r.split == "val"}.keys().isdisjoint({r.file for r in rows if r.split == "train"})


def test_contexts_show_no_benchmark_lines(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    body = "".join(f"    service.call(first{j}, second);\n" for j in range(9))
    (src / "A.java").write_text(f"class A {{\n{body}    int secret = answer(42);\n{body}}}\n")
    (src / "B.java").write_text("class B {\n" + body.replace("first", "third") + "    int other = 1;\n}\n")
    record = {"prompt": "", "metadata": {"task_id": "t", "ground_truth": "    int secret = answer(42);", "fpath_tuple": ["r", "A.java"], "line_no": 10}}
    (tmp_path / "b.jsonl").write_text(json.dumps(record))
    for masked in (True, False):
        report = pipelines.fim_dataset(spark, str(src), str(tmp_path / f"out{masked}"), [str(tmp_path / "b.jsonl")], rag=True, opts=SampleOptions(per_file=9), retrieval=RetrieveOptions(max_snippet_chars=2000, exclude_bench=masked), report_path=str(tmp_path / "report"))
        shown = [r.prompt for r in spark.read.json(str(tmp_path / f"out{masked}")).filter("file = 'B.java'").collect()]
        assert any("secret" in p for p in shown) != masked and ("bench_line" in report["rag_exclusions"]) == masked
        assert report["leaked"] == 0 and report["matched"] == 1 and report["excluded_line_hits"] == {"bench_line": 1} and report["referenced_files"] == ["A.java"] and report["bench_file_sample_counts"].keys() <= {"A.java"}
    assert json.loads("".join(r.value for r in spark.read.text(str(tmp_path / "report"), wholetext=True).collect()))["total_records"] == 1


def test_codefix_plan(spark, tmp_path):
    counts = pipelines.codefix_dataset(spark, tree(tmp_path), str(tmp_path / "out"), CodefixOptions(total=30, val=5, attempts=50))
    assert sum(c["total"] for c in counts.values()) == 30 and sum(c["val"] for c in counts.values()) == 5
    assert spark.read.json(str(tmp_path / "out")).count() == 30


def test_convert_filter_and_report_plans(spark, tmp_path):
    fim = "<|file_sep|>c<|file_sep|><|fim_prefix|>a<|fim_suffix|>b<|fim_middle|>"
    for name in ("t", "v"):
        (tmp_path / f"{name}.json").write_text("".join(json.dumps({"id": f"{name}{i}", "prompt": fim, "completion": "x" if i else ""}) + "\n" for i in range(3)))
    report = pipelines.converted_dataset(spark, {"train": str(tmp_path / "t.json"), "validation": str(tmp_path / "v.json")}, str(tmp_path / "c"), ConvertOptions())
    assert {r["emitted"]: r["sources"] for r in report["originals"]} == {0: 2, 2: 4} and spark.read.json(str(tmp_path / "c")).count() == 8
    manifest = pipelines.filtered_dataset(spark, str(tmp_path / "t.json"), str(tmp_path / "k.jsonl"), str(tmp_path / "r"), lambda p: "x", FilterOptions(retries=0))
    assert (manifest["processed"], manifest["kept"]) == (3, 2) and (tmp_path / "k.run_manifest.json").exists()
    (tmp_path / "d").mkdir()
    (tmp_path / "d/x.jsonl").write_text("".join(json.dumps({"prompt": "p" * i, "metadata": {"task_id": "a_b-c/1", "fpath_tuple": ["a", "b-c", "X.java"], "ground_truth": "g"}}) + "\n" for i in range(1, 5)))
    got = pipelines.corpus_report(spark, [str(tmp_path / "d")])
    assert got["projects"][0]["project"] == "a/b-c" and got["prompt_chars"]["p50"] == 2.5 and got["longest"][0]["prompt_chars"] == 4
    text = sinks.corpus_text(got)
    assert "  x.jsonl: 4 (100.00%)" in text and "p50=2.5, p90=3.7" in text and "file=x.jsonl, task=a_b-c/1, path=a/b-c" in text and got["bars"] == [{"project": "a/b-c", "n": 4}]
    assert "total" in sinks.console_summary("report", got) and sinks.preview(spark.createDataFrame([("a\n b",)], "t string"), ["t"]) == ["a b"]
    short = pipelines.filtered_dataset(spark, str(tmp_path / "t.json"), str(tmp_path / "k2.jsonl"), None, lambda p: "x", FilterOptions(retries=0), max_keep=1, progress_seconds=0.01)
    assert (short["kept"], short["reached_max_keep"]) == (1, True)


def test_command_line():
    a = parser().parse_args(["filter", "in", "out", "--model", "m", "--endpoint", "e"])
    assert a.match_mode == "ws_norm" and a.fuzzy_threshold == 0.98 and a.concurrency == 8
    for bad in (["codefix", "r", "o", "--total", "0"], ["codefix", "r", "o", "--val", "6000"], ["filter", "a", "b", "--model", "m", "--endpoint", "e", "--concurrency", "0"]):
        with pytest.raises(SystemExit):
            main(bad)
    assert not parser().parse_args(["samples", "r", "o", "--no-exclude-bench"]).exclude_bench
    assert parser().parse_args(["samples", "r", "o"]).per_file == 60 and parser().parse_args(["codefix", "r", "o"]).total == 5000


def test_tables_that_no_result_reads_are_deleted(spark):
    folder = Path(storage.shared_dir(spark).removeprefix("file://")) / "millrace"

    @storage.tidy
    def inner():
        used = storage.materialize(spark.range(5), "used")
        storage.materialize(spark.range(3), "unused")
        return used.filter("id > 1")

    @storage.tidy
    def outer():
        return storage.materialize(inner(), "outer"), None

    left = inner()
    assert left.count() == 3 and len(storage.read_by(left)) == 1 and not list(folder.glob("unused-*"))
    out, _ = outer()
    assert out.count() == 3 and {p.name for p in folder.glob("used-*")} == storage.read_by(left)
    storage.drop_tables(left, out)
    assert not list(folder.glob("used-*")) and not list(folder.glob("outer-*"))

    @storage.tidy
    def fails():
        storage.materialize(spark.range(5), "lost")
        raise ValueError

    with pytest.raises(ValueError):
        fails()
    assert not list(folder.glob("lost-*"))
