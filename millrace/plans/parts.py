"""Queries that reach the remaining parts of the inventory: files, sinks, reports, prompts, retrieval under masks, clients.

Those on files write their input to the shared folder first, read it with the engine's sources and delete nothing that the
result reads.
"""

from __future__ import annotations

import io
import json
import urllib.error

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators import bm25, codefix, convert, matching, modelfilter, samples, tensors
from millrace.plans import pipelines
from millrace.plans.queries import _ANSWERS, _BM25, _CONVERTED, _GOOD, _ITEMS, _LINES, _answers, _prompts, _statements, doc_files, query, table
from millrace.sources import readers, sinks
from millrace.storage import materialize, new_path, spread

# --- files -----------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, lang, source, md5(text) AS text_md5 FROM documents")
def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as compressed JSON lines and back, by a reader that fails at a malformed line."""
    path = new_path(spark, "jsonl")
    sinks.write_jsonl(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), path, gzip=True)
    return readers.jsonl_strict(spark, path, "doc_id long, lang string, source string, text string").select("doc_id", "lang", "source", F.md5("text").alias("text_md5"))


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents")
def jsonl_lenient_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: the same among blank, malformed and other lines, which are left out."""
    path = new_path(spark, "jsonl")
    docs = table(spark, sf_dir, "documents")
    lines = docs.select(F.explode(F.array(F.to_json(F.struct("doc_id", "text")), F.lit(" "), F.lit('{"doc_id": '), F.lit("[1]"))).alias("value"))
    lines.write.text(path)
    return readers.jsonl_lenient(spark, path).select(readers.field("doc_id", "bigint").alias("doc_id"), F.md5(readers.field("text")).alias("text_md5"))


@query("SELECT doc_id, n_chars, CASE WHEN ('0x' || substr(md5('42|' || doc_id), 1, 8))::BIGINT::DOUBLE / 4294967296 < 0.1 THEN 'val' ELSE 'train' END AS split FROM documents")
def split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split written to one folder each and read as named splits."""
    path = new_path(spark, "splits")
    sinks.write_splits(samples.bernoulli_split(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), ["doc_id"], 0.1), path)
    return readers.load_splits(spark, {"train": f"{path}/split=train", "val": f"{path}/split=val"}).select("doc_id", "n_chars", "split")


@query("SELECT conv_id, turn, CASE WHEN turn <> 5 AND gt_w = an_w THEN 'kept' ELSE 'rejected' END AS sink FROM (" + _ANSWERS + "SELECT * FROM n)")
def routed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: kept and rejected rows in their own sinks, read back."""
    path = new_path(spark, "routed")
    sinks.write_routed(materialize(modelfilter.evaluate(_answers(spark, sf_dir)).select("conv_id", "turn", "passed"), "routed-rows"), f"{path}/kept", f"{path}/rejected")
    both = [spark.read.schema("conv_id long, turn long").json(f"{path}/{name}").withColumn("sink", F.lit(name)) for name in ("kept", "rejected")]
    return both[0].unionByName(both[1])


@query("SELECT * FROM (VALUES ('gathered', 'top.jsonl'), ('gathered', 'x.jsonl'), ('found', 'top.jsonl'), ('found', 'low.jsonl')) t(how, name)")
def file_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files named twice and found in folders, distinct; gathering does not go below a folder, finding does."""
    path = new_path(spark, "found")
    nation = table(spark, sf_dir, "nation").coalesce(1)
    for folder in ("top.jsonl", "deep/low.jsonl"):
        sinks.write_jsonl(nation, f"{path}/{folder}")
    below = lambda f: next(p for p in reversed(f.split("/")) if p.endswith(".jsonl"))  # noqa: E731  a written file is a folder of parts
    found = {below(f) for f in readers.find_files(spark, [path, path], "*.json")}
    inside = {below(f) for f in readers.gather(spark, ["/a/x.jsonl", "/a/x.jsonl"], f"{path}/top.jsonl", "*.json")}
    return spark.createDataFrame([("found", f) for f in sorted(found)] + [("gathered", f) for f in sorted(inside)], "how string, name string")


@query("SELECT CASE doc_id % 3 WHEN 0 THEN 'src' ELSE 'src/deep' END AS folder, count(*) AS n_lines, sum(length(text) + 1) AS chars FROM documents WHERE doc_id % 3 <> 1 GROUP BY 1")
def source_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of files under a folder named as one to skip; below it such folders are skipped, and paths are relative."""
    root = f"{new_path(spark, 'tree')}/build/x"
    flat = table(spark, sf_dir, "documents").select("doc_id", F.translate("text", "\n", " ").alias("value"))
    for k, folder in enumerate(("src", "src/target", "src/deep")):
        flat.filter(F.col("doc_id") % 3 == k).select("value").write.text(f"{root}/{folder}")
    lines = readers.line_table(readers.code_files(spark, root, "*.txt"))
    return lines.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("chars"))


@query("SELECT doc_id, md5(chr(65533) || replace(text, ' ', chr(10))) AS text_md5 FROM documents")
def decode_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that are no text are deleted, a replacement character that was there stays, and line ends are unified."""
    unix = F.encode(F.concat(F.lit("�"), F.replace("text", F.lit(" "), F.lit("\r\n"))), "UTF-8")
    raw = F.concat(F.unhex(F.lit("FF")), unix, F.unhex(F.lit("C3")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.decode_ignore(raw)).alias("text_md5"))


@query("""
SELECT CASE WHEN k = 2 THEN 'file:' || r ELSE 't' || item_id END AS task_id, text AS ground_truth, CASE WHEN k = 1 THEN 'One.java' ELSE 'src/F' || item_id || '.java' END AS path,
  CASE WHEN k = 0 THEN item_id::INTEGER END AS line_no
FROM (SELECT item_id, text, item_id % 4 AS k, row_number() OVER (ORDER BY item_id) * 2 - 1 AS r FROM benchmark) WHERE k <> 3
""")
def benchmark_loader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with a path as list or text, with and without a name, with line numbers that are none, between malformed lines."""
    path, k = new_path(spark, "items"), F.col("item_id") % 4
    item = F.col("item_id").cast("string")
    meta = F.struct(
        F.when(k != 2, F.concat(F.lit("t"), item)).alias("task_id"), F.when(k != 3, F.col("text")).alias("ground_truth"),
        F.when(k == 0, item).when(k == 1, "+-5").otherwise("3.5").alias("line_no"), F.array(F.lit("src"), F.concat(F.lit("F"), item, F.lit(".java"))).alias("fpath_tuple"),
    )
    line = F.to_json(F.struct(F.lit("").alias("prompt"), meta.alias("metadata")))
    line = F.when(k == 1, F.regexp_replace(line, r'"fpath_tuple":\[[^\]]*\]', '"fpath_tuple":"One.java"')).otherwise(line)
    rows = table(spark, sf_dir, "benchmark").orderBy("item_id").coalesce(1)
    rows.select(F.explode(F.array(line, F.lit("not json"))).alias("value")).write.text(path)
    got = readers.benchmark_records(spark, path)
    return got.select(F.regexp_replace("task_id", "^part-[^:]*:", "file:").alias("task_id"), "ground_truth", F.array_join("fpath_tuple", "/").alias("path"), "line_no")


@query("""
SELECT * FROM (SELECT 'first' AS how, doc_id FROM documents ORDER BY doc_id LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'drawn', doc_id FROM documents ORDER BY md5('7|' || doc_id), doc_id LIMIT 20) UNION ALL SELECT 'shuffled', doc_id FROM documents
""")
def load_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows, a sample, or all rows in random order."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    parts = [readers.load_policy(docs, "doc_id", *a).select(F.lit(how).alias("how"), "doc_id") for how, a in (("first", (False, 20)), ("drawn", (True, 20, 7)), ("shuffled", (True, None, 7)))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(_ANSWERS + "SELECT 'kept.run_manifest.json' AS name, count(*) AS processed, count(*) FILTER (turn <> 5 AND gt_w = an_w) AS kept, count(*) FILTER (turn = 5) AS errors, true AS stamped FROM n")
def run_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's totals in its manifest, which is named after the output and read back."""
    path = sinks.manifest_path(f"{new_path(spark, 'run')}/kept.jsonl.gz")
    totals = modelfilter.run_stats(modelfilter.evaluate(_answers(spark, sf_dir))).first().asDict()
    sinks.write_report(spark, sinks.run_manifest({}, totals, sinks.now_utc(), "model", "endpoint", []), path)
    m = json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))
    stamped = m["started_at"] <= m["finished_at"] and m["started_at"].endswith("+00:00")
    return spark.createDataFrame([(path.rsplit("/", 1)[1], m["processed"], m["kept"], m["errors"], stamped)], "name string, processed long, kept long, errors long, stamped boolean")


# --- text functions --------------------------------------------------------------------------------------------------


@query("SELECT doc_id, len(string_split(text, chr(10))) AS same, 0 AS other FROM documents")
def line_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: lines equal themselves with any line end behind them, and not with a blank before them."""
    lines = F.split("text", "\n")
    same = F.filter(lines, lambda x: tx.lines_equal(x, F.concat(x, F.lit("\r\n"))))
    other = F.filter(lines, lambda x: tx.lines_equal(x, F.concat(F.lit(" "), x)))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(same).cast("long").alias("same"), F.size(other).alias("other"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 7 <> 3 THEN 0 WHEN doc_id % 4 <> 1 THEN -2 ELSE -3 END AS common, 3 + (doc_id % 2)::INTEGER AS depth,
  CASE WHEN doc_id % 2 = 1 THEN 'top/' ELSE '' END || 'd' || doc_id % 4 || '/x/f' || doc_id % 7 || '.java' AS path FROM documents
""")
def suffix_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well paths fit a wanted one from their ends."""
    i = F.col("doc_id")
    path = F.concat(F.when(i % 2 == 1, "top/").otherwise(""), F.lit("d"), (i % 4).cast("string"), F.lit("/x/f"), (i % 7).cast("string"), F.lit(".java"))
    score = tx.suffix_score(path, F.array(*map(F.lit, ("repo", "d1", "x", "f3.java"))))
    return table(spark, sf_dir, "documents").select("doc_id", score.alias("s")).select("doc_id", "s.common", "s.depth", "s.path")


@query(f"""
WITH l AS (SELECT doc_id, list(line ORDER BY i) AS p FROM ({_LINES}) GROUP BY doc_id),
q AS (SELECT doc_id, array_to_string(p[greatest(len(p) // 2 - 4, 1):len(p) // 2], '') || chr(10) || array_to_string(p[len(p) // 2 + 1:len(p) // 2 + 5], '') AS t FROM l),
n AS (SELECT *, array_to_string(regexp_extract_all(t, '[A-Za-z_][A-Za-z0-9_]*'), ' ') AS names FROM q)
SELECT doc_id, md5(t) AS lines_md5, md5(names) AS names_md5, md5(t || chr(10) || names) AS both_md5 FROM n
""")
def query_building(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three kinds of retrieval queries of the middle of each document, from five lines on each side."""
    lines = table(spark, sf_dir, "documents").filter("text <> ''").select("doc_id", tx.splitlines(F.col("text")).alias("l")).withColumn("half", F.floor(F.size("l") / 2).cast("int"))
    before, after = F.slice("l", 1, F.col("half")), F.slice("l", F.col("half") + 1, F.size("l"))
    return lines.select("doc_id", *[F.md5(tx.build_query(before, after, mode, 5)).alias(name) for mode, name in (("masked_window", "lines_md5"), ("ast_symbols", "names_md5"), ("hybrid", "both_md5"))])


_BLOCK = "'/* RAG_CONTEXT' || chr(10) || '[1] path: ' || source || ' (lines 1-3)' || chr(10) || rtrim(text, chr(10)) || chr(10) || chr(10) || '[2] path: B (lines 8-9)' || chr(10) || lang || chr(10) || chr(10) || 'END_RAG_CONTEXT */' || chr(10)"


@query(f"""
SELECT doc_id, md5({_BLOCK}) AS block_md5, md5('<|fim_prefix|>' || {_BLOCK} || source || '<|fim_suffix|>' || text || '<|fim_middle|>') AS head_md5,
  md5('<|fim_prefix|>' || source || {_BLOCK} || '<|fim_suffix|>' || text || '<|fim_middle|>') AS tail_md5, md5('<|fim_prefix|>' || source || '<|fim_suffix|>' || text || '<|fim_middle|>') AS none_md5
FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL
""")
def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets as a comment block, put before or behind the prefix of a prompt, or left out if there are none."""
    def snippet(file: Column, start: int, end: int, text: Column) -> Column:
        return F.struct(file.alias("file"), F.lit(start).alias("start"), F.lit(end).alias("end"), text.alias("text"))

    block = tx.render_context(F.array(snippet(F.col("source"), 0, 2, F.col("text")), snippet(F.lit("B"), 7, 8, F.concat(F.col("lang"), F.lit("\n")))))
    prompt = tx.fim_prompt(F.col("source"), F.col("text"))
    d = table(spark, sf_dir, "documents").filter("lang is not null and source is not null").select("doc_id", block.alias("b"), prompt.alias("p"))
    put = pipelines.insert_context
    return d.select("doc_id", F.md5("b").alias("block_md5"), F.md5(put(F.col("p"), F.col("b"))).alias("head_md5"), F.md5(put(F.col("p"), F.col("b"), True)).alias("tail_md5"), F.md5(put(F.col("p"), F.lit(""))).alias("none_md5"))


# --- samples and retrieval -------------------------------------------------------------------------------------------


@query(f"""
WITH c AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY md5('42|' || doc_id || '|' || i)) AS r FROM ({_LINES}) WHERE {_GOOD})
SELECT doc_id AS file, i::INTEGER AS line_index FROM c WHERE r <= CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 8 END
""")
def downweighted_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight random lines of each document, two of those that a benchmark refers to."""
    files = doc_files(spark, sf_dir)
    referenced = files.filter(F.col("path") % 3 == 0).select(F.col("path").alias("file"))
    return samples.sample_lines(samples.candidates(files), samples.SampleOptions(per_file=8), referenced).select("file", "line_index")


@query(f"""
WITH c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY md5('42|' || doc_id || '|' || i)) AS r FROM ({_LINES}) WHERE {_GOOD})
SELECT doc_id AS file, count(*) AS n FROM c WHERE doc_id % 3 = 0 AND r <= 3 GROUP BY doc_id
""")
def bench_file_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of each file that a benchmark refers to."""
    files = doc_files(spark, sf_dir)
    return matching.bench_file_counts(samples.fim_samples(files, samples.SampleOptions(per_file=3)), files.filter(F.col("path") % 3 == 0).select(F.col("path").alias("file")))


@query("""
SELECT doc_id AS file, j::INTEGER AS start, CASE WHEN j = 0 THEN 4 WHEN j = 5 + 4 * (doc_id % 4) THEN j ELSE j + 3 END::INTEGER AS "end"
FROM (SELECT doc_id, unnest(list_concat([0], range(5, 6 + 4 * (doc_id % 4), 4))) AS j FROM documents)
""")
def brace_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of classes with one method and more; braces in quotes and comments do not count."""
    method = 'void f() { // {\n  x("}", \'{\'); /* { */\n  /* }\n*/ }\n'
    text = F.concat(F.lit("class A {\n" + method), F.repeat(F.lit(method), (F.col("doc_id") % 4).cast("int")), F.lit("}\n"))
    return samples.brace_chunks(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), text.alias("text"))).select("file", "start", "end")


@query(_BM25 + f""", gp AS (SELECT DISTINCT trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM benchmark WHERE item_id % 2 = 0)),
x AS (
  SELECT r.item_id, r.doc_id, r.rank, text, string_split(b.text_b, chr(10))[1] AS first_line, list_transform(string_split(text, chr(10)), lambda z: rtrim(z, chr(10) || chr(13))) AS ls
  FROM r JOIN documents USING (doc_id) JOIN (SELECT item_id, text AS text_b FROM benchmark) b USING (item_id) WHERE rank <= 24
), w AS (
  SELECT *, CASE WHEN list_contains(ls, first_line) THEN 'completion_text' WHEN doc_id % 7 = 0 THEN 'bench_line' WHEN len(list_intersect(ls, (SELECT list(line) FROM gp))) > 0 THEN 'bench_text' END AS reason FROM x
)
SELECT 'excluded' AS what, reason, NULL::BIGINT AS item_id, count(*) AS n, NULL::VARCHAR AS shown FROM w WHERE reason IS NOT NULL GROUP BY reason
UNION ALL
SELECT 'shown', NULL, item_id, count(*), string_agg(doc_id::VARCHAR, ',' ORDER BY place) FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS place, sum(least(length(text), 600)) OVER (PARTITION BY item_id ORDER BY rank) AS used FROM w WHERE reason IS NULL
) WHERE place <= 4 AND (place = 1 OR used <= 2000) GROUP BY item_id
""")
def masked_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of benchmark items among whole documents, none of which a mask touches, and what was left out."""
    docs = table(spark, sf_dir, "documents")
    lines = F.split("text", "\n")
    chunks = spread(docs.select("doc_id", "text")).select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("file"), F.lit(0).alias("start"), (F.size(lines) - 1).alias("end"), lines.alias("lines"), "text", tx.code_tokens(F.col("text")).alias("tokens"))
    items = table(spark, sf_dir, "benchmark")
    asked = items.select(F.col("item_id").alias("query_id"), F.lit(-1).cast("long").alias("file"), F.lit(0).alias("line_index"), F.split("text", "\n")[0].alias("completion"), tx.code_tokens(F.col("text")).alias("tokens"))
    masks = {
        "line_mask": docs.filter("doc_id % 7 = 0").select(F.col("doc_id").alias("file"), F.lit(0).alias("line_index")), "file_prints": docs.select(F.col("doc_id").alias("file"), F.lit("").alias("fp")).limit(0),
        "global_prints": items.filter("item_id % 2 = 0").select(F.explode(F.transform(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")))).alias("fp")).distinct(),
    }
    contexts, excluded = bm25.retrieve(asked, materialize(chunks, "masked-chunks"), bm25.RetrieveOptions(), masks, digits=6)
    shown = contexts.select(F.lit("shown").alias("what"), F.lit(None).cast("string").alias("reason"), F.col("query_id").alias("item_id"), F.size("rag").cast("long").alias("n"), F.array_join(F.transform("rag", lambda r: r["file"].cast("string")), ",").alias("shown"))
    left = excluded.select(F.lit("excluded").alias("what"), "reason", F.lit(None).cast("long").alias("item_id"), "n", F.lit(None).cast("string").alias("shown"))
    return shown.unionByName(left)


@query("SELECT doc_id::VARCHAR AS task_id, CASE WHEN doc_id % 2 = 0 THEN 'matched' ELSE 'unmatched_ambiguous' END AS status, CASE WHEN doc_id % 2 = 0 THEN 10 END AS line_index, CASE WHEN doc_id % 2 = 0 THEN 80 ELSE 30 END AS confidence FROM documents")
def prompt_disambiguation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two equal lines the one whose surroundings fit the prompt; ambiguous where neither does."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("task_id"), "doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".java")).alias("file"))
    body = [*[f"aaa{i}\n" for i in range(10)], "same\n", *["bbb\n"] * 25, "same\n", *["ccc\n"] * 10]
    lines = docs.select("file", F.posexplode(F.array(*map(F.lit, body))).alias("line_index", "line"))
    prompt = F.when(F.col("doc_id") % 2 == 0, "".join(body[:10]).replace("\n", "\r\n")).otherwise("\n".join("zzz" for _ in range(10)))
    records = docs.select("task_id", prompt.alias("prompt"), F.lit("same").alias("ground_truth"), F.array("file").alias("fpath_tuple"), F.lit(None).cast("int").alias("line_no"))
    return matching.match_records(materialize(records, "prompt-records"), materialize(lines, "prompt-lines")).select("task_id", "status", "line_index", "confidence")


# --- conversion and tensors ------------------------------------------------------------------------------------------


@query(_CONVERTED + """, f AS (SELECT *, CASE WHEN n <= budget THEN n ELSE least(m, budget) END AS after FROM r)
SELECT source_id, variant, CASE WHEN drop_reason IS NULL AND after > 300 THEN 'prompt_exceeds_model_max_length' ELSE drop_reason END AS drop_reason, n > 300 AS over_model_max FROM f
""")
def model_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prompts over the model's own limit are told and dropped."""
    done = convert.convert(_prompts(spark, sf_dir), convert.ConvertOptions(max_length=500, model_max_length=300, enforce_model_max=True))
    return done.select("source_id", "variant", "drop_reason", "over_model_max")


@query(_CONVERTED + """
SELECT split, count(*) FILTER (variant = 'norag' AND k = 3) AS unmatched_markers, count(*) FILTER (n > budget AND budget > 0) AS over_budget, count(*) FILTER (drop_reason IS NOT NULL) AS dropped, round(sum(c) / count(*), 6) AS avg_completion_tokens
FROM r GROUP BY GROUPING SETS ((split), ())
""")
def safeguard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversion report's counters and averages."""
    d = convert.split_stats(convert.convert(_prompts(spark, sf_dir), convert.ConvertOptions(max_length=500)))
    return d.select("split", "unmatched_markers", "over_budget", "dropped", F.round("avg_completion_tokens", 6).alias("avg_completion_tokens"))


@query("SELECT doc_id, md5(text) AS prompt_md5, lang AS completion, CASE WHEN doc_id % 2 = 0 THEN 'train' ELSE 'validation' END AS split FROM documents")
def three_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expected code becomes the completion."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prompt"), F.col("lang").alias("expectedCode"), F.col("source").alias("completedCode"), F.when(F.col("doc_id") % 2 == 0, "train").otherwise("validation").alias("split"))
    return pipelines.three_field_rows(rows).select("doc_id", F.md5("prompt").alias("prompt_md5"), "completion", "split")


@query("""
SELECT source, ceil(n / 8)::BIGINT AS steps_per_epoch, greatest(1, floor(ceil(n / 8) * 1.5))::BIGINT AS total_steps, floor(greatest(1, floor(ceil(n / 8) * 1.5)) * 0.1)::BIGINT AS warmup_steps
FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)
""")
def training_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of a training run over each source."""
    counts = table(spark, sf_dir, "documents").groupBy("source").count().collect()  # one row for each source
    rows = [(r["source"], *(int(v) for v in tensors.training_steps(r["count"], 4, 2, 1.5, 0.1).values())) for r in counts]
    return spark.createDataFrame(rows, "source string, steps_per_epoch long, total_steps long, warmup_steps long")


# --- a model's answers -----------------------------------------------------------------------------------------------


def canned(prompt: str) -> str:
    """A client that answers, that fails once or always, and that answers nonsense, by the prompt's last character."""
    last = prompt[-1]
    tried = canned.__dict__.setdefault("tried", set())
    if last == "3" and prompt not in tried:
        tried.add(prompt)
        raise TimeoutError("slow")
    if last == "4":
        raise urllib.error.HTTPError("u", 400, "bad", None, io.BytesIO(b"no"))
    if last == "5":
        raise KeyError("client")
    return modelfilter.parse_completion("{" if last == "6" else json.dumps({"choices": [{"text": f"to {prompt}"}]}))


@query("""
SELECT conv_id, turn, CASE WHEN right(p, 1) IN ('4', '5', '6') THEN NULL ELSE 'to ' || p END AS teacher_raw, CASE right(p, 1) WHEN '4' THEN 'http_400' WHEN '5' THEN 'request_error' WHEN '6' THEN 'bad_response_json' END AS request_error
FROM (SELECT conv_id, turn, conv_id || '-' || turn AS p FROM conversations)
""")
def model_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts sent to a client by many requests at once, with another try after a pause and reasons for what failed."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("prompt"))
    opts = modelfilter.FilterOptions(retries=2, backoff=0.001, qps=100_000.0)
    return modelfilter.ask_model(rows, canned, opts).select("conv_id", "turn", "teacher_raw", "request_error")


@query("SELECT event_id, 'http_' || (400 + event_id % 200) AS reason, (400 + event_id % 200) IN (429, 502, 503, 504) AS transient, 'body ' || event_id AS detail FROM events")
def error_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTTP errors by their code, with what the server said."""

    def told(batches):
        for b in batches:
            got = [modelfilter.classify_error(urllib.error.HTTPError("u", 400 + i % 200, "m", None, io.BytesIO(f" body {i} ".encode()))) for i in b["event_id"]]
            yield pd.DataFrame({"event_id": b["event_id"], "reason": [g[0] for g in got], "transient": [g[1] for g in got], "detail": [g[2] for g in got]})

    return table(spark, sf_dir, "events").select("event_id").mapInPandas(told, "event_id long, reason string, transient boolean, detail string")


@query(_ANSWERS + """, o AS (SELECT *, conv_id * 100 + turn AS pos, turn <> 5 AND gt_w = an_w AS ok FROM n), c AS (SELECT *, sum(ok::INTEGER) OVER (ORDER BY pos) - ok::INTEGER AS before FROM o)
SELECT conv_id, turn FROM c WHERE before < 50
""")
def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run that keeps fifty rows has seen."""
    done = modelfilter.evaluate(_answers(spark, sf_dir).withColumn("pos", F.col("conv_id") * 100 + F.col("turn")))
    return modelfilter.until_kept(done, "pos", 50).select("conv_id", "turn")


# --- statement repair ------------------------------------------------------------------------------------------------


@query("""
SELECT 'F' || c_custkey || '::0::' || m AS id, CASE m WHEN 'missing_arg' THEN 'run();' ELSE 'run(' || c_custkey || ', ' || c_custkey || ');' END AS broken_line
FROM customer, (VALUES ('missing_arg'), ('extra_arg')) t(m)
""")
def single_argument_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An argument left out or said twice, where one argument leaves no choice; it cannot be swapped."""
    key = F.col("c_custkey").cast("string")
    lines = table(spark, sf_dir, "customer").select(F.concat(F.lit("F"), key).alias("file"), F.lit(0).alias("line_index"), F.concat(F.lit("run("), key, F.lit(");\n")).alias("line"))
    return codefix.candidates(codefix.statements(lines)).select("id", "broken_line")


@query(f"""
SELECT mutation_type, count(*) AS total, count(*) FILTER (l % 2 = 0) AS train, count(*) FILTER (l % 2 = 1) AS val FROM (
  SELECT line_index AS l, 'swap_args' AS mutation_type FROM ({_ITEMS}) WHERE k < 2 AND (k = 1 OR o <> p)
  UNION ALL SELECT line_index, 'missing_arg' FROM ({_ITEMS}) WHERE k < 2 UNION ALL SELECT line_index, 'extra_arg' FROM ({_ITEMS}) WHERE k < 2
) GROUP BY mutation_type
""")
def mutation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each mutation by split."""
    pool = codefix.candidates(codefix.statements(_statements(spark, sf_dir)))
    return codefix.mutation_counts(pool.withColumn("split", F.when(F.col("line_index") % 2 == 0, "train").otherwise("val")))


@query("SELECT m AS mutation_type, t AS total, 100 AS n_val, 0 AS shared_files FROM (VALUES ('swap_args', 1667), ('missing_arg', 1667), ('extra_arg', 1666)) v(m, t)")
def exact_split_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5000 rows by quotas, exactly 100 of them for validation, no file on both sides."""
    chosen = materialize(codefix.exact_split(materialize(codefix.candidates(codefix.statements(_statements(spark, sf_dir))), "codefix-pool"), 5000, 100), "codefix-chosen")
    shared = chosen.groupBy("file").agg(F.count_distinct("split").alias("n")).filter("n > 1").count()
    counts = codefix.mutation_counts(chosen)
    n_val = counts.agg(F.sum("val")).first()[0]
    return counts.select("mutation_type", "total", F.lit(int(n_val)).alias("n_val"), F.lit(shared).cast("int").alias("shared_files"))


@query("""
WITH u AS (SELECT o_orderkey, 'With these similar correct statements:' || chr(10) || CASE WHEN o_orderkey % 3 = 0 THEN '1. (no similar statements found)' ELSE '1. a(' || o_custkey || ');' || chr(10) || '2. b();' END
  || chr(10) || chr(10) || 'Fix this problems:' || chr(10) || '1. argument order mismatch in method invocation' || chr(10) || chr(10) || 'In this code snippet to fix:' || chr(10) || '```java' || chr(10) || 'f(' || o_custkey || ', ' || o_orderkey || ');'
  || chr(10) || '```' || chr(10) || chr(10) || 'Answer only one Java code block with the fixed replacement statement.' AS t, '```java' || chr(10) || 'f(' || o_orderkey || ', ' || o_custkey || ');' || chr(10) || '```' AS completion FROM orders)
SELECT o_orderkey, md5(t) AS user_md5, md5('<|im_start|>system' || chr(10) || 'You fix exactly one Java statement.' || chr(10) || 'Return exactly one fenced Java code block with one corrected statement line.' || chr(10)
  || 'Do not output explanations or any text outside the code block.' || chr(10) || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || t || chr(10) || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)) AS prompt_md5, completion FROM u
""")
def repair_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P25: training records of broken statements with and without similar ones."""
    a, b = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    hints = F.when(F.col("o_orderkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("a("), b, F.lit(");")), F.lit("b();")))
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit("f("), a, F.lit(", "), b, F.lit(");\n")).alias("original_line"), F.concat(F.lit("f("), b, F.lit(", "), a, F.lit(");\n")).alias("broken_line"), hints.alias("augmentations"), F.array(F.lit(codefix.PROBLEMS["swap_args"])).alias("compiler_problems")
    )
    return codefix.records(rows).select("o_orderkey", F.md5(F.col("messages")[1]["content"]).alias("user_md5"), F.md5("prompt").alias("prompt_md5"), "completion")


# --- reports ---------------------------------------------------------------------------------------------------------


@query("""
SELECT 'project' AS part, coalesce(lang, 'zz') AS name, count(*) AS n, round(quantile_cont(length(text), 0.5), 6) AS p50, round(quantile_cont(length(text), 0.99), 6) AS p99 FROM documents GROUP BY 2
UNION ALL SELECT 'ground_truth_lines', 'all', count(*), round(quantile_cont(n, 0.5), 6), round(quantile_cont(n, 0.99), 6) FROM (SELECT len(string_split(text, chr(10))) AS n FROM documents)
""")
def corpus_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus report of JSON lines with metadata, by project."""
    path = new_path(spark, "report")
    lang = F.coalesce("lang", F.lit("zz"))
    meta = F.struct(F.concat(lang, F.lit("/"), F.col("doc_id").cast("string")).alias("task_id"), F.array(lang, F.lit("src")).alias("fpath_tuple"), F.col("text").alias("ground_truth"))
    table(spark, sf_dir, "documents").select(F.to_json(F.struct(F.col("text").alias("prompt"), meta.alias("metadata"))).alias("value")).write.text(path)
    report = pipelines.corpus_report(spark, [f"{path}/*.txt"])
    assert sinks.corpus_text(report) and report["bars"]
    rows = [("project", r["project"], r["n"], round(float(report["by_project"][r["project"]]["p50"]), 6), round(float(report["by_project"][r["project"]]["p99"]), 6)) for r in report["projects"]]
    lines = report["truth_lines"]
    rows.append(("ground_truth_lines", "all", lines["count"], round(float(lines["p50"]), 6), round(float(lines["p99"]), 6)))
    return spark.createDataFrame(rows, "part string, name string, n long, p50 double, p99 double")
