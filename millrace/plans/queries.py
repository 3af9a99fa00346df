"""Queries over the driver's tables, each with the DuckDB statement of the same result where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators import bm25, codefix, convert, matching, modelfilter, samples, stats, tensors
from millrace.sources import readers
from millrace.storage import materialize, spread
from millrace.streaming import events as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as source files."""
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text"))


# --- samples ---------------------------------------------------------------------------------------------------------

FIM = samples.SampleOptions(prefix_lines=8, suffix_lines=8, per_file=3)
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LINES = "SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS i, len(parts) AS n FROM (SELECT doc_id, CASE WHEN right(text, 1) = chr(10) THEN list_transform(string_split(left(text, length(text) - 1), chr(10)), lambda x: x || chr(10)) ELSE list_concat(list_transform(string_split(text, chr(10))[:-2], lambda x: x || chr(10)), string_split(text, chr(10))[-1:]) END AS parts FROM documents WHERE text <> '')"
_GOOD = f"length(trim(line, {_WS})) >= 4 AND NOT regexp_full_match(trim(line, {_WS}), '[{{}}();]+') AND NOT starts_with(trim(line, {_WS}), 'package ') AND NOT starts_with(trim(line, {_WS}), 'import ')"


@query(f"""
WITH l AS ({_LINES}), c AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY md5('42|' || doc_id || '|' || i)) AS r FROM l WHERE {_GOOD}
), s AS (SELECT * FROM c WHERE r <= 3)
SELECT s.doc_id || ':' || s.i AS id, s.doc_id AS file, s.i::BIGINT AS line_index,
  '<|fim_prefix|>' || coalesce((SELECT string_agg(p.line, '' ORDER BY p.i) FROM l p WHERE p.doc_id = s.doc_id AND p.i BETWEEN s.i - 8 AND s.i - 1), '')
  || '<|fim_suffix|>' || coalesce((SELECT string_agg(p.line, '' ORDER BY p.i) FROM l p WHERE p.doc_id = s.doc_id AND p.i BETWEEN s.i + 1 AND s.i + 8), '') || '<|fim_middle|>' AS prompt,
  rtrim(s.line, chr(10) || chr(13)) AS completion
FROM s
""")
def fim_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with eight lines of context on each side, three of each document."""
    return samples.fim_samples(doc_files(spark, sf_dir), FIM)


_HEAD = """'package p' || doc_id || ';' || chr(10) || chr(10) || 'import a.B;' || chr(10) || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'import c.D;' || chr(10) ELSE '' END"""


@query(f"SELECT doc_id AS file, CASE WHEN doc_id % 3 = 0 THEN '' ELSE {_HEAD} END AS header FROM documents")
def header_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of documents that begin with package and import lines; a leading comment hides them."""
    head = F.concat(F.lit("package p"), F.col("doc_id").cast("string"), F.lit(";\n\nimport a.B;\n\n"), F.when(F.col("doc_id") % 2 == 0, "import c.D;\n").otherwise(""))
    docs = table(spark, sf_dir, "documents")
    lines = tx.splitlines(F.concat(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("// note\n"), head)).otherwise(head), F.lit("class A {\n"), F.col("text")))
    return docs.select(F.col("doc_id").alias("file"), F.array_join(F.slice(lines, 1, tx.header_end(lines)), "").alias("header"))


@query(f"""
WITH l AS ({_LINES}), n AS (SELECT doc_id, max(n) AS n FROM l GROUP BY doc_id),
w AS (SELECT doc_id, n, unnest(range(0, (greatest(0, ceil((n - 12) / 8.0)) * 8 + 1)::BIGINT, 8)) AS s FROM n)
SELECT w.doc_id AS file, w.s::INTEGER AS start, (least(w.s + 12, w.n) - 1)::INTEGER AS "end", string_agg(l.line, '' ORDER BY l.i) AS text
FROM w JOIN l ON l.doc_id = w.doc_id AND l.i BETWEEN w.s AND w.s + 11 GROUP BY w.doc_id, w.s, w.n
""")
def line_hop_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping windows of twelve lines, four of them shared."""
    return samples.line_chunks(doc_files(spark, sf_dir), 12, 4).select("file", "start", "end", "text")


@query("SELECT doc_id, CASE WHEN ('0x' || substr(md5('42|' || doc_id), 1, 8))::BIGINT::DOUBLE / 4294967296 < 0.1 THEN 'val' ELSE 'train' END AS split FROM documents")
def bernoulli_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the rows for validation, by a hash of the row's key."""
    return samples.bernoulli_split(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 0.1)


@query("""
WITH g AS (SELECT DISTINCT source FROM documents),
r AS (SELECT source, row_number() OVER (ORDER BY md5('42|' || source), source) AS r, greatest(1, floor((SELECT count(*) FROM g) * 0.2)) AS k FROM g)
SELECT d.doc_id, d.source, CASE WHEN r.r <= r.k THEN 'val' ELSE 'train' END AS split FROM documents d JOIN r USING (source)
""")
def group_split_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the sources for validation, each with all its rows."""
    return samples.group_split(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 0.2)


@query("SELECT doc_id, lang FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 50")
def reservoir_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty documents, uniform without replacement."""
    return readers.reservoir(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 50)


@query("SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 25")
def ordered_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows in order."""
    return readers.limited(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", 25)


# --- tokens and retrieval --------------------------------------------------------------------------------------------

_STOP = "[" + ", ".join(f"'{w}'" for w in tx.STOPWORDS) + "]"


def _tokens_sql(text: str) -> str:
    runs = f"list_filter(regexp_split_to_array({text}, '[^A-Za-z0-9_.]+'), lambda x: x <> '')"
    humps = f"list_transform({runs}, lambda x: lower(regexp_replace(x, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')))"
    return f"list_filter(flatten(list_transform({humps}, lambda x: string_split(x, '_'))), lambda x: x <> '' AND NOT list_contains({_STOP}, x))"


@query(f"SELECT doc_id, len(t)::BIGINT AS n_tokens, list_unique(t)::BIGINT AS n_distinct FROM (SELECT doc_id, {_tokens_sql('text')} AS t FROM documents)")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: tokens of each document."""
    t = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", tx.code_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


_PART_NAME = "'get' || p_brand || '_' || p_partkey || 'ById new.' || p_name"


@query(f"SELECT p_partkey, array_to_string({_tokens_sql(_PART_NAME)}, '|') AS tokens FROM part")
def camel_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10 on names with humps, underscores and dots."""
    brand, name = F.col("p_brand"), F.col("p_name")
    text = F.concat(F.lit("get"), brand, F.lit("_"), F.col("p_partkey").cast("string"), F.lit("ById new."), name)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(tx.code_tokens(text), "|").alias("tokens"))


@query(f"SELECT token, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({_tokens_sql('text')}) AS token FROM documents) GROUP BY token")
def token_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and corpus frequency of each token."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", tx.code_tokens(F.col("text")).alias("tokens"))
    return bm25.counted_postings(docs).groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = materialize(spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", tx.code_tokens(F.col("text")).alias("tokens")), "bm25-docs")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), tx.code_tokens(F.col("text")).alias("tokens"))
    return bm25.scores(asked, docs)


_BM25 = f"""
WITH d AS (SELECT doc_id, {_tokens_sql('text')} AS t FROM documents),
st AS (SELECT count(*) AS n, avg(len(t)) AS avg_len FROM d),
q AS (SELECT item_id, token, count(*) AS qf, min(pos) AS pos FROM (SELECT item_id, unnest(t) AS token, unnest(range(len(t))) AS pos FROM (SELECT item_id, {_tokens_sql('text')} AS t FROM benchmark)) GROUP BY ALL),
p AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS token FROM d) GROUP BY ALL),
f AS (SELECT token, count(*) AS df FROM p GROUP BY token),
s AS (
  SELECT q.item_id, p.doc_id, min(q.pos) AS first,
    round(sum(ln(1 + (st.n - f.df + 0.5) / (f.df + 0.5)) * (p.tf * 2.5) / (p.tf + 1.5 * (0.25 + 0.75 * len(d.t) / st.avg_len)) * q.qf), 6) AS score
  FROM q JOIN p USING (token) JOIN f USING (token) JOIN d USING (doc_id), st GROUP BY ALL
), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, first, doc_id) AS rank FROM s)
"""


@query(_BM25 + "SELECT item_id, doc_id, score, rank FROM r WHERE rank <= 4")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best documents of each benchmark item."""
    return bm25.top_k(_scored(spark, sf_dir), 4, 6).select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "score", "rank")


@query(_BM25 + """, x AS (
  SELECT r.item_id, r.doc_id, r.rank, CASE WHEN length(text) <= 600 THEN text ELSE left(text, 300) || chr(10) || '...' || chr(10) || right(text, 295) END AS snippet
  FROM r JOIN documents USING (doc_id) WHERE rank <= 12
), u AS (SELECT *, sum(length(snippet)) OVER (PARTITION BY item_id ORDER BY rank) AS used FROM x)
SELECT item_id, doc_id, rank, snippet FROM u WHERE rank <= 4 AND (rank = 1 OR used <= 2000)
""")
def bm25_budgeted_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets of the best documents that fit 2000 characters together, four at most."""
    ranked = bm25.top_k(_scored(spark, sf_dir), 12, 6).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"), "doc")
    kept = bm25.within_budget(ranked, bm25.RetrieveOptions())
    return kept.select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "rank", "snippet")


@query()
def rag_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search for context of the middle of each document whose id is divisible by 50, among chunks of all documents."""
    files = doc_files(spark, sf_dir)
    chunks = materialize(samples.text_chunks(files, 30, 10).withColumn("chunk_id", F.struct("file", "start")), "rag-chunks")
    some = table(spark, sf_dir, "documents").filter("doc_id % 50 = 0")  # before their texts are split, which is most of the work
    lines = materialize(spread(some.select(F.col("doc_id").alias("file"), tx.splitlines(F.col("text")).alias("l"))), "rag-lines").filter(F.size("l") > 2)
    at = F.floor(F.size("l") / 2).cast("int")
    asked = lines.select(F.col("file").alias("query_id"), "file", at.alias("line_index"), F.col("l")[at].alias("completion"), tx.code_tokens(tx.build_query(F.slice("l", 1, at), F.slice("l", at + 2, 20))).alias("tokens"))
    contexts, _ = bm25.retrieve(asked, chunks)
    return contexts.select("query_id", tx.render_context(F.transform("rag", lambda r: F.struct(r["file"].cast("string").alias("file"), r["start"].alias("start"), r["end"].alias("end"), r["text"].alias("text")))).alias("block"), F.size("rag").alias("n_snippets"))


# --- benchmark matching ----------------------------------------------------------------------------------------------

_DLINES = "SELECT doc_id, unnest(p) AS line, unnest(range(len(p))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)"
_BLINES = f"SELECT DISTINCT trim(l, {_WS}) AS line FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM benchmark) WHERE length(trim(l, {_WS})) >= 4"


def _bench_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    trimmed = F.transform(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")))
    return table(spark, sf_dir, "benchmark").select(F.explode(trimmed).alias("fp")).filter(F.length("fp") >= 4).distinct()


def _doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("line_index", "line"))


@query(f"SELECT doc_id AS file, i::INTEGER AS line_index FROM ({_DLINES}) WHERE trim(line, {_WS}) IN (SELECT line FROM ({_BLINES}))")
def decontam_line_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents that equal a benchmark line."""
    keyed = _doc_lines(spark, sf_dir).withColumn("fp", F.btrim("line", F.lit(" \t\n\x0b\x0c\r")))
    return keyed.join(_bench_lines(spark, sf_dir), "fp", "left_semi").select("file", "line_index")


@query(f"SELECT doc_id AS file, count(*) AS clean FROM ({_DLINES}) WHERE trim(line, {_WS}) NOT IN (SELECT line FROM ({_BLINES})) GROUP BY doc_id")
def decontam_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document that equal no benchmark line."""
    keyed = _doc_lines(spark, sf_dir).withColumn("fp", F.btrim("line", F.lit(" \t\n\x0b\x0c\r")))
    return keyed.join(_bench_lines(spark, sf_dir), "fp", "left_anti").groupBy("file").agg(F.count(F.lit(1)).alias("clean"))


@query(f"""
WITH c AS (SELECT * FROM ({_LINES}) WHERE {_GOOD}),
m AS (SELECT doc_id, i, CASE WHEN doc_id % 5 = 0 AND i % 7 = 0 THEN 'bench_line' WHEN trim(line, {_WS}) IN (SELECT line FROM ({_BLINES})) THEN 'bench_text_global' ELSE 'kept' END AS reason FROM c)
SELECT reason, count(*) AS n FROM m GROUP BY reason
""")
def exclusion_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate lines by the first mask that excludes them."""
    lines = materialize(samples.candidates(doc_files(spark, sf_dir)), "exclusion-lines")
    mask = lines.filter((F.col("file") % 5 == 0) & (F.col("line_index") % 7 == 0)).select("file", "line_index")
    none = lines.select("file", F.lit("").alias("fp")).limit(0)
    told = samples.exclusion_reason(lines, mask, none, _bench_lines(spark, sf_dir))
    return told.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 0::BIGINT AS leaked")
def leak_selfcheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples drawn behind the masks that lie on masked lines; there are none."""
    mask = decontam_line_mask(spark, sf_dir)
    none = mask.select("file", F.lit("").alias("fp")).limit(0)
    drawn = samples.masked_samples(doc_files(spark, sf_dir), (mask, none, none.select("fp")), FIM)
    return matching.leak_count(drawn, mask)


def _match_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as files of four folders, and items that ask for a line of a document at a known distance."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("d"), (F.col("doc_id") % 4).cast("string"), F.lit("/f"), F.col("doc_id").cast("string"), F.lit(".java"))
    lines = docs.select(path.alias("file"), F.posexplode(F.split("text", "\n")).alias("line_index", "line"))
    p = F.split("text", "\n")
    at = (F.size(p) / 2).cast("int")
    kind = F.col("doc_id") % 6
    records = docs.select(
        F.col("doc_id").cast("string").alias("task_id"), F.lit("").alias("prompt"),
        F.when(kind == 3, F.concat(p[at], F.lit(" not there"))).otherwise(p[at]).alias("ground_truth"),
        F.array(F.lit("repo"), F.concat(F.lit("d"), (F.col("doc_id") % 4).cast("string")), F.concat(F.lit("f"), F.when(F.col("doc_id") % 9 == 0, F.lit("none")).otherwise(F.col("doc_id").cast("string")), F.lit(".java"))).alias("fpath_tuple"),
        F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") % 5 == 1, at).when(F.col("doc_id") % 5 == 2, at + 1).otherwise(at + 30).cast("int").alias("line_no"),
    )
    return records, lines


_MATCH = """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS p, doc_id % 5 AS k FROM documents),
r AS (SELECT doc_id, p, (len(p) // 2) AS at, CASE WHEN doc_id % 6 = 3 THEN p[len(p) // 2 + 1] || ' not there' ELSE p[len(p) // 2 + 1] END AS gt,
  CASE WHEN k = 0 THEN NULL WHEN k = 1 THEN len(p) // 2 WHEN k = 2 THEN len(p) // 2 + 1 ELSE len(p) // 2 + 30 END AS line_no FROM d),
h AS (SELECT doc_id, line_no, unnest(range(len(p))) AS i, unnest(p) AS line, gt FROM r),
m AS (SELECT doc_id, i, line_no, count(*) OVER (PARTITION BY doc_id) AS hits FROM h WHERE line = gt),
x AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN line_no = i THEN 0 WHEN abs(i - line_no) <= 60 THEN 1 WHEN abs(i - (line_no - 1)) <= 60 THEN 2 WHEN hits = 1 THEN 4 ELSE 9 END, abs(i - line_no), i) AS rn FROM m),
y AS (SELECT doc_id, CASE WHEN line_no = i THEN 'line_no_exact_0based' WHEN abs(i - line_no) <= 60 OR abs(i - (line_no - 1)) <= 60 THEN 'window_search' ELSE 'global_exact' END AS strategy,
  (abs(i - line_no) <= 60 OR abs(i - (line_no - 1)) <= 60 OR hits = 1) IS TRUE AS ok, i, hits FROM x WHERE rn = 1)
SELECT r.doc_id::VARCHAR AS task_id,
  CASE WHEN r.doc_id % 9 = 0 THEN 'unmatched_file' WHEN y.doc_id IS NULL THEN 'unmatched_line' WHEN ok THEN 'matched' ELSE 'unmatched_ambiguous' END AS status,
  CASE WHEN r.doc_id % 9 <> 0 AND ok THEN i::INTEGER END AS line_index,
  CASE WHEN r.doc_id % 9 <> 0 THEN strategy END AS strategy,
  CASE WHEN r.doc_id % 9 = 0 OR y.doc_id IS NULL THEN 0 WHEN NOT ok THEN 30 WHEN strategy = 'line_no_exact_0based' THEN 100 WHEN strategy = 'window_search' THEN 95 ELSE 90 END AS confidence
FROM r LEFT JOIN y USING (doc_id)
"""


@query(_MATCH)
def decontam_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items matched by path suffix and then by position, window or uniqueness."""
    records, lines = _match_inputs(spark, sf_dir)
    return matching.match_records(materialize(records, "match-records"), materialize(lines, "match-lines")).select("task_id", "status", "line_index", "strategy", "confidence")


@query()
def decontam_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search for lines that were changed a little, one of each document whose id is divisible by 50, by similarity within their file."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select(F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".java")).alias("file"), F.posexplode(F.split("text", "\n")).alias("line_index", "line"))
    p = F.split("text", "\n")
    records = docs.filter("doc_id % 50 = 0").select(F.col("doc_id").cast("string").alias("task_id"), F.lit("").alias("prompt"), F.concat(F.element_at(p, -1), F.lit(" x")).alias("ground_truth"), F.array(F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".java"))).alias("fpath_tuple"), F.lit(None).cast("int").alias("line_no"))
    return matching.match_records(materialize(records, "match-records"), materialize(lines, "match-lines"), matching.MatchOptions(fuzzy=True))


@query(f"""
WITH m AS ({_MATCH}) SELECT status, strategy, count(*) AS items FROM m GROUP BY ALL
""")
def mask_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: items by status and strategy."""
    return matching.mask_report(decontam_cascade(spark, sf_dir))


# --- comparing with a model ------------------------------------------------------------------------------------------


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole turns as ground truths, with answers that are equal, padded, doubled in blanks, or different."""
    k, text = F.col("conv_id") % 4, F.col("text")
    answer = F.when(k == 0, text).when(k == 1, F.concat(F.lit("  "), text, F.lit("  \nmore"))).when(k == 2, F.replace(text, F.lit(" "), F.lit("  "))).otherwise(F.concat(F.lit("no "), text))
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("prompt"), text.alias("completion"), answer.alias("teacher_raw"))
    return d.withColumn("latency_ms", (F.col("conv_id") % 100).cast("int")).withColumn("request_error", F.when(F.col("turn") == 5, "timeout"))


_ANSWERS = f"""
WITH a AS (SELECT conv_id, turn, string_split(text, chr(10))[1] AS gt, conv_id % 4 AS k FROM conversations),
b AS (SELECT *, CASE k WHEN 0 THEN gt WHEN 1 THEN '  ' || gt || '  ' WHEN 2 THEN replace(gt, ' ', '  ') ELSE 'no ' || gt END AS answer FROM a),
n AS (SELECT *, trim(gt, {_WS}) AS gt_t, trim(answer, {_WS}) AS an_t, regexp_replace(trim(gt, {_WS}), '\\s+', ' ', 'g') AS gt_w, regexp_replace(trim(answer, {_WS}), '\\s+', ' ', 'g') AS an_w FROM b)
"""


@query(_ANSWERS + "SELECT conv_id, turn, gt = answer AS exact, gt_t = an_t AS trimmed, gt_w = an_w AS ws_norm FROM n")
def match_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality under each normaliser."""
    d = _answers(spark, sf_dir)
    for mode in ("exact", "trimmed", "ws_norm"):
        d = modelfilter.compare(d, mode, truth="completion").withColumn(mode, F.col("equal")).drop("gt_norm", "teacher_norm", "similarity", "equal")
    return d.select("conv_id", "turn", "exact", "trimmed", "ws_norm")


@query()
def match_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P14 fuzzy: similarity of whitespace-normal texts."""
    return modelfilter.compare(_answers(spark, sf_dir), "fuzzy", 0.9, truth="completion").select("conv_id", "turn", "similarity", "equal")


@query(_ANSWERS + """
SELECT count(*) AS processed, count(*) FILTER (turn <> 5 AND gt_w = an_w) AS kept, count(*) - count(*) FILTER (turn <> 5 AND gt_w = an_w) AS rejected,
  count(*) FILTER (turn = 5) AS errors, count(*) FILTER (turn <> 5 AND gt_w = an_w) / count(*) AS keep_rate, avg(conv_id % 100) AS avg_latency_ms FROM n
""")
def filter_run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: totals of a filter run."""
    return modelfilter.run_stats(modelfilter.evaluate(_answers(spark, sf_dir)))


@query(_ANSWERS + "SELECT CASE WHEN turn = 5 THEN 'error:timeout' WHEN gt_w = an_w THEN 'passed' ELSE 'mismatch' END AS reason, count(*) AS n FROM n GROUP BY 1")
def filter_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, A10: rows by what became of them."""
    return modelfilter.reason_counts(modelfilter.evaluate(_answers(spark, sf_dir)))


@query(_ANSWERS + "SELECT conv_id, turn, CASE WHEN turn <> 5 AND gt_w = an_w THEN 'kept' ELSE 'rejected' END AS sink, gt_w AS gt_norm FROM n")
def kept_rejected_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3, M5: every row with the sink it goes to."""
    d = modelfilter.evaluate(_answers(spark, sf_dir))
    return d.select("conv_id", "turn", F.when(F.col("passed"), "kept").otherwise("rejected").alias("sink"), F.col("teacher_filter.gt_norm").alias("gt_norm"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 't' || event_id WHEN 1 THEN 'm' || event_id WHEN 2 THEN 'a' || event_id || 'b' END AS text FROM events")
def completion_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of response bodies of three shapes; none in the fourth."""
    i, k = F.col("event_id").cast("string"), F.col("event_id") % 4
    body = (
        F.when(k == 0, F.concat(F.lit('{"choices":[{"text":"t'), i, F.lit('"}]}'))).when(k == 1, F.concat(F.lit('{"choices":[{"message":{"content":"m'), i, F.lit('"}}]}')))
        .when(k == 2, F.concat(F.lit('{"choices":[{"message":{"content":[{"text":"a'), i, F.lit('"},{"text":"b"}]}}]}'))).otherwise('{"error":1}')
    )
    return table(spark, sf_dir, "events").select("event_id", modelfilter.parse_completion_column(body).alias("text"))


@query("SELECT CASE event_id % 5 WHEN 0 THEN 'blank' WHEN 1 THEN 'malformed' WHEN 2 THEN 'not_object' ELSE 'ok' END AS status, count(*) AS n, count(*) FILTER (event_id % 5 = 3) AS string_prompt FROM events GROUP BY 1")
def json_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3, F1: JSON lines by what they are, and whose prompt is a string and not a number."""
    k = F.col("event_id") % 5
    value = F.when(k == 0, "  ").when(k == 1, '{"prompt": ').when(k == 2, "[1, 2]").when(k == 3, F.concat(F.lit('{"prompt": "p", "props": '), F.col("props"), F.lit("}"))).otherwise('{"prompt": 5}')
    d = readers.parse_lines(table(spark, sf_dir, "events").select(value.alias("value")))
    typed = d.withColumn("kind", F.when(F.col("status") == "ok", readers.json_type("prompt")))
    return typed.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "STRING").alias("string_prompt"))


# --- statistics ------------------------------------------------------------------------------------------------------

_Q = ", ".join(f"round(quantile_cont(n_chars, {p}), 6) AS {n}" for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99")))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"SELECT count(*) AS count, min(n_chars) AS min, {_Q}, max(n_chars) AS max, round(avg(n_chars), 6) AS mean FROM documents")
def distribution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: exact quantiles of text lengths."""
    return _rounded(stats.distribution(table(spark, sf_dir, "documents"), "n_chars"))


@query(f"SELECT source, count(*) AS count, min(n_chars) AS min, {_Q}, max(n_chars) AS max, round(avg(n_chars), 6) AS mean FROM documents GROUP BY source")
def per_group_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: the same for each source."""
    return _rounded(stats.distribution(table(spark, sf_dir, "documents"), "n_chars", ["source"]))


@query("SELECT lang, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM documents), 6) AS share FROM documents GROUP BY lang")
def group_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: rows and percentage of each language."""
    return _rounded(stats.group_share(table(spark, sf_dir, "documents"), "lang", "doc_id"))


@query("SELECT source, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM documents), 6) AS share FROM documents GROUP BY source ORDER BY count(*) DESC, min(doc_id) LIMIT 5")
def top_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest sources."""
    return _rounded(stats.group_share(table(spark, sf_dir, "documents"), "source", "doc_id", 5))


@query("SELECT doc_id, length(text) AS chars, (length(text) - length(replace(text, chr(10), '')) + 1) AS lines FROM documents ORDER BY length(text) DESC, doc_id LIMIT 20")
def topk_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty longest texts."""
    d = table(spark, sf_dir, "documents").select("doc_id", tx.text_size(F.col("text")).alias("s")).select("doc_id", F.col("s.chars").cast("long").alias("chars"), F.col("s.lines").cast("long").alias("lines"))
    return stats.top_longest(d, "chars", "doc_id", 20)


@query("""
WITH b AS (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM documents)
SELECT least(floor((n_chars - lo) / ((hi - lo) / 60)), 59)::INTEGER AS bin, count(*) AS n FROM documents, b GROUP BY 1
""")
def histogram60(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty bins of equal width."""
    return stats.histogram(table(spark, sf_dir, "documents"), "n_chars").select("bin", "n")


@query("SELECT count(DISTINCT source) AS n_a, count(DISTINCT lang) AS n_b, count(DISTINCT source) <> count(DISTINCT lang) AS differ FROM documents")
def cardinality_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: whether two groupings have as many groups."""
    return stats.has_more_groups(table(spark, sf_dir, "documents"), "source", "lang")


@query("""
SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN lang || '_' || source ELSE lang || '/' || source || '-x' END AS project
FROM documents
""")
def project_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task's project is its path's if one spells the other."""
    lang, source, k = F.col("lang"), F.col("source"), F.col("doc_id") % 3
    task = tx.task_project(F.concat(lang, F.when(k == 1, "__").otherwise("_"), source, F.when(k == 2, "").otherwise("-x"), F.lit("/"), F.col("doc_id").cast("string")))
    path = tx.path_project(F.array(lang, F.concat(source, F.when(k == 2, "").otherwise("-x")), F.lit("src"), F.lit("A.java")))
    return table(spark, sf_dir, "documents").select("doc_id", tx.canonical_project(task, path).alias("project"))


# --- conversion ------------------------------------------------------------------------------------------------------


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of whole texts: the first half of the lines is the prefix, the others are blocks, the last line is the completion; some lack a token, some a partner marker."""
    k, lines = F.col("doc_id") % 7, F.split("text", "\n")
    half = F.floor(F.size(lines) / 2).cast("int")
    head = F.array_join(F.slice(lines, 1, half), "\n")
    block = F.concat(F.lit("<|file_sep|>"), F.array_join(F.slice(lines, half + 1, F.size(lines)), "\n"), F.lit("<|file_sep|>"))
    lead = F.when(k == 0, "").when(k == 1, block).when(k == 2, F.concat(block, F.lit("mid "), block)).when(k == 3, F.concat(block, F.lit("<|file_sep|>odd "))).otherwise(block)
    middle = F.when(k == 6, "").otherwise("<|fim_middle|>")
    prompt = F.concat(lead, F.lit("lead words here "), F.lit("<|fim_prefix|>"), head, F.lit("<|fim_suffix|>tail"), F.when(k == 5, block).otherwise(""), middle)
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("source_id"), F.when(F.col("doc_id") % 2 == 0, "train").otherwise("validation").alias("split"), prompt.alias("prompt"), F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.element_at(lines, -1)).alias("completion"))


_PROMPTS = """
WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
b AS (SELECT doc_id, l, doc_id % 7 AS k, array_to_string(l[1:len(l) // 2], chr(10)) AS head, '<|file_sep|>' || array_to_string(l[len(l) // 2 + 1:], chr(10)) || '<|file_sep|>' AS block FROM a),
p AS (SELECT doc_id AS source_id, CASE WHEN doc_id % 2 = 0 THEN 'train' ELSE 'validation' END AS split, k, head,
  CASE k WHEN 0 THEN '' WHEN 1 THEN block WHEN 2 THEN block || 'mid ' || block WHEN 3 THEN block || '<|file_sep|>odd ' ELSE block END AS lead,
  CASE k WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN 'mid ' WHEN 3 THEN '<|file_sep|>odd ' WHEN 6 THEN block ELSE '' END AS lead_stripped,
  CASE WHEN k = 5 THEN block ELSE '' END AS inner_block, CASE WHEN k = 6 THEN '' ELSE '<|fim_middle|>' END AS middle,
  CASE WHEN doc_id % 11 = 0 THEN '' ELSE l[-1] END AS completion FROM b)
"""


@query(_PROMPTS + """
SELECT source_id, lead_stripped || 'lead words here <|fim_prefix|>' || head || '<|fim_suffix|>tail' || middle AS stripped,
  CASE k WHEN 0 THEN 0 WHEN 2 THEN 2 WHEN 5 THEN 2 WHEN 6 THEN 0 ELSE 1 END AS removed, (k = 3)::INTEGER AS unmatched FROM p
""")
def strip_filesep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Separator blocks taken out where no token is lost."""
    d = _prompts(spark, sf_dir).withColumn("s", convert.strip_blocks(F.col("prompt")))
    return d.select("source_id", F.col("s.text").alias("stripped"), F.col("s.removed").alias("removed"), F.col("s.unmatched").alias("unmatched"))


CONVERT = convert.ConvertOptions(max_length=500)


def _converted(spark: SparkSession, sf_dir: str, conflict: str = "keep_one") -> DataFrame:
    import dataclasses

    return convert.convert(_prompts(spark, sf_dir), dataclasses.replace(CONVERT, conflict=conflict))


_TOK = r"len(regexp_extract_all({0}, '<\|[a-z_]+\|>|\s+|[A-Za-z0-9_]+|[^\sA-Za-z0-9_]'))"
_PLAIN = "lead_stripped || 'lead words here <|fim_prefix|>' || head || '<|fim_suffix|>tail' || middle"
_RAG = "lead || 'lead words here <|fim_prefix|>' || head || '<|fim_suffix|>tail' || inner_block || middle"
_BARE = "'lead words here <|fim_prefix|>' || head || '<|fim_suffix|>tail' || inner_block || middle"
_CONVERTED = _PROMPTS + f""", v AS (
  SELECT source_id, split, k, completion, 'norag' AS variant, {_PLAIN} AS base, {_PLAIN} AS cut FROM p
  UNION ALL SELECT source_id, split, k, completion, 'rag', {_RAG}, lead_stripped || {_BARE} FROM p
), t AS (
  SELECT *, {_TOK.format('completion')} AS c, {_TOK.format('base')} AS n, {_TOK.format('cut')} AS m, {_TOK.format("string_split(cut, '<|fim_prefix|>')[1]")} AS before FROM v
), r AS (
  SELECT *, 500 - c - 1 AS budget, CASE
    WHEN c < 1 THEN 'min_completion_tokens'
    WHEN variant = 'norag' AND k = 6 THEN 'fim_tokens_lost_after_strip'
    WHEN 500 - c - 1 <= 0 THEN 'completion_too_long'
    WHEN k = 6 THEN 'fim_tokens_lost_after_truncation'
    WHEN n <= 500 - c - 1 THEN NULL
    WHEN m - (500 - c - 1) > before THEN 'budget_too_small_for_fim' END AS drop_reason FROM t
)
"""


@query(_CONVERTED + "SELECT source_id, variant, drop_reason, source_id || '::' || variant AS variant_id, CASE WHEN drop_reason IS NULL THEN CASE WHEN n <= budget THEN n ELSE least(m, budget) END END AS tokens_after FROM r")
def variant_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both variants of each prompt with their fate under a budget of 500 tokens."""
    d = _converted(spark, sf_dir)
    return d.select("source_id", "variant", "drop_reason", "variant_id", F.when(F.col("drop_reason").isNull(), F.col("tokens_after")).alias("tokens_after"))


@query(_CONVERTED + ", o AS (SELECT source_id, count(*) FILTER (drop_reason IS NULL) AS e FROM r GROUP BY source_id) SELECT r.source_id, variant, CASE WHEN drop_reason IS NULL AND e < 2 THEN 'both_mode_conflict_skip' ELSE drop_reason END AS drop_reason, CASE WHEN e < 2 THEN 0 ELSE e END AS emitted FROM r JOIN o USING (source_id)")
def conflict_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivors whose partner failed are dropped under `skip`."""
    return _converted(spark, sf_dir, "skip").select("source_id", "variant", "drop_reason", "emitted")


@query(_CONVERTED + ", o AS (SELECT source_id, count(*) FILTER (drop_reason IS NULL) AS emitted FROM r GROUP BY source_id) SELECT emitted, count(*) AS sources FROM o GROUP BY emitted")
def emission_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by the number of variants emitted."""
    return convert.emission_tally(_converted(spark, sf_dir))


@query(_CONVERTED + "SELECT split, variant, drop_reason, count(*) AS n FROM r WHERE drop_reason IS NOT NULL GROUP BY GROUPING SETS ((split, variant, drop_reason), (variant, drop_reason))")
def drop_ledger_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons by variant and split, with totals."""
    return convert.drop_ledger(_converted(spark, sf_dir))


@query(_CONVERTED + "SELECT split, count(*) AS total_seen, count(*) FILTER (drop_reason IS NULL) AS kept, max(n) AS max_tokens_before, round(sum(n) / count(*), 6) AS avg_tokens_before FROM r GROUP BY GROUPING SETS ((split), ())")
def split_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of splits and of all."""
    d = convert.split_stats(_converted(spark, sf_dir))
    return _rounded(d.select("split", "total_seen", "kept", "max_tokens_before", "avg_tokens_before"))


@query(_PROMPTS + "SELECT count(*) AS loaded, 0 AS dropped_missing, count(*) FILTER (k = 6) AS dropped_fim, count(*) FILTER (k <> 6) AS kept, count(*) FILTER (k <> 6 AND k <> 0) AS file_sep, round(count(*) FILTER (k <> 6 AND k <> 0) * 100.0 / count(*) FILTER (k <> 6), 6) AS file_sep_percent FROM p")
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a loader keeps."""
    return _rounded(stats.dataset_summary(_prompts(spark, sf_dir)))


# --- tensors ---------------------------------------------------------------------------------------------------------


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of whole turns: of the words for the prompt, of the lines for the completion; every fourth turn has no completion."""
    words = F.transform(F.split("text", " "), lambda x: F.length(x))
    lines = F.transform(F.split("text", "\n"), lambda x: F.length(x) + 100)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("prompt_ids"), F.when(F.col("turn") % 4 == 3, F.array().cast("array<int>")).otherwise(lines).alias("completion_ids"))


_LABELS = """
WITH i AS (SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda x: length(x)) AS pi, CASE WHEN turn % 4 = 3 THEN [] ELSE list_transform(string_split(text, chr(10)), lambda x: length(x) + 100) END AS ci FROM conversations),
a AS (SELECT *, len(pi) AS p, len(ci) AS c FROM i),
b AS (SELECT *, greatest(0, p + c + 1 - 48) AS over FROM a), d AS (SELECT *, least(over, p) AS fp, greatest(0, c - (over - least(over, p))) AS kc FROM b),
e AS (SELECT conv_id, turn, list_concat(pi[fp + 1:], ci[1:kc], [7]) AS input_ids, list_concat(list_transform(pi[fp + 1:], lambda x: -100), ci[1:kc], [7]) AS labels FROM d WHERE kc > 0)
"""


@query(_LABELS + "SELECT conv_id, turn, array_to_string(input_ids, ',') AS input_ids, array_to_string(labels, ',') AS labels, len(input_ids) AS n_mask FROM e")
def label_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut ids with their masked labels."""
    d = tensors.label_rows(_ids(spark, sf_dir), 48, 7)
    return d.select("conv_id", "turn", F.array_join("input_ids", ",").alias("input_ids"), F.array_join("labels", ",").alias("labels"), F.size("attention_mask").cast("long").alias("n_mask"))


@query(_LABELS + """, g AS (SELECT *, (conv_id // 4) AS batch FROM e), h AS (SELECT *, max(len(input_ids)) OVER (PARTITION BY batch) AS m FROM g)
SELECT conv_id, turn, batch, array_to_string(list_concat(input_ids, list_transform(range(m - len(input_ids)), lambda x: 0)), ',') AS input_ids, array_to_string(list_concat(labels, list_transform(range(m - len(labels)), lambda x: -100)), ',') AS labels FROM h
""")
def collate_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of four conversations, padded to their longest row."""
    d = tensors.pad_batches(tensors.label_rows(_ids(spark, sf_dir), 48, 7), "conv_id", 4, 0)
    return d.select("conv_id", "turn", "batch", F.array_join("input_ids", ",").alias("input_ids"), F.array_join("labels", ",").alias("labels"))


# --- statement repair ------------------------------------------------------------------------------------------------


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of code made of line items: calls with two plain arguments, nested calls, none, and lines that call nothing."""
    o, p, k = F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"), F.col("l_orderkey") % 4
    line = (
        F.when(k == 0, F.concat(F.lit("svc.call("), o, F.lit(", "), p, F.lit(");"))).when(k == 1, F.concat(F.lit("  a.b(f("), o, F.lit(",1), \"x,("), p, F.lit("\");")))
        .when(k == 2, F.concat(F.lit("run"), o, F.lit("();"))).otherwise(F.concat(F.lit("if ("), o, F.lit(" > "), p, F.lit(") {")))
    )
    return spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")).select((F.col("l_orderkey") % 97).cast("string").alias("file"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_index"), line.alias("line"))


_ITEMS = "SELECT (l_orderkey % 97)::VARCHAR AS file, l_orderkey * 10 + l_linenumber AS line_index, l_orderkey AS o, l_partkey AS p, l_orderkey % 4 AS k FROM lineitem"


@query(f"""
SELECT file, line_index, CASE k WHEN 0 THEN o || '|' || p WHEN 1 THEN 'f(' || o || ',1)|"x,(' || p || '"' ELSE '' END AS args, CASE k WHEN 0 THEN 2 WHEN 1 THEN 2 ELSE 0 END AS n_args FROM ({_ITEMS}) WHERE k < 3
""")
def codefix_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments of call statements."""
    d = codefix.statements(_statements(spark, sf_dir))
    return d.select("file", "line_index", F.array_join("call.args", "|").alias("args"), F.size("call.args").alias("n_args"))


@query(f"""
SELECT file || '::' || line_index || '::swap_args' AS id, CASE k WHEN 0 THEN 'svc.call(' || p || ', ' || o || ');' ELSE '  a.b("x,(' || p || '", f(' || o || ',1));' END AS broken_line,
  'argument order mismatch in method invocation' AS problem FROM ({_ITEMS}) WHERE k < 2 AND (k = 1 OR o <> p)
""")
def codefix_mutate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Swapped arguments, which two arguments allow in one way only."""
    d = codefix.candidates(codefix.statements(_statements(spark, sf_dir)), mutations=["swap_args"])
    return d.select("id", "broken_line", F.col("compiler_problems")[0].alias("problem"))


@query(f"""
WITH c AS (
  SELECT file, line_index, 'swap_args' AS mutation_type FROM ({_ITEMS}) WHERE k < 2 AND (k = 1 OR o <> p)
  UNION ALL SELECT file, line_index, 'missing_arg' FROM ({_ITEMS}) WHERE k < 2 UNION ALL SELECT file, line_index, 'extra_arg' FROM ({_ITEMS}) WHERE k < 2
), r AS (SELECT *, row_number() OVER (PARTITION BY mutation_type ORDER BY md5('42|' || file || '|' || line_index), file, line_index) AS n FROM c)
SELECT mutation_type, file, line_index FROM r WHERE n <= CASE WHEN mutation_type = 'swap_args' THEN 34 ELSE 33 END
""")
def codefix_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred candidates by equal quotas."""
    pool = materialize(codefix.candidates(codefix.statements(_statements(spark, sf_dir))).select("mutation_type", "file", "line_index"), "codefix-quota")
    return samples.stratified_quota(pool, "mutation_type", list(codefix.MUTATIONS), 100, ["file", "line_index"])


@query()
def exact_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many candidates as the job's default, 100 of them for validation, no file in both."""
    pool = materialize(codefix.candidates(codefix.statements(_statements(spark, sf_dir))), "codefix-pool")
    return codefix.exact_split(pool, 5000, 100).select("id", "file", "mutation_type", "split")


@query()
def codefix_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search for similar statements among all, for the candidates of every line whose order's number is divisible by 50."""
    parsed = materialize(codefix.statements(_statements(spark, sf_dir)), "codefix-statements")
    chosen = materialize(codefix.candidates(parsed.filter("floor(line_index / 10) % 50 = 0")).dropDuplicates(["id"]), "codefix-chosen")
    hints = codefix.augmentations(chosen, parsed.select("file", "line_index", "text"))
    return codefix.records(chosen.join(hints, "id")).select("id", "prompt", "completion", "augmentations")


@query("""
SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || chr(10) || '<|im_end|>' || chr(10), '' ORDER BY turn) || '<|im_start|>assistant' || chr(10) AS prompt
FROM conversations GROUP BY conv_id
""")
def chat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P25: conversations in chat markup."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(ordered.alias("m")).select("conv_id", codefix.chat_prompt(F.col("m")).alias("prompt"))


# --- streaming -------------------------------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: hourly counts by a stream with a watermark, drained."""
    d = streaming.run_once(spark, sf_dir, "events", streaming.windowed_counts)
    return d.withColumn("total", F.round("total", 4))
