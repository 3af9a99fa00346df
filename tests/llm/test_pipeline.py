import re

import corpus_pipeline
import tiktoken
from pyspark.sql import functions as F

from millrace.llm import byte_bpe, quality_cnn
from tests.llm.test_dart_minhash import brute_classes
from tests.llm.test_small_cases import LOW, brute_hits


def plain(spark, sf, rows):
    """(after each stage, ids in order) by plain Python, with the network that the stage trains."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    net = quality_cnn.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), "quality")
    scores = quality_cnn.score_texts(net, [(t or "").encode() for _, t in rows])
    out = [[r for r, s in zip(rows, scores, strict=True) if s >= 0.3]]
    last = {}
    for i, t in sorted(out[-1], key=lambda r: r[0]):
        last[(t or "").translate(LOW)] = i
    out.append([r for r in out[-1] if r[0] in set(last.values())])
    classes = brute_classes(out[-1])
    out.append([r for r, g in zip(out[-1], classes, strict=True) if r[0] == max(out[-1][i][0] for i in g)])
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    long = {tuple(w[i : i + 13]) for _, t in bench for w in [re.findall(r"\w+", t.lower())] for i in range(len(w) - 12)}
    assert long
    out.append([r for r in out[-1] if not brute_hits(r[1], bench)[-1]])
    return out


def test_pipeline_against_plain_version(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    want = plain(spark, sf, rows)
    docs = table
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        out = stage(spark, docs, sf)
        assert out.columns == table.columns
        path = str(tmp_path / name.replace(" ", "_"))
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        assert sorted(r.doc_id for r in docs.collect()) == sorted(i for i, _ in expected), name
    got = corpus_pipeline.run(spark, sf).collect()
    ranks, pattern = byte_bpe.tokenizer()
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.Ranks.load(ranks, pattern).ids, special_tokens={})
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(other.encode_ordinary(t)) for i, t in want[-1]}


def test_stages_with_nulls_repeats_and_no_rows(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(1, "A text", "en"), (1, "A text", "en"), (2, "a TEXT", None), (None, None, None), (None, "", "de"), (3, " ".join(f"w{i}" for i in range(80)), "fr"), (4, " ".join(f"w{i}" for i in range(81)), "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(c) for c in ("rid", "row", "kept", "__sha", "__text", "sha", "id", "score", "n_tokens")})
    scored = {r.doc_id: r.score for r in quality_cnn.classify(docs, quality_cnn.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), "quality")).collect()}
    good = corpus_pipeline.quality(spark, docs, sf)
    assert good.columns == docs.columns and sorted(r.doc_id or 0 for r in good.collect()) == sorted(i or 0 for i, _, _ in rows if scored[i] >= 0.3)
    coded = corpus_pipeline.encode(spark, docs, sf).collect()
    assert sorted((r.doc_id or 0, r.n_tokens > 0) for r in coded) == sorted((i or 0, bool(t)) for i, t, _ in rows)
    assert corpus_pipeline.quality(spark, docs.limit(0), sf).count() == corpus_pipeline.encode(spark, docs.limit(0), sf).count() == 0
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and all(r["__text"] == "__text" and r.sha == "sha" for r in out.collect()), name
        ids = sorted((r.doc_id or 0, r.text or "") for r in out.collect())
        assert ids == {"exact dedup": [(0, ""), (2, "a TEXT"), (3, rows[5][1]), (4, rows[6][1])], "MinHash near-dedup": [(0, ""), (0, ""), (2, "a TEXT"), (4, rows[6][1])]}.get(name, sorted((i or 0, t or "") for i, t, _ in rows))
        assert stage(spark, docs.limit(0), sf).count() == 0
