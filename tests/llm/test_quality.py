import numpy as np
from pyspark.sql import functions as F

from millrace.llm import quality_cnn as q


def test_gradients():
    rng = np.random.default_rng(1)
    net = q.Network.fresh(3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    net.w["conv_b"] += 0.05  # off the kink of empty chunks
    chunks = np.concatenate([q.to_chunks(bytes(rng.integers(0, 256, n, dtype=np.uint8))) for n in (0, 700, 90)])
    owner, y = np.array([0, 1, 1, 2]), np.array([1.0, 0.0, 1.0])
    _, g = net.step(chunks, owner, y)
    for k in ("conv", "hid", "out", "embed", "conv_b"):
        at = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        old, eps = net.w[k][at], 3e-3
        net.w[k][at] = old + eps
        up, _ = net.step(chunks, owner, y)
        net.w[k][at] = old - eps
        down, _ = net.step(chunks, owner, y)
        net.w[k][at] = old
        assert abs((up - down) / (2 * eps) - g[k][at]) < 1e-3 + 0.05 * abs(g[k][at])


def test_chunks_cover_all_bytes():
    for n in (0, 1, q.CHUNK, q.CHUNK + 1, q.CHUNK + q.STEP, 5000):
        raw = bytes(i % 251 for i in range(n))
        c = q.to_chunks(raw)
        assert len(c) == 1 + max(0, -(-(n - q.CHUNK) // q.STEP))
        seen = np.concatenate([c[0], *[x[q.CHUNK - q.STEP :] for x in c[1:]]])
        assert bytes(seen[:n].astype(np.uint8)) == raw and (seen[n:] == 256).all()


def test_slices_do_not_change_a_score(monkeypatch):
    net, rng = q.Network.fresh(5), np.random.default_rng(2)
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (0, 10, 600, 40_000, 3)]
    whole = q.score_texts(net, texts)
    monkeypatch.setattr(q, "AT_ONCE", 3)
    assert np.allclose(whole, q.score_texts(net, texts), atol=1e-5)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = q.op9_quality_classifier(spark, sf).cache()
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    known = got.filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert (known.predicted == known.quality).mean() > 0.95
    assert (known.predicted[known.quality == 0] == 0).mean() > 0.8 and (known.predicted[known.quality == 1] == 1).mean() > 0.97


def test_edges(spark):
    rows = [(1, "fine text"), (2, None), (3, ""), (None, "no id"), (4, "x" * 2_000_000), (1, "fine text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(0) for c in ("id", "score", "held_out", "label", "quality")})
    for labels in ([], [(1, 1), (2, None), (None, 0)], [(1, 1), (1, 0), (3, 0), (7, 0)]):
        net = q.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"), "quality")
        got = q.classify(docs, net).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
        assert len({r.score for r in got if r.doc_id == 1}) == 1
    assert q.classify(docs.limit(0), None).count() == 0
