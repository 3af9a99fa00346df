import subprocess
import sys
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import crf_langid as c


def toy(seed=0, size=3):
    rng = np.random.default_rng(seed)
    move, start = rng.normal(size=(size, size)), rng.normal(size=size)
    return c.Field([f"l{i}" for i in range(size)], rng.normal(size=(c.BUCKETS, size)).astype(np.float32), {}, np.ones(size, np.float32), move - c._log_sum(move), start - c._log_sum(start[None])[0])


def plain_marginals(field, scores):
    move, start, f = np.exp(field.move), np.exp(field.start), np.exp(scores)
    alpha, beta = [start * f[0]], [np.ones(len(start))]
    for x in f[1:]:
        a = (alpha[-1] @ move) * x
        alpha.append(a / a.sum())
    for x in f[:0:-1]:
        b = move @ (beta[-1] * x)
        beta.append(b / b.sum())
    out = np.array(alpha) * np.array(beta[::-1])
    return out / out.sum(axis=1, keepdims=True)


def test_segments_carry_messages_exactly(monkeypatch):
    field, rng = toy(), np.random.default_rng(1)
    counts = np.array([1, 7, 0, 8, 9, 50, 3, 17])
    scores = rng.normal(size=(counts.sum(), 3))
    want = np.concatenate([plain_marginals(field, s) for s in np.split(scores, np.cumsum(counts)[:-1]) if len(s)])
    for segment in (4, 8, 128):
        monkeypatch.setattr(c, "SEGMENT", segment)
        assert np.allclose(c.posteriors(field, scores, counts), want, atol=1e-9)


def test_expected_counts_are_the_gradient():
    field, rng = toy(2), np.random.default_rng(3)
    scores = rng.normal(size=(1, 6, 3))
    gamma, pair = c._expected(np.exp(scores), np.exp(field.move), np.exp(field.start))
    assert np.allclose(gamma[0], plain_marginals(field, scores[0]))

    def log_z(move):
        a = np.exp(field.start) * np.exp(scores[0, 0])
        for t in range(1, 6):
            a = (a @ np.exp(move)) * np.exp(scores[0, t])
        return np.log(a.sum())

    for i in range(3):
        for j in range(3):
            up, down = field.move.copy(), field.move.copy()
            up[i, j] += 1e-5
            down[i, j] -= 1e-5
            assert abs((log_z(up) - log_z(down)) / 2e-5 - pair[i, j]) < 1e-6


def test_grams_are_those_of_marked_words():
    who, what = c.grams(["ab", "x", "ab"])
    assert [int((who == i).sum()) for i in range(3)] == [10, 6, 10]
    assert sorted(what[who == 0]) == sorted(what[who == 2])


def test_held_out_accuracy_and_code_switching(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = c.op1_crf_langid(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    held = got[got.held_out & got.lang.notna()]
    assert (held.lang_pred == held.lang).mean() > 0.97
    field = c.fit(docs)
    parts = {r.lang: r.text for r in docs.filter("n_chars > 600").groupBy("lang").agg(F.min("text").alias("text")).collect()}
    mixed = " ".join(" ".join(parts[k].split()[:40]) for k in ("de", "en", "fr"))
    row = c.identify(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), field, spans=True).first()
    long = [s.lang for s in row.spans if s.words > 20]
    assert long == ["de", "en", "fr"]


def test_edges(spark):
    rows = [(1, "the cat", "en"), (2, None, "en"), (3, "12 !?", None), (4, "", "fr"), (None, "le chat", "fr"), (5, "le chat " * 60_000, "fr"), (1, "the cat", "en"), (6, "the dog", "en"), (7, "le chien", "fr"), (8, "퟿𝒳 日本", None), (9, "½ ² ⅷ Ⅻ", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({k: F.lit(0) for k in ("id", "score", "held_out", "place", "n")})
    got = c.identify(docs, c.fit(docs), spans=True).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and (r.lang_pred == c.UNKNOWN) == (r.doc_id in (2, 3, 4, 9))
    none = c.fit(docs.limit(0))
    assert {r.lang_pred for r in c.identify(docs, none).collect()} == {c.UNKNOWN}
    one = c.fit(docs.filter("lang = 'en'"))
    assert {r.lang_pred for r in c.identify(docs, one).collect()} == {c.UNKNOWN, "en"}
    assert c.identify(docs.limit(0), one).count() == 0


def test_marks_belong_to_words_and_numbers_do_not():
    assert c.tokens("हिन्दी में ½² Ⅷ x_9y Ünï e\u0301") == ["हिन्दी", "में", "x", "y", "ünï", "e\u0301"]


def test_slices_do_not_change_scores(monkeypatch):
    words = ["a", "bc" * 40, "def", "g" * 7, "hi"] * 9
    field = toy()
    whole, (who, what) = field.emissions(words), c.grams(words)
    for size in (1, 3, 50):
        monkeypatch.setattr(c, "GRAM_CHARS", size)
        assert np.allclose(field.emissions(words), whole, atol=1e-5)
        other = c.grams(words)
        assert (other[0] == who).all() and sorted(zip(*other)) == sorted(zip(who, what))


def test_a_word_of_20_megabytes_in_bounded_memory():
    code = """
import random, resource, time
from tests.llm.test_crf import c, toy
labeller = c.Labeller(toy())
text = "".join(random.Random(1).choices("abcdefgh", k=20_000_000)) + " end " * 1000
before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
(words, gamma), = labeller.label([text])
assert len(words) == 1001 and abs(gamma.sum() - 1001) < 1e-6
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024, time.time() - began)
"""
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2]).stdout.split()
    assert int(got[0]) < 600 and float(got[1]) < 60, got


def test_the_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(c, "PER_LANGUAGE", 20), monkeypatch.setattr(c, "LANGUAGES", 3)
    seen = {}
    monkeypatch.setattr(c, "train", lambda texts, langs: seen.update(texts=texts, langs=langs))
    rows = [(1, f"t{i % 3}", f"l{i % 2}") for i in range(300)] + [(i, "x " * 9000 + str(i), f"l{i % 4}") for i in range(400)] + [(i, "rare", f"r{i}") for i in range(50)]
    c.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(seen["langs"]) <= 60 and len(set(seen["langs"])) == 3 and max(map(len, seen["texts"])) <= c.WINDOWS * (c.WINDOW + 1)
