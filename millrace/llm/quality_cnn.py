"""A quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, filters of WIDTH bytes slide over overlapping chunks that cover the whole text, each filter is
max-pooled within a chunk, a hidden layer reads each chunk's pooled values, and the mean and the maximum over all chunks
meet in one logistic unit. A whole text is one chunk more for every STEP bytes, so cost is in proportion to its length.
Filters move by STRIDE bytes; STEP is odd, so the chunks of a text take all places modulo STRIDE in turn.
The network is trained on the driver from a bounded sample of labelled rows and sent to the tasks as a few kilobytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import read, windows

EMBED, WIDTH, STRIDE, FILTERS, HIDDEN = 8, 8, 4, 32, 16
#: Bytes of a chunk and from one chunk to the next.
CHUNK, STEP = 512, 481
#: The training sample: labelled rows, at most; a text of over WINDOWS * WINDOW characters gives that many windows, drawn
#: over the whole of it. A step of training draws up to TRAIN_CHUNKS chunks of each text.
TRAIN_ROWS, TRAIN_CHUNKS = 4000, 6
WINDOWS, WINDOW = 12, 2048
STEPS, BATCH, RATE = 1800, 48, 0.004
THRESHOLD = 0.3
#: Chunks that are convolved at once.
AT_ONCE = 512
FOLDS = 5


@dataclass
class Network:
    """Weights; embed has a last row for padding, which stays zero."""

    w: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int = 17) -> Network:
        rng = np.random.default_rng(seed)

        def normal(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        embed = normal(257, EMBED, scale=0.5)
        embed[256] = 0
        return cls({
            "embed": embed, "conv": normal(WIDTH * EMBED, FILTERS, scale=0.3), "conv_b": np.zeros(FILTERS, np.float32),
            "hid": normal(FILTERS + 1, HIDDEN, scale=0.25), "hid_b": np.zeros(HIDDEN, np.float32), "out": normal(2 * HIDDEN, scale=0.2), "out_b": np.zeros(1, np.float32),
        })

    def pooled(self, chunks: np.ndarray, grad: bool = False):
        """chunks: (n, CHUNK) of byte values, 256 where there is none. Each filter's maximum, at least 0, and the share that is filled."""
        n = len(chunks)
        x = self.w["embed"][chunks].reshape(n, CHUNK * EMBED)
        spots = (CHUNK - WIDTH) // STRIDE + 1
        view = np.lib.stride_tricks.as_strided(x, (n, spots, WIDTH * EMBED), (x.strides[0], STRIDE * EMBED * x.itemsize, x.itemsize))
        flat = np.ascontiguousarray(view).reshape(n * spots, WIDTH * EMBED)
        z = (flat @ self.w["conv"]).reshape(n, spots, FILTERS)
        full = ((chunks != 256).mean(axis=1, dtype=np.float32))[:, None]
        if not grad:
            return np.concatenate([np.maximum(z.max(axis=1) + self.w["conv_b"], 0), full], axis=1)
        best = z.argmax(axis=1)
        top = np.take_along_axis(z, best[:, None, :], 1)[:, 0] + self.w["conv_b"]
        return np.concatenate([np.maximum(top, 0), full], axis=1), top, best, flat.reshape(n, spots, -1)

    def hidden(self, pooled: np.ndarray) -> np.ndarray:
        return np.tanh(pooled @ self.w["hid"] + self.w["hid_b"])

    def logit(self, mean: np.ndarray, top: np.ndarray) -> np.ndarray:
        return np.concatenate([mean, top], axis=1) @ self.w["out"] + self.w["out_b"][0]

    def step(self, chunks: np.ndarray, owner: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients for a batch; owner: the document of each chunk, in order."""
        w, docs = self.w, len(labels)
        pooled, top, best, flat = self.pooled(chunks, grad=True)
        h = self.hidden(pooled)
        counts = np.bincount(owner, minlength=docs).astype(np.float32)[:, None]
        mean, most = np.zeros((docs, HIDDEN), h.dtype), np.full((docs, HIDDEN), -2, h.dtype)
        np.add.at(mean, owner, h)
        mean /= counts
        np.maximum.at(most, owner, h)
        p = 1 / (1 + np.exp(-self.logit(mean, most)))
        loss = -np.mean(labels * np.log(p + 1e-7) + (1 - labels) * np.log(1 - p + 1e-7))
        d = ((p - labels) / docs).astype(np.float32)
        g = {"out": np.concatenate([mean, most], axis=1).T @ d, "out_b": np.array([d.sum()], np.float32)}
        dh = (d[:, None] * w["out"][:HIDDEN] / counts)[owner] + (d[:, None] * w["out"][HIDDEN:])[owner] * (h == most[owner])
        dz = dh * (1 - h * h)
        g |= {"hid": pooled.T @ dz, "hid_b": dz.sum(axis=0)}
        dtop = (dz @ w["hid"].T)[:, :FILTERS] * (top > 0)
        g["conv_b"] = dtop.sum(axis=0)
        seen = flat[np.arange(len(chunks))[:, None], best]  # (chunk, filter, WIDTH * EMBED)
        g["conv"] = np.einsum("nf,nfk->kf", dtop, seen)
        back = (dtop[:, :, None] * w["conv"].T[None]).reshape(-1, EMBED)
        spot = best[:, :, None] * STRIDE + np.arange(WIDTH)
        rows = chunks[np.arange(len(chunks))[:, None, None], spot].reshape(-1)
        g["embed"] = np.stack([np.bincount(rows, back[:, e], minlength=257) for e in range(EMBED)], axis=1).astype(np.float32)
        g["embed"][256] = 0
        return float(loss), g


def to_chunks(raw: bytes | memoryview) -> np.ndarray:
    """Overlapping chunks that cover all bytes; an empty text is one empty chunk."""
    n = 1 + max(0, -(-(len(raw) - CHUNK) // STEP))
    padded = np.full((n - 1) * STEP + CHUNK, 256, dtype=np.int16)
    padded[: len(raw)] = np.frombuffer(raw, dtype=np.uint8)
    return np.lib.stride_tricks.as_strided(padded, (n, CHUNK), (STEP * 2, 2))


def train(texts: list[bytes], labels: np.ndarray, seed: int = 17) -> Network:
    """Adam on the log loss, with a falling rate; the order of rows and the weights come from the seed."""
    net, rng = Network.fresh(seed), np.random.default_rng(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.w.items()}
    every = [to_chunks(t) for t in texts]
    steps, epochs = 0, max(8, -(-STEPS // -(-len(texts) // BATCH)))
    total = epochs * -(-len(texts) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for start in range(0, len(order), BATCH):
            part, chosen = order[start : start + BATCH], []
            for i in part:
                c = every[i]
                chosen.append(c if len(c) <= TRAIN_CHUNKS else c[np.sort(rng.choice(len(c), TRAIN_CHUNKS, replace=False))])
            owner = np.repeat(np.arange(len(part)), [len(c) for c in chosen])
            _, grads = net.step(np.concatenate(chosen), owner, labels[part].astype(np.float32))
            steps += 1
            rate = RATE * min(1, 2 * (1 - steps / (total + 1)))
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                net.w[k] -= (rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.99**steps)) + 1e-7)).astype(np.float32)
    return net


def score_texts(net: Network, texts: list[bytes]) -> np.ndarray:
    """One probability for each whole text; chunks of many texts are convolved together, long texts piece by piece."""
    counts = np.array([1 + max(0, -(-(len(t) - CHUNK) // STEP)) for t in texts])
    mean, most = np.zeros((len(texts), HIDDEN), np.float64), np.full((len(texts), HIDDEN), -2, np.float32)
    held: list[tuple[int, np.ndarray]] = []
    room = 0

    def flush() -> None:
        chunks = np.concatenate([c for _, c in held])
        owner = np.repeat([i for i, _ in held], [len(c) for _, c in held])
        h = net.hidden(net.pooled(chunks))
        firsts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        mean[owner[firsts]] += np.add.reduceat(h, firsts, axis=0)
        most[owner[firsts]] = np.maximum(most[owner[firsts]], np.maximum.reduceat(h, firsts, axis=0))
        held.clear()

    for i, raw in enumerate(texts):
        chunks = to_chunks(raw)
        for start in range(0, len(chunks), AT_ONCE):
            held.append((i, chunks[start : start + AT_ONCE]))
            room += len(held[-1][1])
            if room >= AT_ONCE:
                flush()
                room = 0
    if held:
        flush()
    return 1 / (1 + np.exp(-np.clip(net.logit((mean / counts[:, None]).astype(np.float32), most), -30, 30))) if len(texts) else np.zeros(0)


def held_out(id_col: Column, folds: int = FOLDS, fold: int = 0) -> Column:
    """The fold that training never sees, by crc32 of the id as text; a null id is held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % folds == fold, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text") -> Network | None:
    """Trains on labelled rows outside the held-out fold: all of them, or the TRAIN_ROWS with the least hash of the id; rows of one id count once."""
    known = labels.filter(F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(TRAIN_ROWS)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")
    drawn = rows.select("id", "label", windows(F.col("text"), F.col("id"), WINDOWS, WINDOW).alias("text"))
    got = drawn.groupBy("id", "label").agg(F.min("text").alias("text")).toPandas().sort_values("id")  # TRAIN_ROWS rows at most; of repeated ids the least text
    y = got["label"].to_numpy().astype(np.float32)
    if not len(y) or y.min() == y.max():
        return None
    return train([(t or "").encode() for t in got["text"]], y)


def _scorer(net: Network):
    """The network as a column function over Arrow buffers: texts are not copied into Python strings."""

    def run(column: pa.Array) -> pa.Array:
        raw = pc.fill_null(column, "").cast(pa.large_binary())
        return pa.array(score_texts(net, [memoryview(x.as_buffer()) for x in raw]).astype(np.float64))

    return F.arrow_udf(run, "double")


def classify(docs: DataFrame, net: Network | None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", prior: float = 0.5) -> DataFrame:
    """One row per input row: id, held_out, score, predicted.

    Null and empty texts are scored as one empty chunk. Rows are independent, so repeated rows score alike; extra columns
    are not read and an empty table gives no rows. Without a network (labels missing or all the same) every score is the
    prior.
    """

    score = F.lit(float(prior)) if net is None else _scorer(net)(F.col(text_col))
    scored = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), score.alias("score"))
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, net: Network | None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs that score at least the threshold, all columns kept; all of them without a network."""
    if net is None:
        return docs

    return docs.filter(_scorer(net)(F.col(text_col)) >= threshold)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return classify(docs, fit(docs, read(spark, sf_dir, "labels"), "quality"))
