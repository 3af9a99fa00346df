"""Language identification by a linear-chain conditional random field over words.

A word's emission scores come from hashed character n-grams and affixes (n-grams that touch a word mark) and from a
lexicon of the training words; transitions between languages are learned with them by the gradient of the conditional
likelihood, which forward-backward gives. Training sequences splice stretches of documents of different languages, so
the field learns how long a stretch is in code-switched text. A prediction runs forward-backward over all words of a
text: long texts are cut into segments whose transfer matrices carry the messages exactly from one to the next.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import read, windows

#: The training sample: documents of a language and languages, at most; a text of over WINDOWS * WINDOW characters gives
#: that many windows, drawn over the whole of it. Other values of lang than the most frequent are not learned.
PER_LANGUAGE, LANGUAGES = 400, 256
WINDOWS, WINDOW = 6, 1000
#: Hashed weights of a language, longest n-gram, and steps of training.
BUCKETS, LONGEST, STEPS = 1 << 16, 4, 260
LENGTH, SEQUENCES, STRETCH = 96, 48, 20
#: Words of a segment, words that are labelled at once, and words whose scores a task remembers.
SEGMENT, AT_ONCE, MEMORY_WORDS = 128, 300_000, 500_000
#: Characters whose n-grams are made at once, and of a word that is remembered.
GRAM_CHARS, SHORT_WORD = 200_000, 100
FOLDS, HELD = 4, 2
UNKNOWN = "und"

_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
U = np.uint64


def tokens(text: str | None) -> list[str]:
    """Runs of letters with their marks, lower-cased."""
    return _LETTERS.findall(text.lower()) if text else []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def gram_slices(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first word, word number from there, bucket) of all n-grams of marked words, GRAM_CHARS characters at a time; a long word goes over several slices."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    ends = np.cumsum([len(w) + 2 for w in words])
    for start in range(0, len(codes), GRAM_CHARS):
        part = codes[start : start + GRAM_CHARS + LONGEST - 1].astype(np.uint64)
        size = min(GRAM_CHARS, len(codes) - start)
        first = int(np.searchsorted(ends, start, side="right"))
        word = np.searchsorted(ends, np.arange(start, start + size), side="right")
        left = ends[word] - np.arange(start, start + size)  # characters from here to the word's end
        owner, bucket = [], []
        acc = np.zeros(size, dtype=np.uint64)
        for n in range(1, LONGEST + 1):
            m = min(size, len(part) - n + 1)
            acc[:m] = _mix(acc[:m] * U(31) + part[n - 1 : n - 1 + m] + U(n))
            fits = left >= n
            owner.append(word[fits] - first), bucket.append((acc[fits] % U(BUCKETS)).astype(np.int64))
        yield first, np.concatenate(owner), np.concatenate(bucket)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of all n-grams of marked words, sorted by word."""
    parts = list(gram_slices(words))
    who, what = np.concatenate([w + first for first, w, _ in parts]), np.concatenate([b for _, _, b in parts])
    order = np.argsort(who, kind="stable")
    return who[order], what[order]


@dataclass
class Field:
    """languages: sorted; gram: (BUCKETS, L); lexicon: log share of each language by word; log transitions and start."""

    languages: list[str]
    gram: np.ndarray
    lexicon: dict[str, np.ndarray]
    lexicon_weight: np.ndarray
    move: np.ndarray
    start: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """Log scores (word, language)."""
        size = len(self.languages)
        if not words:
            return np.zeros((0, size), np.float32)
        out, count = np.zeros((len(words), size)), np.zeros(len(words))
        for first, who, what in gram_slices(words):
            n = int(who.max()) + 1
            count[first : first + n] += np.bincount(who, minlength=n)
            for k in range(size):
                out[first : first + n, k] += np.bincount(who, self.gram[what, k], minlength=n)
        out /= np.sqrt(count)[:, None]
        none = np.zeros(size, np.float32)
        return (out + self.lexicon_weight * np.stack([self.lexicon.get(w, none) for w in words])).astype(np.float32)


def _normal(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def marginals(emission: np.ndarray, used: np.ndarray, move: np.ndarray, enter: np.ndarray, leave: np.ndarray, fresh: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Forward-backward over segments (n, T, L) of emission factors; used: words of each.

    enter: forward message before a segment; leave: backward message behind it; fresh: segments that begin a text.
    """
    n, length, size = emission.shape
    alpha = np.zeros((length, n, size))
    now = enter
    for t in range(length):
        step = now @ move
        if t == 0:
            step = np.where(fresh[:, None], start, step)
        step = _normal(step * emission[:, t])
        now = np.where((t < used)[:, None], step, now)
        alpha[t] = now
    beta = leave
    for t in range(length - 1, -1, -1):
        own = (t < used)[:, None]
        alpha[t] = np.where(own, _normal(np.maximum(alpha[t] * beta, 1e-300)), 0)
        beta = np.where(own, _normal((beta * emission[:, t]) @ move.T), beta)
    return alpha.transpose(1, 0, 2)


def transfers(emission: np.ndarray, used: np.ndarray, move: np.ndarray, fresh: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The product of a segment's steps, from a message before it to one behind, up to a factor."""
    n, length, size = emission.shape
    out = np.tile(np.eye(size), (n, 1, 1))
    for t in range(length):
        step = out @ move
        if t == 0:
            step = np.where(fresh[:, None, None], start, step)  # a message before a text sums to 1
        step = step * emission[:, t, None, :]
        step /= step.sum(axis=(1, 2), keepdims=True)
        out = np.where((t < used)[:, None, None], step, out)
    return out


def posteriors(field: Field, scores: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Marginals (word, language) of texts with `counts` words each, whose log scores stand one after the other."""
    size = len(field.languages)
    counts = counts[counts > 0]
    if not len(counts):
        return np.zeros((0, size))
    move, start = np.exp(field.move), np.exp(field.start)
    pieces = -(-counts // SEGMENT)
    text = np.repeat(np.arange(len(counts)), pieces)
    rank = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    used = np.minimum(SEGMENT, counts[text] - rank * SEGMENT)
    first = np.repeat(np.cumsum(counts) - counts, pieces) + rank * SEGMENT
    spots = first[:, None] + np.arange(SEGMENT)
    real = np.arange(SEGMENT) < used[:, None]
    factors = np.exp((scores - scores.max(axis=1, keepdims=True)).astype(np.float64))
    emission = np.where(real[:, :, None], factors[np.minimum(spots, len(scores) - 1)], 1.0)
    fresh = rank == 0
    enter, leave = np.full((len(text), size), 1 / size), np.full((len(text), size), 1 / size)
    if (long := np.flatnonzero(pieces[text] > 1)).size:
        product = transfers(emission[long], used[long], move, fresh[long], start)
        place = np.full(len(text), -1)
        place[long] = np.arange(len(long))
        for r in range(1, rank.max() + 1):
            at = np.flatnonzero(rank == r)
            enter[at] = _normal(np.einsum("ni,nij->nj", enter[at - 1], product[place[at - 1]]))
        for r in range(rank.max() - 1, -1, -1):
            at = np.flatnonzero((rank == r) & (pieces[text] > r + 1))
            leave[at] = _normal(np.einsum("nij,nj->ni", product[place[at + 1]], leave[at + 1]))
    return marginals(emission, used, move, enter, leave, fresh, start)[real]


def train(texts: list[str], languages: list[str], seed: int = 11) -> Field:
    """AdaGrad on the conditional log likelihood of spliced sequences."""
    rng = np.random.default_rng(seed)
    names = sorted(set(languages))
    size = len(names)
    vocabulary: dict[str, int] = {}
    own: list[list[np.ndarray]] = [[] for _ in names]
    share: list[np.ndarray] = []
    for text, lang in zip(texts, languages, strict=True):
        ids = []
        for w in tokens(text):
            at = vocabulary.setdefault(w, len(vocabulary))
            if at == len(share):
                share.append(np.full(size, 0.3))
            share[at][names.index(lang)] += 1
            ids.append(at)
        if ids:
            own[names.index(lang)].append(np.array(ids))
    words = list(vocabulary)
    log_share = np.log(_normal(np.array(share))) - np.log(1 / size) if words else np.zeros((0, size))
    field = Field(names, np.zeros((BUCKETS, size), np.float32), {}, np.zeros(size, np.float32), np.full((size, size), -np.log(max(1, size))), np.full(size, -np.log(max(1, size))))
    able = [k for k in range(size) if own[k]]
    if len(able) < 2:
        return field
    who, what = grams(words)
    ends = np.searchsorted(who, np.arange(len(words) + 1))
    count = np.diff(ends)
    seen = np.zeros_like(field.gram)
    move, start = np.zeros((size, size)), np.zeros(size)
    move_seen, start_seen, lex_seen = np.full((size, size), 1e-3), np.full(size, 1e-3), np.full(size, 1e-3)
    for step in range(STEPS):
        ids, tags = np.zeros((SEQUENCES, LENGTH), np.int64), np.zeros((SEQUENCES, LENGTH), np.int64)
        for i in range(SEQUENCES):
            single, at, k = rng.random() < 0.5, 0, able[rng.integers(len(able))]
            while at < LENGTH:
                source = own[k][rng.integers(len(own[k]))]
                want = LENGTH - at if single else min(LENGTH - at, 1 + rng.geometric(1 / STRETCH))
                begin = rng.integers(max(1, len(source) - want + 1))
                part = source[begin : begin + want]
                ids[i, at : at + len(part)], tags[i, at : at + len(part)] = part, k
                at += len(part)
                if not single:
                    k = able[rng.integers(len(able))]
        flat, tag = ids.reshape(-1), tags.reshape(-1)
        distinct, place = np.unique(flat, return_inverse=True)
        rows = np.concatenate([np.arange(ends[d], ends[d + 1]) for d in distinct])
        local = np.repeat(np.arange(len(distinct)), count[distinct])
        bucket, scale = what[rows], 1 / np.sqrt(count[distinct])
        emit = np.stack([np.bincount(local, field.gram[bucket, k], minlength=len(distinct)) for k in range(size)], axis=1) * scale[:, None]
        hidden = rng.random(len(distinct)) < 0.5  # words that are unknown to the lexicon, as new words will be
        lex = np.where(hidden[:, None], 0, log_share[distinct])
        emit = (emit + field.lexicon_weight * lex)[place].reshape(SEQUENCES, LENGTH, size)
        log_move, log_start = move - _log_sum(move), start - _log_sum(start[None])[0]
        factor = np.exp(emit - emit.max(axis=2, keepdims=True))
        gamma, pair = _expected(factor, np.exp(log_move), np.exp(log_start))
        truth = np.eye(size)[tags]
        d = truth - gamma
        by_word = np.stack([np.bincount(place, d.reshape(-1, size)[:, k], minlength=len(distinct)) for k in range(size)], axis=1)
        grad = np.zeros((len(bucket), size), np.float32) + (by_word * scale[:, None])[local].astype(np.float32)
        unique, slot = np.unique(bucket, return_inverse=True)
        total = np.stack([np.bincount(slot, grad[:, k], minlength=len(unique)) for k in range(size)], axis=1) - 0.02 * field.gram[unique]
        seen[unique] += total**2
        field.gram[unique] += (0.25 * total / (np.sqrt(seen[unique]) + 1e-6)).astype(np.float32)
        lex_grad = (by_word * lex).sum(axis=0)
        lex_seen += lex_grad**2
        field.lexicon_weight = (field.lexicon_weight + 0.1 * lex_grad / np.sqrt(lex_seen)).astype(np.float32)
        observed = np.zeros((size, size))
        np.add.at(observed, (tags[:, :-1].reshape(-1), tags[:, 1:].reshape(-1)), 1)
        g = observed - pair
        g -= np.exp(log_move) * g.sum(axis=1, keepdims=True)
        move_seen += g**2
        move = move + 0.3 * g / np.sqrt(move_seen)
        g0 = (truth[:, 0] - gamma[:, 0]).sum(axis=0)
        start_seen += g0**2
        start = start + 0.1 * g0 / np.sqrt(start_seen)
    field.move, field.start = move - _log_sum(move), start - _log_sum(start[None])[0]
    field.lexicon = {w: log_share[i].astype(np.float32) for w, i in vocabulary.items()}
    return field


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1, keepdims=True)
    return top + np.log(np.exp(x - top).sum(axis=1, keepdims=True))


def _expected(factor: np.ndarray, move: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of words and expected counts of transitions, by forward-backward over sequences of one length."""
    n, length, size = factor.shape
    alpha, beta = np.zeros((length, n, size)), np.ones((length, n, size)) / size
    alpha[0] = _normal(start * factor[:, 0])
    for t in range(1, length):
        alpha[t] = _normal((alpha[t - 1] @ move) * factor[:, t])
    pair = np.zeros((size, size))
    for t in range(length - 2, -1, -1):
        ahead = beta[t + 1] * factor[:, t + 1]
        beta[t] = _normal(ahead @ move.T)
        joint = alpha[t][:, :, None] * move * ahead[:, None, :]
        pair += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    gamma = _normal(alpha * beta)
    return gamma.transpose(1, 0, 2), pair


class Labeller:
    """Scores words once and labels texts."""

    def __init__(self, field: Field):
        self.field = field
        self.memory: dict[str, int] = {}
        self.long = False  # whether memory has words that are not to stay
        self.scores = np.zeros((1024, len(field.languages)), np.float32)

    def _rows(self, words: list[str]) -> np.ndarray:
        if self.long:
            self.memory.clear()
        new = list(set(words) - self.memory.keys())
        self.long = any(len(w) > SHORT_WORD for w in new)
        if len(self.memory) + len(new) > MEMORY_WORDS:
            self.memory.clear()
            new = list(set(words))
        base = len(self.memory)
        if base + len(new) > len(self.scores):
            self.scores = np.concatenate([self.scores[:base], np.zeros((len(new) + base, self.scores.shape[1]), np.float32)])
        for start in range(0, len(new), 50_000):
            part = new[start : start + 50_000]
            self.scores[base + start : base + start + len(part)] = self.field.emissions(part)
        self.memory.update(zip(new, range(base, base + len(new)), strict=True))
        return np.fromiter(map(self.memory.__getitem__, words), np.int64, len(words))

    def label(self, texts: Iterable[str | None]) -> Iterator[tuple[list[str], np.ndarray]]:
        """(words, marginals) of each text; many texts go through forward-backward together."""
        held: list[list[str]] = []
        size = 0
        for text in texts:
            held.append(tokens(text))
            size += len(held[-1])
            if size >= AT_ONCE:
                yield from self._many(held)
                held, size = [], 0
        yield from self._many(held)

    def _many(self, held: list[list[str]]) -> Iterator[tuple[list[str], np.ndarray]]:
        if not held:
            return
        flat = [w for words in held for w in words]
        counts = np.array([len(w) for w in held])
        rows = self._rows(flat)  # may replace the scores
        gamma = posteriors(self.field, self.scores[rows], counts)
        yield from zip(held, np.split(gamma, np.cumsum(counts)[:-1]), strict=True)


def held_out(id_col: Column) -> Column:
    """The fold that training never sees, by crc32 of the id as text; a null id is held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % FOLDS == HELD, F.lit(True))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Field:
    """Trains on documents outside the held-out fold: up to PER_LANGUAGE of each of the LANGUAGES most frequent values, those with the least hash of id and text."""
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(F.col("lang").isNotNull() & ~held_out(F.col("id")))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    place = F.xxhash64("id", "text").cast("double") / 2.0**64 + 0.5  # 0 to 1
    likely = known.withColumn("place", place).join(F.broadcast(counts), "lang").filter(F.col("place") <= 2.0 * PER_LANGUAGE / F.col("n"))
    drawn = likely.select("lang", "place", "id", windows(F.col("text"), F.col("place"), WINDOWS, WINDOW).alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "id", "text"))
    rows = drawn.withColumn("rank", rank).filter(F.col("rank") <= PER_LANGUAGE).orderBy("lang", "rank").toPandas()
    return train(list(rows["text"]), list(rows["lang"]))


def identify(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score; with spans=True also spans (lang, words) of like-labelled words.

    lang_pred has the largest mean marginal over all words of the text, which is the score; ties go to the first language
    in sorted order. A null text or one without letters is `und` with score 0. Rows are independent, so repeated rows are
    labelled alike; extra columns are not read and an empty table gives no rows. A field that has learned no language
    labels all `und`.
    """
    spark = docs.sparkSession
    broadcast = spark.sparkContext.broadcast(field)  # BUCKETS weights for each language and the words of the bounded sample
    names = field.languages

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(broadcast.value) if names else None  # of this task: an idle worker holds nothing
        for batch in batches:
            pred, score, runs = [], [], []
            for words, gamma in labeller.label(batch["text"]) if names else (([], None) for _ in batch["text"]):
                mean = gamma.mean(axis=0) if words else None
                pred.append(names[int(mean.argmax())] if words else UNKNOWN)
                score.append(float(min(1.0, mean.max())) if words else 0.0)
                if spans:
                    best = gamma.argmax(axis=1) if words else np.zeros(0, int)
                    cuts = [*np.flatnonzero(best[1:] != best[:-1]) + 1, len(best)]
                    runs.append([{"lang": names[best[a]], "words": int(b - a)} for a, b in zip([0, *cuts], cuts, strict=False) if b > a])
            yield pd.DataFrame({"id": batch["id"], "held_out": batch["held_out"], "lang_pred": pred, "score": score} | ({"spans": runs} if spans else {}))

    schema = f"id {dict(docs.dtypes)[id_col]}, held_out boolean, lang_pred string, score double" + ", spans array<struct<lang: string, words: int>>" * spans
    return docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text")).mapInPandas(run, schema).withColumnRenamed("id", id_col)


def op1_crf_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
