"""Byte-level BPE by DuckDB recursive queries, one database in each task.

Each batch of documents is cut into pieces by the tokenizer's pattern; pieces not met before go to DuckDB, a row with the
list of its tokens each. A recursive query contracts the leftmost pair of the least rank of each list and joins the two new
pairs with the merge table, until nothing merges. So a step makes one row for a piece, not one for each token. Runs of ids
not met before are decoded by an ordered aggregation over the positions; a document's ids are its runs, one after another,
and so are its bytes. Work goes in slices of a bounded number of tokens, so memory does not grow with a text.

A contraction at a time is square in a piece's length, so a piece of more than SQL_BYTES bytes is first cut where no
token of the vocabulary can lie across, which changes nothing: no pair over such a place ever has a rank. Its parts are
then pieces of the query like others. Only parts that are still longer are contracted in arrays, by the same rule: all
occurrences of a part's least rank in one step, from the left, up to the first that makes a pair of lower rank.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import read

#: Longer pieces are cut where no token lies across; what cannot be cut so is contracted in arrays.
SQL_BYTES = 128
#: Encoded pieces that a task remembers with their ids and what these decode to, and tokens of one decoding query.
MEMORY_PIECES = 350_000
SLICE_TOKENS = 250_000
SLICE_CHARS = 1_500_000

#: The rank of a pair that does not merge: above all others.
NEVER = (1 << 21) - 1
#: A token in a list is rank << 29 | first byte << 21 | id, the rank that of the pair it begins, so that the least is the
#: leftmost pair of the least rank. A list has END before and behind its tokens, which merges with nothing.
TOKEN = (1 << 21) - 1
END = NEVER << 29 | 1 << 20
MERGE = f"""
WITH RECURSIVE step(w, l, least) AS (
  SELECT w, l, list_min(l) FROM start
  UNION ALL
  SELECT w, l, list_min(l) FROM (
    SELECT w, list_concat(l[:i - 2], [(coalesce(x.rank, {NEVER}) << 29) | (l[i - 1] & {(1 << 29) - 1}),
                                      (coalesce(y.rank, {NEVER}) << 29) | (least & {255 << 21}) | made], l[i + 2:]) AS l
    FROM (
      SELECT w, l, least, least >> 29 AS made, list_position(l, least) AS i FROM step WHERE least < {NEVER << 29}
    ) s LEFT JOIN merges x ON x.pair = ((l[i - 1] & {TOKEN}) << 21) | made LEFT JOIN merges y ON y.pair = (made << 21) | (l[i + 2] & {TOKEN})
  )
)
SELECT w, l FROM step WHERE least >= {NEVER << 29}
"""
DECODE = "SELECT string_agg(v.chars, '' ORDER BY i.p) FROM ids i JOIN vocab v USING (id)"


def _sorted(keys: list[int], values: list[int]) -> tuple[np.ndarray, np.ndarray]:
    k = np.array(keys, dtype=np.int64)
    order = np.argsort(k)
    return k[order], np.array(values, dtype=np.int32)[order]


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: int) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), missing, dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


class Ranks:
    """Tokens and their merge table: a pair merges into the token of its joined bytes, whose id is the pair's rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if max(ranks.values(), default=0) >= 1 << 20:
            raise ValueError("ids must be under 2**20: two of them make a pair's key")
        self.pattern = pattern
        self.ids = dict(ranks)
        pair, rank = [], []
        nodes: dict[bytes, int] = {b"": 0}  # of the tree of the tokens' beginnings
        edge, to = [], []
        for token, number in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pair.append(a << 20 | b), rank.append(number)
            for end in range(1, len(token) + 1):
                if (head := token[:end]) not in nodes:
                    nodes[head] = len(nodes)
                    edge.append(nodes[token[: end - 1]] << 8 | token[end - 1]), to.append(nodes[head])
        self.pair, self.rank = _sorted(pair, rank)
        self.edge, self.to = _sorted(edge, to)
        self.is_token = np.zeros(len(nodes), dtype=bool)
        self.is_token[[nodes[t] for t in ranks]] = True

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; NEVER if it does not merge."""
        return _look_up(self.pair, self.rank, (left.astype(np.int64) << 20) | right, NEVER)

    def cuts(self, raw: bytes) -> np.ndarray:
        """Places of raw that no token lies across, ends included."""
        data = np.frombuffer(raw, dtype=np.uint8)
        reach = np.arange(1, len(data) + 1)
        for start in range(0, len(data), 1 << 20):
            at = np.arange(start, min(len(data), start + (1 << 20)))
            node, n = np.zeros(len(at), dtype=np.int64), 0
            while len(at):
                node = _look_up(self.edge, self.to, (node << 8) | data[at + n], -1)
                n += 1
                found = self.is_token[node] & (node >= 0)
                reach[at[found]] = at[found] + n
                alive = (node >= 0) & (at + n < len(data))
                at, node = at[alive], node[alive]
        far = np.maximum.accumulate(reach)
        return np.r_[0, np.flatnonzero(far == np.arange(1, len(data) + 1)) + 1]

    @classmethod
    def load(cls, path: str, pattern: str) -> Ranks:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)


class Coder:
    """Encodes and decodes with an in-memory DuckDB."""

    def __init__(self, ranks: Ranks):
        self.ranks = ranks
        self.find = regex.compile(ranks.pattern)
        self.memory: dict[str, tuple[bytes, bytes]] = {}  # a piece's ids, and what these decode to
        self.again: set[str] = set()  # pieces that more than one slice had
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "250MB", "temp_directory": ""})
        self._table("merges", {"pair": (ranks.pair >> 20 << 21) | (ranks.pair & ((1 << 20) - 1)), "rank": ranks.rank.astype(np.int64)})
        tokens = list(ranks.ids)
        self._table("vocab", {"id": np.array(list(ranks.ids.values()), dtype=np.int32), "chars": pa.array([t.decode("latin-1") for t in tokens])})
        self.lengths = np.zeros(max(ranks.ids.values()) + 1, dtype=np.int64)
        self.lengths[list(ranks.ids.values())] = [len(t) for t in tokens]
        self.byte_ids = np.array([ranks.ids[bytes([b])] for b in range(256)], dtype=np.int32)
        self.byte_pairs = ranks.ranks_of(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256)).astype(np.int64).reshape(256, 256)

    def _table(self, name: str, columns: dict) -> None:
        self.db.register("incoming", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def _arrays(self, token: np.ndarray) -> np.ndarray:
        """Contracts one long part: each step takes the least rank from the left, up to an occurrence that makes a pair of lower rank."""
        rank = self.ranks.ranks_of(token[:-1], token[1:])
        while len(rank) and (least := rank.min()) != NEVER:
            at = np.flatnonzero(rank == least)
            run = np.maximum.accumulate(np.where(np.r_[True, np.diff(at) > 1], np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]  # occurrences that overlap: every other one
            while True:
                gone = np.zeros(len(token), dtype=bool)
                gone[at + 1] = True
                merged = token.copy()
                merged[at] = least
                merged, place = merged[~gone], at - np.arange(len(at))
                touched = np.unique(np.r_[place - 1, place])
                touched = touched[(touched >= 0) & (touched < len(merged) - 1)]
                made = self.ranks.ranks_of(merged[touched], merged[touched + 1])
                lower = np.flatnonzero(made < least)
                last = np.searchsorted(place, touched[lower[0]]) + 1 if len(lower) else len(at)
                if last >= len(at):
                    break
                at = at[:last]
            rank = rank[~gone[:-1]][: len(merged) - 1]
            rank[touched] = made
            token = merged
        return token

    def _long(self, raw: bytes) -> bytes:
        """The ids of a long piece: its parts between cuts, as pieces of the query where they are short."""
        cuts = self.ranks.cuts(raw)
        out = []
        for start in range(0, len(cuts) - 1, 50_000):
            parts = [raw[a:b] for a, b in itertools.pairwise(cuts[start : start + 50_001])]
            short = list({p for p in parts if len(p) <= SQL_BYTES})
            known = dict(zip(short, self._merged(short), strict=True))
            out += [known[p] if p in known else self._arrays(self.byte_ids[np.frombuffer(p, dtype=np.uint8)]).astype("<u4").tobytes() for p in parts]
        return b"".join(out)

    def _merged(self, parts: list[bytes]) -> list[bytes]:
        """The ids of short pieces by the recursive query."""
        out = [b""] * len(parts)
        for start in range(0, len(parts), 30_000):
            part = parts[start : start + 30_000]
            sizes = np.array([len(raw) for raw in part])
            ends = np.cumsum(sizes)
            flat = np.frombuffer(b"".join(part), dtype=np.uint8)
            place = np.arange(len(flat)) - np.repeat(ends - sizes, sizes)
            rank = np.r_[self.byte_pairs[flat[:-1], flat[1:]], NEVER]
            rank[ends - 1] = NEVER
            tokens = np.full(len(flat) + 2 * len(part), END, dtype=np.int64)
            tokens[np.arange(len(flat)) + 2 * np.repeat(np.arange(len(part)), sizes) + 1] = (rank << 29) | (place << 21) | self.byte_ids[flat]
            offsets = np.r_[0, ends + 2 * np.arange(1, len(part) + 1)].astype(np.int32)
            self.db.register("start", pa.table({"w": np.arange(len(part)), "l": pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens))}))
            got = self.db.sql(MERGE).to_arrow_table()
            self.db.unregister("start")
            lists = got.column("l").combine_chunks()
            values, offsets = (lists.values.to_numpy(zero_copy_only=False) & TOKEN).astype("<u4").tobytes(), (lists.offsets.to_numpy() * 4).tolist()
            for w, a, b in zip(got.column("w").to_pylist(), offsets, offsets[1:]):
                out[start + w] = values[a + 4 : b - 4]
        return out

    def learn(self, pieces: Iterable[str]) -> dict[str, tuple[bytes, bytes]]:
        """Encodes pieces that memory lacks and decodes their ids; long ones are returned and not remembered."""
        ids, names, runs, short, todo, long = self.ranks.ids, [], [], [], [], []
        for piece in pieces:
            raw = piece.encode()
            if (whole := ids.get(raw)) is not None:
                names.append(piece), runs.append(whole.to_bytes(4, "little"))
            elif len(raw) > SQL_BYTES:
                long.append(piece)
            else:
                short.append(piece), todo.append(raw)
        runs += self._merged(todo)
        self.memory.update(zip(names + short, zip(runs, self.decode(runs), strict=True), strict=True))
        runs = [self._long(piece.encode()) for piece in long]
        return dict(zip(long, zip(runs, self.decode(runs), strict=True), strict=True))

    def cut(self, text: str) -> Iterator[list[str]]:
        """The text's pieces, in slices."""
        if len(text) <= SLICE_CHARS:
            yield self.find.findall(text)
        else:
            found = self.find.finditer(text)
            while part := [m[0] for m in itertools.islice(found, SLICE_CHARS // 4)]:
                yield part

    def encode(self, texts: Iterable[str]) -> Iterator[tuple[int, bytes]]:
        """(number of the text, ids as little-endian unsigned 32-bit integers) of each slice of each text, in order."""
        for at, ids, _ in self.roundtrip(texts):
            yield at, ids

    def roundtrip(self, texts: Iterable[str]) -> Iterator[tuple[int, bytes, bytes]]:
        """As encode, and the bytes that the ids decode to.

        Slices are gathered to about SLICE_CHARS characters, so that one query encodes all their new pieces and one
        decodes all their new ids.
        """
        held: list[tuple[int, list[str]]] = []
        size = 0
        for at, pieces in ((at, x) for at, text in enumerate(texts) for x in self.cut(text)):
            held.append((at, pieces))
            size += sum(map(len, pieces))
            if size >= SLICE_CHARS:
                yield from self._joined(held)
                held, size = [], 0
        yield from self._joined(held)

    def _joined(self, held: list[tuple[int, list[str]]]) -> Iterator[tuple[int, bytes, bytes]]:
        distinct = set().union(*(pieces for _, pieces in held))
        known = distinct & self.memory.keys()
        self.again |= known
        if len(self.memory) + len(distinct) - len(known) > MEMORY_PIECES:  # forget what was met in one slice only
            self.again &= self.memory.keys() if len(self.again) < MEMORY_PIECES // 2 else distinct
            self.memory = {x: self.memory[x] for x in self.again | known}
        long = self.learn(distinct - known)
        for at, pieces in held:
            if long and not long.keys().isdisjoint(pieces):
                both = [long[x] if x in long else self.memory[x] for x in pieces]
            else:
                both = list(map(self.memory.__getitem__, pieces))
            yield at, b"".join([ids for ids, _ in both]), b"".join([raw for _, raw in both])

    def decode(self, runs: list[bytes]) -> list[bytes]:
        """The bytes of each run of ids, by queries of SLICE_TOKENS tokens; a run has as many as its tokens together."""
        ids = np.frombuffer(b"".join(runs), dtype="<u4").astype(np.int32)
        raw = []
        for start in range(0, len(ids), SLICE_TOKENS):
            part = ids[start : start + SLICE_TOKENS]
            self.db.register("ids", pa.table({"p": np.arange(len(part), dtype=np.int32), "id": part}))
            raw.append(self.db.sql(DECODE).fetchall()[0][0].encode("latin-1"))
            self.db.unregister("ids")
        whole = b"".join(raw)
        ends = np.r_[0, np.cumsum(self.lengths[ids])][np.cumsum([0] + [len(x) // 4 for x in runs])].tolist()
        return [whole[a:b] for a, b in itertools.pairwise(ends)]


def _roundtrip(ranks, full: bool):
    """ranks: a broadcast of Ranks. A task has a coder of its own, so an idle worker holds nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(ranks.value)
        for batch in batches:
            column = batch.column("text")
            n = len(column)
            tokens = np.zeros(n, dtype=np.int64)
            sums = [(hashlib.sha256(), hashlib.sha256()) for _ in range(n)]
            whole: list[tuple[list, list]] = [([], []) for _ in range(n)]
            texts = (x or "" for start in range(0, n, 64) for x in column.slice(start, 64).to_pylist())
            for at, ids, raw in coder.roundtrip(texts):
                tokens[at] += len(ids) // 4
                sums[at][0].update(ids), sums[at][1].update(raw)
                if full:
                    whole[at][0].append(np.frombuffer(ids, dtype="<u4")), whole[at][1].append(raw)
            arrays = [batch.column("id"), pa.array(tokens), pa.array([a.hexdigest() for a, _ in sums], pa.string()), pa.array([b.hexdigest() for _, b in sums], pa.string())]
            if full:
                arrays += [pa.array([np.concatenate(a).astype(np.int64) if a else np.zeros(0, np.int64) for a, _ in whole], pa.list_(pa.int64())), pa.array([b"".join(b) for _, b in whole], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(arrays)])
        coder.db.close()

    return run


def bpe_roundtrip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", full: bool = False) -> DataFrame:
    """Encodes each text by the ranks in a tiktoken file and decodes the ids again.

    Returns one row per input row: id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers),
    decoded_sha256, and with full=True also ids (array of long) and decoded (binary). Null and empty texts have no
    tokens. Rows are independent, so repeated rows, ties and null ids need no rule; extra columns are not read and an
    empty table gives no rows. Special tokens are ordinary text. The file is read on the driver only.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Ranks.load(ranks_path, pattern))  # the vocabulary: a fixed size
    schema = f"id {dict(docs.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded binary" * full
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_roundtrip(shared, full), schema).withColumnRenamed("id", id_col)


def tokenizer() -> tuple[str, str]:
    """The ranks file and the pattern of the contract's tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_roundtrip(read(spark, sf_dir, "documents"), *tokenizer())
