"""Chat formatting: a hidden Markov model recovers the roles of transcript lines before canonical rendering.

A state is a role and whether the line begins a turn or continues one. Lines emit a speaker marker (or none) and, where
a turn begins, weak features of the line. Viterbi runs over blocks of a transcript: a block's max-plus transfer matrix
carries scores to the next block, so a transcript of any length is cut over many tasks and still gets its one best path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import read
from millrace.storage import materialize, tidy

ROLES = ("system", "user", "assistant")
#: Names that transcripts give the speakers.
NAMES = {
    "system": ("system", "instructions", "context", "sys"),
    "user": ("user", "human", "you", "customer", "question", "q", "prompter", "client"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "model", "agent", "gpt", "response"),
}
_ROLE_OF = {name: role for role, names in NAMES.items() for name in names}
_NAME = "|".join(sorted(_ROLE_OF, key=len, reverse=True))
#: "Name:", "**Name:**", "[name]", "<name>", "<|name|>" and "### Name" with an optional colon.
_MARKER = re.compile(rf"\s*(?:\*\*(?P<bold>{_NAME})\s*:\s*\*\*|\[(?P<square>{_NAME})\]:?|<\|?(?P<angle>{_NAME})\|?>|#{{1,4}}\s*(?P<hash>{_NAME})\s*:?(?=\s*$)|(?P<plain>{_NAME})\s*:)[ \t]?", re.IGNORECASE)
#: Turn numbers of a block.
BLOCK = 64
LOW = -1e9
#: The place of a line in its transcript; given is 0 for null turns, which come before turn 0, copy tells rows of one turn apart.
ORDER = ["turn", "given", "copy", "pos", "line"]
N = 2 * len(ROLES)  # state 2r begins a turn of role r, 2r + 1 continues one


def marker(line: str) -> tuple[str | None, int]:
    """The role that a line's marker names and where the content begins; (None, 0) without a marker."""
    found = _MARKER.match(line)
    return (_ROLE_OF[next(x for x in found.groups() if x).lower()], found.end()) if found else (None, 0)


def _transitions() -> np.ndarray:
    """Log chances: a turn goes on, or a turn of another role begins, most likely the one whose turn it is."""
    out = np.full((N, N), LOW)
    begins = {"system": (0.01, 0.25, 0.04), "user": (0.01, 0.02, 0.27), "assistant": (0.01, 0.27, 0.02)}
    for r, role in enumerate(ROLES):
        for state in (2 * r, 2 * r + 1):
            out[state, 2 * r + 1] = np.log(0.7)
            for s, chance in enumerate(begins[role]):
                out[state, 2 * s] = np.log(chance)
    return out


MOVE = _transitions()
START = np.array([np.log(0.2), LOW, np.log(0.65), LOW, np.log(0.15), LOW])
#: Chances of a line's marker: the state's own role, another role, none.
BEGIN_MARK, GO_ON_MARK = (0.90, 0.004, 0.06), (0.008, 0.008, 0.97)


def emission(line: str) -> np.ndarray:
    """Log chances of a line in each state."""
    role, _ = marker(line)
    text = line.strip()
    out = np.empty(N)
    for r, name in enumerate(ROLES):
        kind = 2 if role is None else int(role != name)
        out[2 * r], out[2 * r + 1] = np.log(BEGIN_MARK[kind]), np.log(GO_ON_MARK[kind])
    if role is None:
        asks, long, listed = text.endswith("?"), len(text) > 200, bool(re.match(r"[-*•]|\d+[.)]|```", text))
        out[0] += np.log(0.1 if asks else 1) + np.log(2 if text.lower().startswith("you are") else 0.5)
        out[2] += np.log(3 if asks else 1) + np.log(0.5 if long or listed else 1)
        out[4] += np.log(0.5 if asks else 1) + np.log(2 if long or listed else 1)
    return out


def transfer(scores: np.ndarray) -> np.ndarray:
    """Best path scores from a state before the lines to one at the last line."""
    out = np.where(np.eye(N, dtype=bool), 0.0, LOW)
    for s in scores:
        out = (out[:, :, None] + MOVE[None]).max(axis=1) + s
    return out


def viterbi(scores: np.ndarray, enter: np.ndarray | None, leave: int | None = None) -> list[int]:
    """The best path; enter: scores of the states before the first line (None at a transcript's start); leave: the last state if it is known."""
    now = START + scores[0] if enter is None else (enter[:, None] + MOVE).max(axis=0) + scores[0]
    back = []
    for s in scores[1:]:
        every = now[:, None] + MOVE
        back.append(every.argmax(axis=0))
        now = every.max(axis=0) + s
    path = [int(now.argmax()) if leave is None else leave]
    for choice in reversed(back):
        path.append(int(choice[path[-1]]))
    return path[::-1]


def _block_matrix(group: pd.DataFrame) -> pd.DataFrame:
    lines = group.sort_values(ORDER)["line"]
    scores = np.stack([emission(x) for x in lines])
    first = group["block"].iloc[0] == group["first"].iloc[0]
    matrix = transfer(scores[1:]) if first else transfer(scores)
    if first:
        matrix = matrix + (START + scores[0])[:, None]
    return pd.DataFrame({"conv": group["conv"].iloc[:1], "block": group["block"].iloc[:1], "matrix": [matrix.reshape(-1)]})


def _messages(blocks: pd.DataFrame) -> pd.DataFrame:
    """For each block of a transcript the scores before it and its last state on the best path."""
    blocks = blocks.sort_values("block")
    matrices = [np.asarray(m).reshape(N, N) for m in blocks["matrix"]]
    enter, now = [], np.zeros(N)
    for i, m in enumerate(matrices):
        enter.append(now)
        now = m.max(axis=0) if i == 0 else (now[:, None] + m).max(axis=0)
        now = now - now.max()
    leave = [int(now.argmax())]
    for i in range(len(matrices) - 1, 0, -1):
        leave.append(int((enter[i] + matrices[i][:, leave[-1]]).argmax()))
    return pd.DataFrame({"conv": blocks["conv"].to_numpy(), "block": blocks["block"].to_numpy(), "enter": enter, "leave": leave[::-1]})


def _turns(group: pd.DataFrame) -> pd.DataFrame:
    """Pieces of turns: begun is the turn number at which one began, missing where the first piece goes on from the block before."""
    group = group.sort_values(ORDER)
    head = group.iloc[0]
    known = head["leave"] is not None and not pd.isna(head["leave"])
    first = head["block"] == head["first"]
    path = viterbi(np.stack([emission(x) for x in group["line"]]), None if first else np.asarray(head["enter"]), int(head["leave"]) if known else None)
    out: list[list] = []
    for state, turn, given, copy, pos, line in zip(path, *(group[k] for k in ORDER), strict=True):
        cut = marker(line)[1] if state % 2 == 0 else 0
        if state % 2 == 0 or not out:
            out.append([state % 2 == 0, turn, given, copy, pos, ROLES[state // 2], []])
        if not (cut and cut == len(line) and not line[-1].isspace()):  # a bare marker has its content on the next lines
            out[-1][6].append(line[cut:])
    return pd.DataFrame({
        "conv": head["conv"], "block": head["block"], "begins": [o[0] for o in out], "turn": [o[1] for o in out], "given": [o[2] for o in out], "copy": [o[3] for o in out], "pos": [o[4] for o in out],
        "role": [o[5] for o in out], "content": ["\n".join(o[6]) for o in out], "lines": [len(o[6]) for o in out],
    })


@tidy
def parse(lines: DataFrame) -> DataFrame:
    """lines: (conv, turn, copy, pos, line), a transcript's lines in the order of turn, copy and pos. Returns (conv, turn, copy, pos, role, content), one row for each recovered turn.

    turn, copy and pos are those of the line that begins it. Null lines are empty lines; null turns come before turn 0 and
    stay null; null copies and positions count as 0; equal positions are ordered by their text; a null conv is a transcript of its own. A block of BLOCK turn numbers is
    one group of a task; transcripts of several blocks pass their scores on through one row a block.
    """
    types = dict(lines.dtypes)
    zero = F.lit(0).cast("long")
    base = lines.select("conv", F.coalesce(F.col("turn").cast("long"), zero).alias("turn"), F.col("turn").isNotNull().cast("int").alias("given"), F.coalesce(F.col("copy").cast("long"), zero).alias("copy"), F.coalesce(F.col("pos").cast("long"), zero).alias("pos"), F.coalesce("line", F.lit("")).alias("line"))
    base = materialize(base.withColumn("block", F.floor(F.col("turn") / BLOCK)), "chat-lines")
    spans = base.groupBy("conv").agg(F.min("block").alias("first"), F.max("block").alias("last"))
    long = materialize(spans.filter("first < last"), "chat-long").withColumnRenamed("conv", "c")
    # transcripts of several blocks: a scalar pass for the messages between them
    several = base.join(long, F.col("conv").eqNullSafe(F.col("c"))).drop("c", "last")
    matrices = several.groupBy("conv", "block").applyInPandas(_block_matrix, f"conv {types['conv']}, block long, matrix array<double>")
    messages = matrices.groupBy("conv").applyInPandas(_messages, f"conv {types['conv']}, block long, enter array<double>, leave int")
    messages = materialize(messages, "chat-messages").select(F.col("conv").alias("c"), F.col("block").alias("b"), "enter", "leave")
    joined = base.join(messages, F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")), "left").withColumn("first", F.when(F.col("leave").isNull(), F.col("block"))).drop("c", "b")
    joined = joined.join(long.select("c", F.col("first").alias("f")), F.col("conv").eqNullSafe(F.col("c")), "left").withColumn("first", F.coalesce("first", "f")).drop("c", "f")
    pieces = joined.groupBy("conv", "block").applyInPandas(_turns, f"conv {types['conv']}, block long, begins boolean, turn long, given int, copy long, pos long, role string, content string, lines int")
    pieces = materialize(pieces, "chat-pieces")
    key = ["turn", "given", "copy", "pos"]
    # a piece that goes on belongs to the last turn begun in an earlier block
    ends = pieces.groupBy("conv", "block").agg(F.max(F.when(F.col("begins"), F.struct("turn", "given", "copy", "pos"))).alias("last"))
    before = ends.withColumn("before", F.last("last", ignorenulls=True).over(Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.filter("before is not null").select(F.col("conv").alias("c"), F.col("block").alias("b"), "before")
    on = pieces.filter("not begins").join(before, F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).select("conv", *[F.col(f"before.{k}").alias(k) for k in key], "block", "role", "content", "lines")
    whole = pieces.filter("begins").select("conv", *key, "block", "role", "content", "lines").unionByName(on)
    parts = F.array_sort(F.collect_list(F.struct("block", "lines", "content")))
    turns = whole.groupBy("conv", *key).agg(F.max("role").alias("role"), F.array_join(F.transform(F.filter(parts, lambda p: p["lines"] > 0), lambda p: p["content"]), "\n").alias("content"))
    return turns.withColumn("turn", F.when(F.col("given") == 1, F.col("turn"))).drop("given")


def render(role: Column, content: Column) -> Column:
    """A turn in canonical form."""
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), content, F.lit("<|im_end|>"))


def parse_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Turns of transcripts that are one text each: (id, turn: number of the first line, role, rendered)."""
    split = F.split(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "\r\n?", "\n"), "\n", -1)
    lines = docs.select(F.col(id_col).alias("conv"), F.posexplode(split).alias("turn", "line")).withColumns({"copy": F.lit(0), "pos": F.lit(0)})
    return parse(lines).select(F.col("conv").alias(id_col), "turn", "role", render(F.col("role"), F.col("content")).alias("rendered"))


def as_transcript(turns: DataFrame) -> DataFrame:
    """The lines of transcripts that people would have written for (conv_id, turn, role, text), in one of four styles by conv_id.

    conv is a transcript's key: conv_id as text with a first letter. A row without conv_id or turn has no place among others
    and is a transcript of its own, so such rows are no group however many there are. A turn whose role is null or none of ROLES
    is written as the user's; a null text is empty. Rows with one conv_id and turn follow each other by text and role; copy numbers them, so equal rows
    stay apart and no lines of two rows mix.
    """
    named_id = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    style = F.pmod(F.crc32(named_id), F.lit(4))
    name = {0: {"system": "System", "user": "User", "assistant": "Assistant"}, 3: {"system": "System", "user": "Q", "assistant": "A"}}
    role, text = F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise("user"), F.coalesce("text", F.lit(""))

    def named(names: dict) -> Column:
        return F.coalesce(F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[role], role)

    marked = F.when(style == 0, F.concat(named(name[0]), F.lit(": "), text)).when(style == 1, F.concat(F.lit("### "), F.initcap(role), F.lit(":\n"), text))
    marked = marked.when(style == 2, F.concat(F.lit("["), role, F.lit("] "), text)).otherwise(F.concat(named(name[3]), F.lit(": "), text))
    alone = F.concat(F.when(F.col("conv_id").isNull(), "n").otherwise("r"), F.monotonically_increasing_id().cast("string"), F.lit(":"), named_id)
    key = F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), F.concat(F.lit("c:"), named_id)).otherwise(alone)
    rows = turns.select(key.alias("conv"), "turn", "role", text.alias("text"), F.coalesce(marked, text).alias("marked"))
    rows = rows.select("conv", "turn", F.row_number().over(Window.partitionBy("conv", "turn").orderBy("text", "role")).alias("copy"), F.split("marked", "\n", -1).alias("lines"))
    return rows.select("conv", "turn", "copy", F.posexplode("lines").alias("pos", "line"))


def conversation(conv: Column, kind: str) -> Column:
    """The conv_id behind a transcript's key."""
    return F.when(~conv.startswith("n"), F.regexp_replace(conv, "^[cr][0-9]*:", "").cast(kind))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a transcript with speaker markers, its roles recovered and its turns rendered.

    One row for each row of the table: conv_id, turn, role, rendered. The recovered role is always system, user or
    assistant: a turn whose own role is null or another one was written as the user's.
    """
    table = read(spark, sf_dir, "conversations")
    turns = parse(as_transcript(table))
    return turns.select(conversation(F.col("conv"), dict(table.dtypes)["conv_id"]).alias("conv_id"), "turn", "role", render(F.col("role"), F.col("content")).alias("rendered"))


ORACLE = """
SELECT conv_id, turn, role, '<|im_start|>' || role || chr(10) || coalesce(text, '') || '<|im_end|>' AS rendered FROM conversations
"""
