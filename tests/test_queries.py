"""Queries without SQL against plain Python over whole small tables."""

import collections
import math
import re
from difflib import SequenceMatcher

from millrace.functions.text import STOPWORDS
from millrace.operators import codefix
from millrace.plans import queries

SF = "/root/testdata/sf0.001"


def code_tokens(text):
    runs = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", "\x00".join(re.split(r"[^A-Za-z0-9_.]+", text))).split("\x00")
    return [t for run in runs for t in run.lower().split("_") if t and t not in STOPWORDS]


def bm25(query, docs, digits=None):
    """(score, first, doc) of the documents that share a token, best first."""
    bags = {k: collections.Counter(t) for k, t in docs.items()}
    df = collections.Counter(t for b in bags.values() for t in b)
    avg, n = sum(b.total() for b in bags.values()) / len(bags), len(bags)
    asked, out = collections.Counter(query), []
    for k, b in bags.items():
        shared = [t for t in asked if t in b]
        if shared:
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * b[t] * 2.5 / (b[t] + 1.5 * (0.25 + 0.75 * b.total() / avg)) * asked[t] for t in shared)
            out.append((-round(s, 9), min(query.index(t) for t in shared), k))
    return sorted(out)


def test_match_fuzzy(spark):
    want = {(r.conv_id, r.turn): r for r in queries._answers(spark, SF).collect()}
    got = queries.match_fuzzy(spark, SF).collect()
    assert len(got) == len(want)
    for r in got:
        a, b = (" ".join(x.replace("\r\n", "\n").split("\n")[0].split()) for x in (want[r.conv_id, r.turn].completion, want[r.conv_id, r.turn].teacher_raw))
        ratio = SequenceMatcher(None, a, b).ratio()
        assert r.similarity == ratio and r.equal == (ratio >= 0.9)


def test_decontam_fuzzy(spark):
    docs = {r.doc_id: r.text.split("\n") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {int(r.task_id): r for r in queries.decontam_fuzzy(spark, SF).collect()}
    assert got.keys() == {i for i in docs if i % 50 == 0}
    for i, r in got.items():
        truth = " ".join(f"{docs[i][-1]} x".split())
        scored = sorted(((-SequenceMatcher(None, truth, " ".join(x.split())).ratio(), at) for at, x in enumerate(docs[i]) if x.split()))
        good = [(-s, at) for s, at in scored if -s >= 0.9]
        if not good:
            assert r.status == "unmatched_line"
        elif len(good) > 1 and good[0][0] - good[1][0] < 0.05:
            assert r.status == "unmatched_ambiguous"
        else:
            assert (r.status, r.line_index, r.strategy) == ("matched", good[0][1], "fuzzy")


def test_rag_contexts(spark):
    docs = {r.doc_id: r.text.splitlines(keepends=True) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    chunks = {}
    for i, lines in docs.items():
        for s in range(0, max(0, math.ceil((len(lines) - 30) / 20)) * 20 + 1, 20) if lines else ():
            chunks[i, s] = lines[s : s + 30]
    tokens = {k: code_tokens("".join(v)) for k, v in chunks.items()}
    got = {r.query_id: r for r in queries.rag_contexts(spark, SF).collect()}
    for i, lines in docs.items():
        if i % 50 or len(lines) < 3:
            assert i not in got
            continue
        at = len(lines) // 2
        text = "".join(lines[max(0, at - 20) : at]) + "\n" + "".join(lines[at + 1 : at + 21])
        query = code_tokens(text + "\n" + " ".join(re.findall("[A-Za-z_][A-Za-z0-9_]*", text)))
        shown, used = [], 0
        passed = 0
        for _, _, k in bm25(query, tokens)[:24]:
            s, own = k[1], chunks[k]
            end = s + len(own) - 1
            if k[0] == i and (abs(s - at) <= 80 or abs(end - at) <= 80 or s <= at <= end) or lines[at].rstrip("\r\n") in [x.rstrip("\r\n") for x in own]:
                continue
            passed += 1
            body = "".join(own)
            body = body if len(body) <= 600 else body[:300] + "\n...\n" + body[-295:]
            used += len(body)
            if passed > 12 or len(shown) == 4 or (shown and used > 2000):
                break
            shown.append(f"[{len(shown) + 1}] path: {k[0]} (lines {s + 1}-{end + 1})\n{body.rstrip(chr(10))}\n\n")
        want = "/* RAG_CONTEXT\n" + "".join(shown) + "END_RAG_CONTEXT */\n"
        assert got[i].block == want if shown else i not in got


def test_exact_group_split(spark):
    pool = collections.Counter(tuple(r) for r in codefix.candidates(codefix.statements(queries._statements(spark, SF))).select("id", "file", "mutation_type").collect())
    got = queries.exact_group_split(spark, SF).collect()
    assert len(got) == 5000 and sum(r.split == "val" for r in got) == 100
    assert not {r.file for r in got if r.split == "val"} & {r.file for r in got if r.split == "train"}
    assert not collections.Counter((r.id, r.file, r.mutation_type) for r in got) - pool
    assert collections.Counter(r.mutation_type for r in got) == {"swap_args": 1667, "missing_arg": 1667, "extra_arg": 1666}


def test_codefix_records(spark):
    parsed = codefix.statements(queries._statements(spark, SF)).select("file", "line_index", "text").collect()
    docs = {(r.file, r.line_index, n): code_tokens(r.text) for n, r in enumerate(parsed)}
    text = {(r.file, r.line_index, n): r.text for n, r in enumerate(parsed)}
    got = queries.codefix_records(spark, SF).collect()
    assert got and len({r.id for r in got}) == len(got)
    for r in got[:40]:
        broken = re.search(r"to fix:\n```java\n(.*)\n```", r.prompt)[1]
        original = r.completion.split("\n")[1]
        file, at, _ = r.id.split("::")
        scores = {text[k]: -s for s, _, k in reversed(bm25(code_tokens(broken), docs))}
        assert len(r.augmentations) == 4 == len(set(r.augmentations)) and not {original, broken} & set(r.augmentations)
        near = {t for k, t in text.items() if k[0] == file and abs(k[1] - int(at)) <= 80}
        far = {t for k, t in text.items() if k[0] != file or abs(k[1] - int(at)) > 80}
        assert set(r.augmentations) <= far and scores[r.augmentations[0]] > 0 and near
