import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import chat_format as c
from millrace.llm import license_scan as s


def test_markers():
    assert c.marker("User: hi") == ("user", 6) and c.marker("  [assistant] x")[0] == "assistant" and c.marker("### Human:") == ("user", 10)
    assert c.marker("**Bot:** x")[0] == "assistant" and c.marker("<|system|> x") == ("system", 11) and c.marker("A: x") == ("assistant", 3)
    assert c.marker("At: no") == (None, 0) and c.marker("") == (None, 0) and c.marker("### About humans") == (None, 0)


def test_viterbi_is_the_best_path_and_blocks_keep_it():
    rng = np.random.default_rng(0)
    scores = rng.normal(size=(5, c.N)) * 3

    def value(path):
        return c.START[path[0]] + scores[0][path[0]] + sum(c.MOVE[a, b] + scores[t][b] for t, (a, b) in enumerate(zip(path, path[1:], strict=False), 1))

    best = max(itertools.product(range(c.N), repeat=5), key=value)
    assert c.viterbi(scores, None) == list(best)
    enter = (c.transfer(scores[1:3]) + (c.START + scores[0])[:, None]).max(axis=0)
    tail = c.viterbi(scores[3:], enter)
    assert tail == list(best[3:])


def recovered(turns):
    return sorted(repr(tuple(r)) for r in turns.select(c.conversation(F.col("conv"), "long"), "turn", "role", "content").collect())


def test_query_over_odd_rows(spark, tmp_path):
    rows = [(None, None, "user", "alone"), (None, None, "user", "alone"), (None, 3, "assistant", "x\ny"), (1, 0, "tool", "42"), (1, 1, None, "?"), (1, 2, "user", None), (7, None, "system", "be kind")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = c.op3_chat_format(spark, str(tmp_path)).collect()
    assert sorted((r.conv_id or -1, -1 if r.turn is None else r.turn) for r in got) == sorted((i or -1, -1 if t is None else t) for i, t, _, _ in rows)
    named = {(r.conv_id, r.turn): (r.role, r.rendered) for r in got}
    assert named[7, None] == ("system", "<|im_start|>system\nbe kind<|im_end|>") and named[None, 3][1] == "<|im_start|>assistant\nx\ny<|im_end|>"
    assert named[1, 2] == ("user", "<|im_start|>user\n<|im_end|>") and named[1, 0][0] == named[1, 1][0] == "user"


def test_one_long_turn(spark):
    text = "".join(f"line {i} of a long answer with some more words in it\n" for i in range(100_000))
    turns = spark.createDataFrame([(1, 0, "user", "go on"), (1, 1, "assistant", text), (1, 2, "user", "thanks")], "conv_id long, turn int, role string, text string")
    assert recovered(c.parse(c.as_transcript(turns))) == sorted(map(repr, [(1, 0, "user", "go on"), (1, 1, "assistant", text), (1, 2, "user", "thanks")]))


@pytest.mark.parametrize("block", [2, 64])
def test_round_trip_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(c, "BLOCK", block)
    rng = random.Random(1)
    rows = []
    for conv in [*range(12), None]:
        roles = itertools.cycle(["user", "assistant"])
        for turn in range(rng.randrange(1, 14)):
            rows.append((conv, turn, "system" if turn == 0 and conv and conv % 3 == 0 else next(roles), "\n".join(" ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(0, 30))) for _ in range(rng.randrange(1, 9)))))
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({k: F.lit(1) for k in ("conv", "block", "first", "last", "line", "pos")})
    got = c.parse(c.as_transcript(turns.drop("conv", "line", "pos")))
    assert recovered(got) == sorted(map(repr, rows))
    assert c.parse(c.as_transcript(turns.limit(0).drop("conv", "line", "pos"))).count() == 0


def test_lost_markers_are_recovered(spark):
    text = "System: be kind\nUser: what is this?\nIt is a long story that ends here.\nUser: and then?\n" + "x " * 150 + "\nUser: thanks"
    got = c.parse_documents(spark.createDataFrame([(1, text), (2, None), (3, ""), (3, ""), (4, "User: a\r\nAssistant: b"), (5, "User: q\n" + "line\n" * 3000 + "Assistant: end")], "doc_id long, text string")).orderBy("doc_id", "turn").collect()
    assert [r.role for r in got if r.doc_id == 4] == ["user", "assistant"]
    assert [r.role for r in got if r.doc_id == 5] == ["user", "assistant"] and [r.turn for r in got if r.doc_id == 5] == [0, 3001]
    assert [r.role for r in got if r.doc_id == 1][:2] == ["system", "user"] and {r.doc_id for r in got} == {1, 2, 3, 4, 5}


def test_null_roles_and_texts(spark):
    turns = spark.createDataFrame([(1, 0, "user", None), (1, 1, None, "An answer"), (1, None, "user", "x"), (2, 0, None, None), (2, 0, None, None)], "conv_id long, turn int, role string, text string")
    got = c.parse(c.as_transcript(turns)).collect()
    assert len(got) == 5 and all(r.role in c.ROLES for r in got)


def test_repeated_tied_and_null_turns_stay_apart(spark):
    rows = [(v, *r) for v in range(8) for r in [
        (None, "user", "n1"), (None, "user", "n2\nmore"), (None, "assistant", "n3"), (0, "system", "s"), (1, "user", "hi"), (2, "user", "hi"), (2, "user", "hi"), (3, "user", "b\ny"), (3, "assistant", "a\nz\nc"), (200, "user", "late"), (200, "user", "late")]]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert recovered(c.parse(c.as_transcript(turns))) == sorted(map(repr, rows))


def test_patience_alignment():
    assert s.increasing([(0, 5), (1, 1), (2, 6), (3, 2), (4, 3)]) == [(1, 1), (3, 2), (4, 3)]
    a, b = "x a b c the d the e y".split(), "a b the c d e".split()
    pairs = s.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(set(pairs))
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False)) and len(pairs) >= 5
    assert s.align([], b) == [] and len(s.align(b, b)) == len(b)


def test_planted_licenses(spark):
    rng = random.Random(2)
    noise = lambda n: " ".join(rng.choice(["the", "under", "license", "version", "lorem", "of", "and", "is"]) for _ in range(n))
    mit, gpl = s.TEXTS["MIT"], s.TEMPLATES["GPL-3.0"][0]
    edited = mit.split()
    for i in (5, 30, 60):
        edited[i] = "changed"
    texts = [f"{noise(50)} {mit} {noise(50)}", f"{noise(30)} {' '.join(edited)}", f"{gpl}\n{noise(80)}\n{gpl.upper()}", noise(400), None, "", "Released under the MIT License. Licensed under CC BY-NC 4.0.", " ".join(mit.split()[:40]), noise(30_000) + gpl]
    rows = list(enumerate(texts)) + [(None, gpl), (2, texts[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({k: F.lit(1) for k in ("id", "coverage", "places")})
    got = s.scan_licenses(docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and s.scan_licenses(docs.limit(0)).count() == 0
    assert {i: by[i].licenses for i in range(9)} == {0: "MIT", 1: "MIT", 2: "GPL-3.0", 3: "", 4: "", 5: "", 6: "CC-BY-NC-4.0,MIT", 7: "", 8: "GPL-3.0"}
    assert by[0].texts == by[1].texts == "MIT" and by[6].texts == "" and by[2].n_found == 2 and by[0].coverage == 1.0 and 0.9 < by[1].coverage < 1 and by[None].n_found == 1


def test_statements_in_other_words():
    scanner = s.Scanner()
    for text, want in {
        "Licensed under the MIT License": "MIT", "Code: Apache License 2.0, see LICENSE": "Apache-2.0", "Dieses Werk steht unter CC BY-SA 4.0": "CC-BY-SA-4.0", "Licensed under CC BY-ND 4.0.": "CC-BY-ND-4.0", "Licensed under CC BY-NC-SA 4.0.": "CC-BY-NC-SA-4.0",
        "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0", "distributed under the GNU Lesser General Public License, version 3": "LGPL-3.0", "under the GNU Affero General Public License, version 3.": "AGPL-3.0",
        "GNU Lesser General Public License v. 2.1 or version 2.1": "LGPL-2.1", "Dedicated under CC0 1.0": "CC0-1.0", "(c) 2020 Somebody. All rights reserved.": "All-rights-reserved", "Licensed under CC BY 4.0.": "CC-BY-4.0", "GPLv3 applies": "GPL-3.0",
        s.TEMPLATES["GPL-3.0"][1].replace("version 3", "version 2"): "GPL-2.0", "the license comes by version 3 of the general public": "", "This work is licensed under the GNU General Public License, version 9.": "",
    }.items():
        assert ",".join(sorted({f[0] for f in scanner.scan(text)})) == want, text


def test_query_finds_all_statements(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in s.op8_license_scan(spark, sf).collect()}
    assert got.keys() == docs.keys()
    statements = {t: k for k, texts in s.TEMPLATES.items() for t in texts if len(t) < 90}
    for i, text in docs.items():
        assert set(filter(None, got[i].licenses.split(","))) == {k for t, k in statements.items() if " ".join(s.words(t)) in " ".join(s.words(text))}


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = list(itertools.accumulate(range(1, len(b) + 1), lambda left, j, old=row, x=x: max(left, old[j], old[j - 1] + (x == b[j - 1])), initial=0))
    return row[-1]


def test_alignment_against_the_longest_common_subsequence():
    rng = random.Random(7)
    for _ in range(40):
        words = rng.sample([f"w{i}" for i in range(200)], 30)
        a = [w for w in words if rng.random() > 0.2]
        for _ in range(rng.randrange(8)):
            a.insert(rng.randrange(len(a) + 1), f"new{rng.random()}")
        if rng.random() < 0.5:
            i, j = sorted(rng.sample(range(len(a)), 2))
            a[i], a[j] = a[j], a[i]
        assert len(s.align(a, words)) == longest_common(a, words)  # words are unique: every one is an anchor
        again = a + rng.choices(words, k=10)
        assert len(s.align(again, words)) <= longest_common(again, words)


def test_whole_texts_are_told_apart_and_edits_cost_coverage():
    scanner, rng = s.Scanner(), random.Random(9)
    for name, text in s.TEXTS.items():
        (got,) = scanner.scan(f"Copyright 2024 Some Body {text} and then code follows")
        assert got[:3] == (name, True, 1.0)
        w = s.words(text)
        kept = [x for x in w if x in s.KINDS or x.isdecimal() or rng.random() > 0.05]
        (got,) = [f for f in scanner.scan(" ".join(kept)) if f[0] == name]
        assert got[1] and got[2] == longest_common(kept, w) / len(w)
        opening = " ".join(w[: len(w) // 2])
        assert not any(f[1] for f in scanner.scan(opening))


def test_many_notices_take_linear_time():
    scanner = s.Scanner()
    spent = {}
    for n in (2000, 8000):
        began = time.process_time()
        assert len(scanner.scan("Released under the MIT License. Some code here. " * n)) == n
        spent[n] = time.process_time() - began
    assert spent[8000] < 6 * spent[2000] and spent[8000] < 20


def test_a_library_of_texts_is_read(spark, tmp_path):
    (tmp_path / "Own License-1.txt").write_text("alpha beta gamma delta epsilon zeta")
    docs = spark.createDataFrame([(1, "so: Alpha beta gamma delta epsilon zeta."), (2, "alpha")], "doc_id long, text string")
    got = s.scan_licenses(docs, templates={}, texts=s.read_texts(spark, str(tmp_path))).orderBy("doc_id").collect()
    assert [r.texts for r in got] == ["Own License-1", ""]
