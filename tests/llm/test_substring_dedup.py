"""Substring dedup: automata and the operator against brute force over windows."""

import hashlib
import random

import numpy as np
import pytest

from moodspark.llm import queries
from moodspark.llm import substring_dedup as sd

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, key bigint, block int, n_words string"


def brute(rows, length=13):
    first, out = {}, []
    rank = lambda i: -2 ** 63 if i is None else i
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, words in split:
        for k in range(len(words) - length + 1):
            w = tuple(words[k:k + length])
            first[w] = min(rank(i), first.get(w, rank(i)))
    for i, words in split:
        gone = set()
        for k in range(len(words) - length + 1):
            if first[tuple(words[k:k + length])] < rank(i):
                gone |= set(range(k, k + length))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((str(i), len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest())
                  for r in df.collect())


def test_automaton_gives_the_first_document_of_each_window():
    draw = random.Random(2)
    for _ in range(200):
        texts = [[b"%d" % draw.randint(0, 2) for _ in range(draw.randint(1, 14))] for _ in range(6)]
        automaton, n = sd.SuffixAutomaton(), draw.randint(1, 5)
        for i, words in enumerate(texts[:5]):
            automaton.add(words, i)
        for words in texts:
            want = [next((i for i, t in enumerate(texts[:5])
                          if any(t[j:j + n] == words[k:k + n] for j in range(len(t) - n + 1))), None)
                    for k in range(len(words) - n + 1)]
            assert automaton.first_documents(words, n) == want


def test_equal_windows_have_equal_anchors_and_all_windows_are_in_a_passage():
    draw = random.Random(3)
    words = [b"w%d" % draw.randint(0, 30) for _ in range(400)]
    for hot in (np.zeros(0, np.uint64), None):
        cutter = sd.Cutter(16, np.zeros(0, np.uint64))
        if hot is None:
            cutter.hot = np.unique(cutter.anchors(words)[0])[::2]
        windows = [k for s, n, *_ in zip(*cutter.passages(words)) for k in range(s, s + n - 12)]
        assert sorted(windows) == list(range(388))
        again = {(tuple(words[s + 7:s + n + 7]), shard) for s, n, _, shard in zip(*cutter.passages(words)) if n == 13}
        assert again or hot is not None


def corpus(seed, n=300):
    draw = random.Random(seed)
    word = lambda: f"w{draw.randint(0, 3000)}"
    shared = [[word() for _ in range(k)] for k in (12, 13, 14, 60, 200)]
    rows = []
    for i in range(n):
        words = [word() for _ in range(draw.randint(0, 60))]
        for s in shared:
            if draw.random() < 0.35:
                at = draw.randint(0, len(words))
                words[at:at] = s[draw.randint(0, 2):len(s) - draw.randint(0, 2)]
        rows.append((i * 7 % 1000, draw.choice([" ", "\n", " \t"]).join(words)))
    rows += [(2000 + k, rows[k][1]) for k in range(40)] + [(3000, "é " * 5000), (3001, "é " * 14), (3002, "É " * 14)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], SCHEMA)


@pytest.mark.parametrize("hot_share", [500, 4])
def test_operator_against_brute_force(spark, monkeypatch, hot_share):
    rows = corpus(1)
    monkeypatch.setattr(sd, "WORDS_HELD", 3000)
    monkeypatch.setattr(sd, "SAMPLE", 500 // hot_share // 50 or 1)
    monkeypatch.setattr(sd, "HOT_SHARE", hot_share)
    assert result(sd.remove_repeats(frame(spark, rows))) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(40))
    rows = [(5, long), (5, long), (5, "zz " + long + " zz"), (4, "zz " + long), (None, long), (None, None), (1, ""), (2, None), (7, "a " * 100_000), (8, "a " * 20),
            (9, long + "\x0b" + long), (10, long.upper())]
    assert result(sd.remove_repeats(frame(spark, rows))) == brute(rows)
    assert sd.remove_repeats(frame(spark, [])).count() == 0


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, SF, "documents").collect()]
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in queries.op5(spark, SF).collect())
    assert got == brute(docs)
