"""Rule cascade: facts against plain Python, verdicts whatever the order, the order itself."""

import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from moodspark.llm import quality_rules as qr
from moodspark.llm.words import Words, text_slices

WORD = re.compile(r"[^\x20\x09-\x0d]+")
TEXTS = ["", None, "   \n\t", "one", "a b c d e a b c d e", "x " * 40, "a\n\na\nb\n a\n", "é ÉÈ ß — 12 345 #*$%&|<> ok",
         "same line here\n" * 3 + "other\r\nother\r\n", "\x1c a\xa0b c d \x85", "The end. " * 9 + "again", "ab " * 70_000,
         "a b c d e f a b c d g a b c d e", "W!! " * 30, "🙂 " * 12, "1 2 3 4 5 6 7 8 9 10 11 12",
         " ".join(f"word{i}" for i in range(300)), "a b " * 3, "q\x00r s"]


def plain(text):
    t = text or ""
    words = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    wins = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if wins[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
            "n_upper": sum(unicodedata.category(c) == "Lu" for c in t), "n_lines": t.count("\n") + 1,
            "n_letterless": sum(not any(unicodedata.category(c)[0] == "L" for c in w) for w in words),
            "n_top_word": max(Counter(words).values(), default=0)}


def verdict(text):
    facts = {k: np.array([v]) for k, v in plain(text).items()}
    return not any(r.rejects(*[facts[x] for x in r.facts])[0] for r in qr.RULES)


def test_facts_equal_plain_counts():
    draw = np.random.default_rng(4)
    texts = TEXTS + [" ".join(draw.choice(["a", "b", "c", "Dé", "#"], int(n))) for n in draw.integers(0, 60, 60)]
    part = qr.Texts(pa.array([t or "" for t in texts]))
    for name in plain(""):
        assert part[name].tolist() == [plain(t)[name] for t in texts], name


def test_facts_after_texts_were_left_out():
    part = qr.Texts(pa.array([t or "" for t in TEXTS]))
    part["n_words"], part["word_uses"]
    keep = np.arange(len(TEXTS)) % 3 != 1
    part.keep(keep)
    left = [t for t, k in zip(TEXTS, keep) if k]
    for name in plain(""):
        assert part[name].tolist() == [plain(t)[name] for t in left], name


def test_words_split_at_ascii_white_space_alone():
    texts = [f"a{chr(c)}b" for c in range(1, 128)] + ["a\xa0b", "a\x85b", "a b"]
    assert Words.of(pa.array(texts)).counts().tolist() == [len(WORD.findall(t)) for t in texts]


def test_slices_are_bounded_but_for_a_longer_text():
    texts = pa.array(["x" * n for n in (5, 5, 50, 1, 9, 1, 0, 0)] + [None])
    assert list(text_slices(texts, 10)) == [(0, 2), (2, 3), (3, 5), (5, 9)]
    assert list(text_slices(texts[3:], 10)) == [(0, 2), (2, 6)] and list(text_slices(texts[:0], 10)) == []


@pytest.mark.parametrize("reverse", [False, True])
def test_verdicts_do_not_depend_on_the_order(spark, reverse):
    rows = [(i, t, "clash", True, "x") for i, t in enumerate(TEXTS + [None, TEXTS[4]])] + [(None, "fine", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, bits string, kept boolean, name string")
    rules = qr.RULES[::-1] if reverse else qr.RULES
    got = qr.apply_rules(docs, rules, ("n_words", "n_repeat_words"), by_col="by").collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.kept, r.n_words, r.n_repeat_words) == (
            verdict(r.text), plain(r.text)["n_words"], plain(r.text)["n_repeat_words"])
        assert (r.by is None) == r.kept
        if r.by:
            rule = next(x for x in qr.RULES if x.name == r.by)
            assert rule.rejects(*[np.array([plain(r.text)[x]]) for x in rule.facts])[0]
    assert [(r.doc_id, r.text, r.bits, r.name) for r in sorted(got, key=lambda r: (r.doc_id is None, r.doc_id))] == [
        (r[0], r[1], r[2], r[4]) for r in rows]


def test_empty_table(spark):
    got = qr.apply_rules(spark.createDataFrame([], "doc_id bigint, text string"), always=("n_words",))
    assert got.columns == ["doc_id", "text", "n_words", "kept"] and got.collect() == []


def test_order_takes_rejection_per_cost_among_what_is_left():
    cheap = qr.Rule("cheap", ("n_words",), None)
    same = qr.Rule("same", ("n_lines",), None)          # rejects what "cheap" rejects, and costs more
    dear = qr.Rule("dear", ("n_repeat_words",), None)
    free = qr.Rule("free", ("n_symbols",), None)
    seconds = {"words": 1.0, "n_words": 0.1, "n_lines": 2.0, "word_uses": 3.0, "n_repeat_words": 1.0, "n_symbols": 9.0}
    sets = {0b0011: 50, 0b0100: 30, 0b0000: 900, 0b1000: 1}
    rules = [same, cheap, dear, free]
    assert [r.name for r in qr.cascade(rules, seconds, sets, set())] == ["cheap", "dear", "free", "same"]
    assert qr.cascade(rules, seconds, sets, {"n_symbols", "words"})[0] is free


def test_measure_counts_every_text_of_the_sample(spark):
    docs = spark.createDataFrame([(t or "",) for t in TEXTS], "text string")
    seconds, sets = qr.measure(docs, qr.RULES)
    assert sum(sets.values()) == len(TEXTS) and sets[0] == sum(map(verdict, TEXTS))
    assert set(seconds) == {*qr.FACTS, *[f"rule:{r.name}" for r in qr.RULES]} and seconds["words"] > 0
