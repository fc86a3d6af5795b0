"""Quality rules as a short-circuit cascade.

A rule rejects a text by a few facts (counts) about it. Facts differ in cost,
and rules in how many texts they reject. On a sample, every fact is timed and
every rule applied; rules are then ordered greedily by rejection per cost,
among the texts that the rules before have left and with the facts that are
paid for already. Over the whole table a text meets the rules in this order:
after the first that rejects it, no further fact of it is computed.

The order changes what is computed, never a verdict: a text is kept if no rule
rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import Words, paired, text_slices

SAMPLE = 2_000
WINDOW = 5


def _distinct(pattern: str) -> Callable:
    """How often a pattern is found in the words of each text."""
    return lambda f: f["words"].sums(np.asarray(pc.count_substring_regex(f["words"].distinct, pattern)).astype(np.int64))


def _dup_lines(f: Texts) -> np.ndarray:
    split = pc.split_pattern(f["text"], "\n")
    lines, row = split.flatten(), np.asarray(pc.list_parent_indices(split)).astype(np.int64)
    there = np.asarray(pc.binary_length(pc.ascii_trim_whitespace(lines))) > 0
    code = np.asarray(lines.filter(pa.array(there)).dictionary_encode().indices).astype(np.int64)
    pair, n = paired(row[there], code)
    first = np.zeros(n, np.int64)
    first[pair] = row[there]
    size = len(f["text"])
    return np.bincount(row[there], minlength=size) - np.bincount(first, minlength=size)


def _word_uses(f: Texts) -> tuple[np.ndarray, np.ndarray]:
    """For each word of each text: a number of the (text, word), and how often the text has it."""
    words = f["words"]
    pair, n = paired(words.rows(), words.codes)
    return np.stack([pair, np.bincount(pair, minlength=n)[pair]])


def _repeat_words(f: Texts) -> np.ndarray:
    """Words within windows of five words that the text has twice or more."""
    words, (own, uses) = f["words"], f["word_uses"]
    n, size = len(own), len(words.offsets) - 1
    covered = np.zeros(n + 1, np.int64)
    if n >= WINDOW:
        end = np.repeat(words.offsets[1:], words.counts())
        often = np.concatenate([[0], np.cumsum(uses >= 2)])
        # a window that comes twice has words that all come twice
        at = np.flatnonzero((np.arange(n - WINDOW + 1) + WINDOW <= end[:n - WINDOW + 1])
                            & (often[WINDOW:] - often[:-WINDOW] == WINDOW))
        key = own[at]
        for k in range(1, WINDOW):
            key, _ = paired(own[at + k], key)
        twice = at[np.bincount(key)[key] >= 2] if len(at) else at
        covered[twice] += 1
        covered[twice + WINDOW] -= 1        # starts are distinct, and so are ends
    inside = np.concatenate([[0], np.cumsum(np.cumsum(covered[:n]) > 0)])
    return inside[words.offsets[1:]] - inside[words.offsets[:-1]] if size else np.zeros(0, np.int64)


def _top_word(f: Texts) -> np.ndarray:
    top = np.zeros(len(f["words"].offsets) - 1, np.int64)
    np.maximum.at(top, f["words"].rows(), f["word_uses"][1])
    return top


#: Fact -> (facts it is made from, how). ``words`` and ``word_uses`` are intermediate; all others are one count a text.
FACTS: dict[str, tuple[tuple[str, ...], Callable]] = {
    "words": ((), lambda f: Words.of(f["text"])),
    "n_words": (("words",), lambda f: f["words"].counts()),
    "word_chars": (("words",), lambda f: f["words"].sums(np.asarray(pc.utf8_length(f["words"].distinct)).astype(np.int64))),
    "n_symbols": (("words",), _distinct(r"[#*$%&|<>]")),
    "n_upper": (("words",), _distinct(r"\p{Lu}")),
    "n_letterless": (("words",), lambda f: f["words"].sums(
        (~np.asarray(pc.match_substring_regex(f["words"].distinct, r"\p{L}"))).astype(np.int64))),
    "n_lines": ((), lambda f: np.asarray(pc.count_substring(f["text"], "\n")).astype(np.int64) + 1),
    "n_dup_lines": ((), _dup_lines),
    "word_uses": (("words",), _word_uses),
    "n_repeat_words": (("words", "word_uses"), _repeat_words),
    "n_top_word": (("words", "word_uses"), _top_word),
}


@dataclass(frozen=True)
class Rule:
    """``rejects`` maps arrays of the ``facts``, one value a text, to whether each text is rejected."""

    name: str
    facts: tuple[str, ...]
    rejects: Callable


RULES = [
    Rule("few_words", ("n_words",), lambda n: n < 10),
    Rule("repeated_windows", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > 20 * n),
    Rule("symbols", ("n_symbols", "n_words"), lambda s, n: 10 * s > n),
    Rule("capitals", ("n_upper", "word_chars"), lambda u, c: 100 * u > 30 * c),
    Rule("word_length", ("word_chars", "n_words"), lambda c, n: (c < 2 * n) | (c > 15 * n)),
    Rule("letterless_words", ("n_letterless", "n_words"), lambda x, n: 100 * x > 30 * n),
    Rule("duplicate_lines", ("n_dup_lines", "n_lines"), lambda d, n: (100 * d > 30 * n) & (d >= 2)),
    Rule("one_word", ("n_top_word", "n_words"), lambda t, n: (100 * t > 30 * n) & (n >= 20)),
]


class Texts:
    """Texts of a slice and those of their facts that were asked for."""

    def __init__(self, texts: pa.Array):
        self.values = {"text": texts}

    def __getitem__(self, name: str):
        if name not in self.values:
            self.values[name] = FACTS[name][1](self)
        return self.values[name]

    def __len__(self) -> int:
        return len(self.values["text"])

    def rejected(self, rule: Rule) -> np.ndarray:
        return rule.rejects(*[self[x] for x in rule.facts])

    def keep(self, mask: np.ndarray) -> None:
        """Go on with some of the texts; facts that were computed are carried over, those of single words aside."""
        words = self.values.get("words")
        inside = np.repeat(mask, words.counts()) if words else None
        for name, x in self.values.items():
            if name == "text":
                self.values[name] = x.filter(pa.array(mask))
            elif name == "word_uses":
                self.values[name] = x[:, inside]
            else:
                self.values[name] = x.take(mask) if name == "words" else x[mask]


def closure(names: tuple[str, ...]) -> set[str]:
    """The facts and all that they are made from."""
    return set(names).union(*[closure(FACTS[x][0]) for x in names]) if names else set()


def measure(texts: DataFrame, rules: list[Rule]) -> tuple[dict[str, float], dict[int, int]]:
    """Seconds that each fact (``rule:`` each verdict) takes in all, and how many texts each set of rules, as bits, rejects."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seconds, sets = dict.fromkeys([*FACTS, *[f"rule:{r.name}" for r in rules]], 0.0), {}
        for batch in batches:
            column = pc.fill_null(batch["text"], "")
            for a, b in text_slices(column):
                part = Texts(column[a:b])
                for name in FACTS:          # in an order in which a fact comes after those it is made from
                    start = time.process_time()
                    part[name]
                    seconds[name] += time.process_time() - start
                bits = np.zeros(b - a, np.int64)
                for k, rule in enumerate(rules):
                    start = time.process_time()
                    bits |= part.rejected(rule).astype(np.int64) << k
                    seconds[f"rule:{rule.name}"] += time.process_time() - start
                for bit, n in zip(*np.unique(bits, return_counts=True)):
                    sets[int(bit)] = sets.get(int(bit), 0) + int(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*seconds, *[None] * len(sets)], pa.string()), pa.array([None] * len(seconds) + [*sets], pa.int64()),
             pa.array([*seconds.values(), *[0.0] * len(sets)]), pa.array([0] * len(seconds) + [*sets.values()], pa.int64())],
            ["name", "bits", "seconds", "n"])

    found = texts.mapInArrow(run, "name string, bits bigint, seconds double, n bigint").groupBy("name", "bits").agg(
        F.sum("seconds").alias("seconds"), F.sum("n").alias("n")).collect()
    return ({r["name"]: r["seconds"] for r in found if r["name"] is not None},
            {r["bits"]: r["n"] for r in found if r["bits"] is not None})


def cascade(rules: list[Rule], seconds: dict[str, float], sets: dict[int, int], paid: set[str]) -> list[Rule]:
    """The rules, next always the one that rejects most of what is left per second of what it has still to compute."""
    order, left, sets, paid = [], list(enumerate(rules)), dict(sets), set(paid)
    while left:
        def worth(item: tuple[int, Rule]) -> float:
            k, rule = item
            cost = sum(seconds.get(x, 0.0) for x in closure(rule.facts) - paid) + seconds.get(f"rule:{rule.name}", 0.0)
            return sum(n for bits, n in sets.items() if bits >> k & 1) / max(cost, 1e-9)

        best = max(left, key=worth)         # of equal ones the first
        order.append(best[1])
        left.remove(best)
        paid |= closure(best[1].facts)
        sets = {bits: n for bits, n in sets.items() if not bits >> best[0] & 1}
    return order


def apply_rules(docs: DataFrame, rules: list[Rule] | None = None, always: tuple[str, ...] = (), sample: int = SAMPLE,
                text_col: str = "text", kept_col: str = "kept", by_col: str | None = None) -> DataFrame:
    """``docs`` with the facts ``always`` (bigint) and ``kept_col``: whether no rule rejects the row's whole text.

    Columns of ``docs`` whose names the added ones take are replaced, all
    others kept. ``by_col`` adds the name of the rejecting rule that came first;
    which one that is depends on the measured order. Costs are measured on a
    random sample of about ``sample`` rows; every row is judged, in slices of a
    few MB, so that neither many nor very long texts are gathered. A null text
    counts as empty, repeated rows are judged each, an empty table gives no rows.
    """
    rules = RULES if rules is None else rules
    rows = docs.count()
    drawn = docs.sample(min(1.0, sample / rows), seed=7) if rows else docs
    seconds, sets = measure(drawn.select(F.col(text_col).cast("string").alias("text")), rules)
    order = cascade(rules, seconds, sets, closure(always))
    added = [*always, kept_col, *([by_col] if by_col else [])]
    fields = [f for f in docs.schema.fields if f.name.lower() not in {x.lower() for x in added}]
    schema = T.StructType([*fields, *[T.StructField(x, T.LongType()) for x in always], T.StructField(kept_col, T.BooleanType()),
                           *([T.StructField(by_col, T.StringType())] if by_col else [])])
    names = [f.name for f in fields]
    text_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            column = pc.fill_null(batch[text_at].cast(pa.string()), "")
            facts, by = [], np.full(len(batch), len(order))
            for a, b in text_slices(column):
                part, alive = Texts(column[a:b]), np.arange(a, b)
                facts.append([part[x] for x in always])
                for k, rule in enumerate(order):
                    if not len(alive):
                        break
                    out = part.rejected(rule)
                    if out.any():
                        by[alive[out]] = k
                        alive = alive[~out]
                        part.keep(~out)
            first = pa.array([r.name for r in order] + [None], pa.string()).take(pa.array(by))
            yield pa.RecordBatch.from_arrays(
                [*[batch[batch.schema.names.index(x)] for x in names],
                 *[pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*facts)], pa.array(by == len(order)),
                 *([first] if by_col else [])], [*names, *added])

    return docs.select(*[F.col(f"`{c}`") for c in docs.columns]).mapInArrow(run, schema)
