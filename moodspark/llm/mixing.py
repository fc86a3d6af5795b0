"""Mixing documents to target domain weights by soft membership.

A softmax classifier fitted on the label table gives each document a
posterior p over the domains. A document of n words at rate r then counts
r * n * p_d words towards domain d. The rates minimise the squared
differences (over each domain's size) between these expected totals and the
targets, subject to r >= 0, by accelerated projected gradient steps from r = 1.

The gradient at a document depends on the document only through p, and on the
rest of the corpus only through the few domain residuals. So a step is one
distributed sum of a few numbers. Its length is 1 / L, L the largest eigenvalue
of the domains' scaled Gram matrix, with which a step cannot overshoot.

Documents with like posteriors move alike. The first steps are therefore worked
out on cells of posteriors, a bounded table of exact sums over all documents,
and every document then takes these same steps with its own p, in one pass. From
there steps are distributed sums over the documents themselves, until their
projected gradient is small; rates are columns beside the posteriors, written
every few steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names, materialize
from .features import TextFeatures, chosen, gather, slices, style_features
from .linear import fit_softmax, ragged_scores, softmax

DOMAINS = ["clean", "poor", "toxic"]
WEIGHTS = {"clean": 0.90, "poor": 0.05, "toxic": 0.05}
MAIN = "clean"
SAMPLE = 12_000
STEPS = 2_000
CLOSE = 5e-5
EVERY = 6
CELLS = 32


def _style(part: pa.RecordBatch, f: TextFeatures) -> list:
    return [style_features(f)]


def domain_posteriors(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, tokens, p`` for each row: words in the whole text and posteriors in the order of ``DOMAINS``.

    Fitted on at most ``sample`` rows labelled for both quality and toxicity,
    in the order of a hash of the id: toxic if toxic is 1, else poor if quality
    is 0, else clean. Null texts count as empty. Without usable labels all
    domains are equally likely.
    """
    (rows,), y, _ = gather(docs, chosen(labels, ["quality", "toxic"], sample), ["quality", "toxic"], _style, ["text"])
    domain = np.where(y[:, 1] == 1, 2, np.where(y[:, 0] == 0, 1, 0)) if len(y) else np.zeros(0, np.int64)
    model = docs.sparkSession.sparkContext.broadcast(fit_softmax(rows, domain, len(DOMAINS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, f in slices(batch):
                p = softmax(ragged_scores(style_features(f), model.value).astype(np.float64))
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(f.words.counts()),
                                                  pa.array(list(p), pa.list_(pa.float64()))], ["doc_id", "tokens", "p"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, tokens bigint, p array<double>")


def _rate(steps: list[list[float]], most: float, start: Column | None = None) -> Column:
    """The steps over a row's posteriors, each a move against the gradient and a projection onto 0 <= r <= most."""
    r = F.lit(1.0) if start is None else start
    for step in steps:
        moved = r - sum((F.col(f"p{d}") * F.lit(x) for d, x in enumerate(step[1:], 1)), F.col("p0") * F.lit(step[0]))
        r = F.least(F.lit(float(most)), F.greatest(F.lit(0.0), moved))
    return r


def targets(now: list[float], weights: dict[str, float], main: str = MAIN, most: float = 1.0) -> list[float]:
    """Words wanted of each domain if the main domain is taken once in full.

    A domain that has too few words for its share gives ``most`` times what it has.
    """
    total = now[DOMAINS.index(main)] / weights[main]
    return [min(weights[d] * total, most * n) for d, n in zip(DOMAINS, now)]


class _Steps:
    """Accelerated projected gradient: from the sums of a step, the next one."""

    def __init__(self, size: np.ndarray, gram: np.ndarray, goal: np.ndarray):
        self.goal, self.part = goal, np.divide(1.0, size, out=np.zeros(len(size)), where=size > 0)
        scaled = gram * np.sqrt(np.outer(self.part, self.part))
        self.longest = float(np.linalg.eigvalsh(scaled).max()) or 1.0
        self.total = self.ahead = size      # expected words at the rates r, and at the points y ahead of them
        self.speed = 1.0

    def move(self) -> np.ndarray:
        return (self.ahead - self.goal) * self.part / self.longest

    def left(self, back: np.ndarray) -> float:
        """The projected gradient: for each domain the mean way back of its words, the largest of them."""
        return float((back * self.part * self.longest).max())

    def go(self, total: np.ndarray, uphill: float) -> float:
        """Take the new totals; the momentum for the next step, none if it points uphill."""
        if uphill > 0:
            self.speed, momentum = 1.0, 0.0
        else:
            faster = (1 + np.sqrt(1 + 4 * self.speed * self.speed)) / 2
            self.speed, momentum = faster, (self.speed - 1) / faster
        self.ahead, self.total = total + momentum * (total - self.total), total
        return float(momentum)


def _moved(p: np.ndarray, r: np.ndarray, y: np.ndarray, move: np.ndarray, most: float) -> np.ndarray:
    return np.clip(y - p @ move, 0.0, most)


def _cell_steps(p: np.ndarray, n: np.ndarray, steps: _Steps, most: float, limit: int, close: float) -> list[tuple[list, float]]:
    """Steps ``(move, momentum)`` for cells of ``n`` words with mean posteriors ``p`` until they are close, at most ``limit``."""
    out: list[tuple[list, float]] = []
    r = y = np.ones(len(n))
    while len(out) < limit:
        move = steps.move()
        new = _moved(p, r, y, move, most)
        back = y - new
        if steps.left(np.abs(back) * n @ p) <= close:
            break
        momentum = steps.go(new * n @ p, float((n * back * (new - r)).sum()))
        out.append((move.tolist(), momentum))
        r, y = new, new + momentum * (new - r)
    return out


def _follow(rows: DataFrame, taken: list[tuple[list, float]], most: float) -> DataFrame:
    """``rows`` with ``_r, _y`` after the steps taken, each row with its own posteriors."""
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.stack([batch[f"p{d}"].to_numpy() for d in range(len(DOMAINS))], axis=1)
            r = y = np.ones(len(batch))
            for move, momentum in taken:
                new = _moved(p, r, y, np.array(move), most)
                r, y = new, new + momentum * (new - r)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(r), pa.array(y)], [*columns, "_r", "_y"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("_r", T.DoubleType()),
                                              T.StructField("_y", T.DoubleType())]))


def solve_rates(rows: DataFrame, weights: dict[str, float] | None = None, steps: int = STEPS, close: float = CLOSE,
                most: float = 1.0, cells: int = CELLS) -> DataFrame:
    """``rows`` (a stored table with ``tokens, p0, p1, ..``) and the ``rate`` of each.

    Steps end when the projected gradient, as its mean size over the words of
    each domain, is within ``close`` for all domains, in a distributed sum over
    all rows. It is an error if ``steps`` steps, those on cells included, do not
    reach that. ``cells`` bounds how finely posteriors are cut for the first
    steps (cells per domain); it has no influence on when the steps end. The sums
    of a step also tell whether the momentum points uphill; it is then dropped.
    """
    k = range(len(DOMAINS))

    def sums(df: DataFrame, values: list[Column]) -> np.ndarray:
        got = df.agg(*[F.sum(v * F.col("tokens")).alias(f"c{i}") for i, v in enumerate(values)]).first()
        return np.array([x or 0.0 for x in got])

    p = [F.col(f"p{d}") for d in k]
    cell = [F.floor(x * cells).alias(f"cell{d}") for d, x in enumerate(p[1:])]
    found = rows.groupBy(*cell).agg(*[F.sum(x * F.col("tokens")).alias(f"c{i}") for i, x in enumerate(
        [F.lit(1.0), *p, *[p[d] * p[e] for d in k for e in k]])]).orderBy(*[f"cell{d}" for d in k[:-1]]).collect()
    table = np.array([r[len(k) - 1:] for r in found], float).reshape(len(found), 1 + len(k) + len(k) ** 2)
    table = table[table[:, 0] > 0]
    size, gram = table[:, 1:len(k) + 1].sum(axis=0), table[:, len(k) + 1:].sum(axis=0).reshape(len(k), len(k))
    goal = np.array(targets(size.tolist(), weights or WEIGHTS, most=most))
    now = _Steps(size, gram, goal)
    taken = _cell_steps(table[:, 1:len(k) + 1] / table[:, :1], table[:, 0], now, most, steps, close / 20)
    state = materialize(_follow(rows, taken, most), "rates")
    found = sums(state, [*[F.col("_r") * x for x in p], *[F.col("_y") * x for x in p]])
    now.total, now.ahead, now.speed = found[:len(k)], found[len(k):], 1.0
    left = float("inf")
    for done in range(len(taken) + 1, steps + 1):
        moved = state.withColumn("_new", _rate([now.move().tolist()], most, F.col("_y")))
        back = F.col("_y") - F.col("_new")
        found = sums(moved, [*[F.col("_new") * x for x in p], *[F.abs(back) * x for x in p],
                             back * (F.col("_new") - F.col("_r"))])
        left = now.left(found[len(k):-1])
        if left <= close:
            return moved.withColumn("rate", F.col("_new")).drop("_r", "_y", "_new")
        momentum = now.go(found[:len(k)], found[-1])
        state = moved.withColumns({"_r": F.col("_new"), "_y": F.col("_new") + F.lit(momentum) * (
            F.col("_new") - F.col("_r"))}).drop("_new")
        if done % EVERY == 0:
            state = materialize(state, "rates")
    raise RuntimeError(f"mixing rates: projected gradient {left:.2e} after {steps} steps, over {close:.0e}")


def mixing_rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None,
                 sample: int = SAMPLE, steps: int = STEPS, close: float = CLOSE, most: float = 1.0) -> DataFrame:
    """``doc_id, tokens, p0, p1, .. , rate, copies`` for each row; no rate is above ``most``.

    ``steps`` and ``close`` as in ``solve_rates``. ``copies`` is the rate rounded up or down by a draw that is a
    hash of the id, so that its expectation is the rate. Empty and null texts
    have no words but a rate like others. Repeated rows are rows of their own
    with equal draws; null ids share one. An empty table gives no rows.
    """
    rows = materialize(domain_posteriors(docs, labels, sample).select(
        "doc_id", "tokens", *[F.col("p")[d].alias(f"p{d}") for d in range(len(DOMAINS))]), "posteriors")
    draw = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.lit("copies")), 11) / F.lit(2.0 ** 53)
    rated = solve_rates(rows, weights, steps, close, most)
    return rated.withColumn("copies", (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("int")).cast("int"))


def apply_mix(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """``docs`` with each row as often as its copies say; all columns kept, whatever their names.

    Rows without an id are in as they are. The copies of an id are taken from
    its first rates if it repeats. If no document has words of the main domain,
    all targets are zero and only rows without words or id stay.
    """
    key, copies, copy = free_names(docs, "id", "copies", "copy")
    found = (mixing_rates(docs, labels, **how).where("doc_id is not null").groupBy(F.col("doc_id").alias(key))
             .agg(F.max("copies").alias(copies)))
    joined = docs.join(found, docs["doc_id"].cast("bigint") == F.col(key), "left")
    times = F.when(F.col(key).isNull(), 1).otherwise(F.col(copies))
    return joined.where(times > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), times))).drop(key, copies, copy)
