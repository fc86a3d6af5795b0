"""Quality by co-training two views of a document.

One classifier sees the text's content (terms, word shapes, repetition), the
other the record's metadata (language, source, recorded length) and layout
figures. In every round both label all unlabelled documents, in one pass over
the corpus, and each hands its most confident labels to the other. Both are then
calibrated on labelled rows kept apart, and the mean of their calibrated log-odds
scores every document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names, materialize
from .features import TextFeatures, buckets, chosen, gather, hashed, slices, style_features
from .linear import fit_softmax, ragged_scores, scores, sigmoid

SAMPLE = 12_000
EXCHANGED = 1_000
ROUNDS = 3
CONFIDENT = 0.98
VIEWS = ["text", "lang", "source", "n_chars"]
SCORES = ["_text_score", "_metadata_score", "_score"]


def _named(name: str, values: pa.Array) -> np.ndarray:
    """Feature ids of a column's values; null is a value of its own."""
    code, found = pd.factorize(np.asarray(pc.cast(values, pa.string()).to_pylist(), object), use_na_sentinel=False)
    return np.array([hashed(f"{name} {None if pd.isna(v) else v}") for v in found], np.int64)[code]


def metadata_features(part: pa.RecordBatch, f: TextFeatures) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the record's metadata and of the layout of its text; nulls are values of their own."""
    n = np.maximum(1, f.words.counts())
    lines = np.asarray(pc.count_substring(f.texts, "\n")).astype(np.int64) + 1
    size = np.nan_to_num(pc.cast(part["n_chars"], pa.float64()).to_numpy(zero_copy_only=False), nan=-1.0)
    figures = (("recorded", size), ("lines", lines), ("words in a line", n / lines), ("word size", f.words.sums(f.of_word["size"]) / n),
               ("upper", f.share("caps")), ("symbols", f.share("marks")), ("digits", f.share("digits")),
               ("distinct", f.distinct_share()))
    return f.ragged([], [_named("lang", part["lang"]), _named("source", part["source"]),
                         buckets("no size", (size < 0).astype(float)), *[buckets("m " + k, v) for k, v in figures]])


def _views(part: pa.RecordBatch, f: TextFeatures) -> list:
    return [style_features(f), metadata_features(part, f)]


def _margin(rows: list[np.ndarray], model: tuple) -> np.ndarray:
    z = scores(rows, model)
    return z[:, 1] - z[:, 0]


def _margins(part: pa.RecordBatch, f: TextFeatures, models: list[tuple]) -> list[np.ndarray]:
    """Margin of every row of a slice by the model of each view."""
    found = [ragged_scores(r, m) for r, m in zip(_views(part, f), models)]
    return [(z[:, 1] - z[:, 0]).astype(np.float64) for z in found]


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that turn a margin into log-odds, by Newton steps on the logistic loss with a weak prior."""
    a, b = 1.0, 0.0
    for _ in range(25):
        p = sigmoid(a * margin + b)
        g = np.array([((p - y) * margin).sum() + 0.1 * (a - 1), (p - y).sum() + 0.1 * b])
        v = p * (1 - p)
        h = np.array([[(v * margin * margin).sum() + 0.1, (v * margin).sum()], [(v * margin).sum(), v.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return float(max(a, 0.0)), float(b)


#: From the models of both views and the round: for each view the features, in the other view's terms, and the labels it hands over.
Exchange = Callable[[list, int], list[tuple[list[np.ndarray], list[int]]]]


def pool_exchange(pool: list[list[np.ndarray]], rounds: int, confident: float) -> Exchange:
    """Exchange over an unlabelled pool in memory: a growing share of it, the most confident first."""
    given: list[dict[int, int]] = [{}, {}]

    def exchange(models: list, r: int) -> list[tuple[list[np.ndarray], list[int]]]:
        for v in (0, 1):
            p = sigmoid(_margin(pool[v], models[v]))
            for label, sure in ((1, p), (0, 1 - p)):
                found = np.flatnonzero(sure >= confident)
                best = found[np.argsort(-sure[found], kind="stable")][:len(p) * (r + 1) // (2 * rounds)]
                given[v] |= {int(i): label for i in best}
        return [([pool[1 - v][i] for i in given[v]], list(given[v].values())) for v in (0, 1)]

    return exchange


def most_confident(docs: DataFrame, labels: DataFrame, models: list[tuple], most: int, confident: float) -> DataFrame:
    """``_id, view, label``: of each view and label the ``most`` unlabelled documents it is surest of, at least ``confident``.

    One pass over all rows with an id. Documents with the same margin are as a
    rule copies of one text: the smallest id stands for all of them. Ties by id.
    """
    fitted = docs.sparkSession.sparkContext.broadcast(models)
    least = float(np.log(confident / (1 - confident)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, f in slices(batch):
                for v, margin in enumerate(_margins(part, f, fitted.value)):
                    sure = np.abs(margin) >= least
                    n = int(sure.sum())
                    yield pa.RecordBatch.from_arrays(
                        [part["_id"].filter(pa.array(sure)), pa.array(np.full(n, v, np.int32)),
                         pa.array((margin[sure] > 0).astype(np.int32)), pa.array(np.abs(margin[sure]))],
                        ["_id", "view", "label", "margin"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("_id"), *VIEWS).where("_id is not null").mapInArrow(
        run, "_id bigint, view int, label int, margin double")
    labelled = labels.select(F.col("doc_id").cast("bigint").alias("_id")).where("_id is not null").distinct()
    # written once: the four selections below would each score the corpus again
    one_each = materialize(rows.join(labelled, "_id", "left_anti").groupBy("view", "label", "margin").agg(
        F.min("_id").alias("_id")), "margins")
    best = None
    for v in (0, 1):
        for label in (0, 1):
            mine = one_each.where((F.col("view") == v) & (F.col("label") == label))
            top = mine.orderBy(F.desc("margin"), "_id").limit(most).select("_id", "view", "label")
            best = top if best is None else best.unionByName(top)
    return best


def corpus_exchange(docs: DataFrame, labels: DataFrame, most: int = EXCHANGED, confident: float = CONFIDENT) -> Exchange:
    """Exchange over all unlabelled documents: a pass scores them all, at most 4 * ``most`` come back a round."""
    given: list[dict[int, int]] = [{}, {}]
    known: dict[int, list[np.ndarray]] = {}
    spark = docs.sparkSession

    def exchange(models: list, r: int) -> list[tuple[list[np.ndarray], list[int]]]:
        for row in sorted(most_confident(docs, labels, models, most, confident).collect()):
            given[row["view"]][row["_id"]] = row["label"]
        new = sorted({i for g in given for i in g} - set(known))
        views, _, ids = gather(docs, spark.createDataFrame([(i,) for i in new], "_id bigint"), [], _views, VIEWS, views=2)
        known.update(zip(ids, zip(*views)))
        return [([known[i][1 - v] for i in given[v]], list(given[v].values())) for v in (0, 1)]

    return exchange


def co_train(views: list[list[np.ndarray]], y: np.ndarray, pool: list[list[np.ndarray]] | Exchange, rounds: int = ROUNDS,
             confident: float = CONFIDENT) -> list[tuple[tuple, float, float]]:
    """(model, slope, intercept) of each view. Every fifth labelled row only calibrates."""
    if not len(y):
        return [(fit_softmax([], y, 2), 1.0, 0.0)] * 2
    exchange = pool if callable(pool) else pool_exchange(pool, rounds, confident)
    held = np.arange(len(y)) % 5 == 4
    if held.sum() < 2:
        held[:] = False
    train = [[v[i] for i in np.flatnonzero(~held)] for v in views]
    models: list = []
    handed: list[tuple[list[np.ndarray], list[int]]] = [([], []), ([], [])]
    for r in range(rounds + 1):
        # what a view hands over trains the other one
        models = [fit_softmax(train[v] + handed[1 - v][0], np.concatenate([y[~held], np.array(handed[1 - v][1], np.int64)]), 2,
                              np.concatenate([np.ones((~held).sum()), np.full(len(handed[1 - v][1]), 0.5)])) for v in (0, 1)]
        if r < rounds:
            handed = exchange(models, r)
    at = held if held.any() else np.ones(len(y), bool)
    return [(models[v], *_platt(_margin([views[v][i] for i in np.flatnonzero(at)], models[v]), y[at])) for v in (0, 1)]


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, exchanged: int = EXCHANGED,
                  rounds: int = ROUNDS, names: list[str] | None = None) -> DataFrame:
    """``docs`` with ``_text_score, _metadata_score, _score``: probabilities that quality is 1.

    The classifiers are fitted on at most ``sample`` labelled rows, in the order
    of a hash of the id, and in each of ``rounds`` rounds on the ``exchanged``
    documents of each view and label that a pass over all unlabelled rows found
    surest. Every row is scored on its whole text, in slices of a few MB. Nulls
    are values of their own; a null text counts as empty; rows without an id are
    scored, but not exchanged. Without usable labels all scores are 0.5. An empty
    table gives no rows. ``names`` renames the three added columns; columns of
    ``docs`` that have an added name are replaced.
    """
    names = names or SCORES
    spark = docs.sparkSession
    ids = chosen(labels, ["quality"], sample)
    views, y, _ = gather(docs, ids, ["quality"], _views, VIEWS, views=2)
    fitted = spark.sparkContext.broadcast(
        co_train(views, y[:, 0] if len(y) else y, corpus_exchange(docs, labels, exchanged), rounds))
    fields = [f for f in docs.schema.fields if f.name.lower() not in {n.lower() for n in names}]
    kept = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, slopes, intercepts = zip(*fitted.value)
        for batch in batches:
            for part, f in slices(batch):
                odds = np.stack([a * m + b for m, a, b in zip(_margins(part, f, models), slopes, intercepts)])
                found = [sigmoid(odds[0]), sigmoid(odds[1]), sigmoid(odds.mean(axis=0))]
                yield pa.RecordBatch.from_arrays([*[part[c] for c in kept], *map(pa.array, found)], [*kept, *names])

    schema = T.StructType([*fields, *[T.StructField(n, T.DoubleType()) for n in names]])
    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, **how) -> DataFrame:
    """``docs`` without the rows whose score is below ``least``; all columns kept, whatever their names."""
    names = free_names(docs, *SCORES)
    return score_quality(docs, labels, names=names, **how).where(F.col(names[2]) >= least).drop(*names)
