"""Toxicity by a factorization machine over hashed terms.

The score is a constant, a weight per term and, for each pair of terms, the
product of their factor vectors: an insult and the mention of a group can
count together for more than the sum of both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import TextFeatures, chosen, gather, slices, term_features
from .linear import fit_machine, machine_score, numbered, sigmoid

SAMPLE = 12_000
FOLDS = 5


def held_out(id_col: Column, folds: int = FOLDS) -> Column:
    """Whether crc32 of the id as text is divisible by ``folds``; a null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(False))


def _terms(part: pa.RecordBatch, f: TextFeatures) -> list:
    return [term_features(f)]


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, factors: int = 6) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    The machine is fitted on at most ``sample`` labelled rows that are not held
    out, taken in the order of a hash of the id; only the text is read for a
    score. Null and empty texts have a score like others. Without usable labels
    every score is 0.5. Further columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ids = chosen(labels, ["toxic"], sample, ~held_out(F.col("doc_id")))
    (rows,), y, _ = gather(docs, ids, ["toxic"], _terms, ["text"])
    model = spark.sparkContext.broadcast(fit_machine(rows, y[:, 0] if len(y) else y, factors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table, constant = model.value
        for batch in batches:
            for part, f in slices(batch):
                offsets, idx = term_features(f)
                score = sigmoid(machine_score(table[numbered(idx, known)], offsets[:-1]) + constant).astype(np.float64)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["held_out"], pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"])

    doc = F.col("doc_id").cast("bigint")
    return docs.select(doc.alias("doc_id"), held_out(doc).alias("held_out"), "text").mapInArrow(
        run, "doc_id bigint, held_out boolean, score double, predicted int")
