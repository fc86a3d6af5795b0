"""Chunking, windowing, pooling and label vectors.

Texts become chunk rows (one per chunk or window) so a scorer runs on Spark
partitions; chunk score vectors are pooled per text with a (text, position)
hash aggregate; vectors are never collected beyond their own dimension.

A scorer is ``(DataFrame(keys..., text), keys) -> DataFrame(keys..., scores
array<double>)``. Texts are hash-partitioned by their key once; chunk rows,
scoring and pooling are keyed by (key, ...) and reuse that partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as TX
from . import keyword as K

Scorer = Callable[[DataFrame, list], DataFrame]


# ------------------------------------------------------------------ E5 packing

def pack_sentences(sent_tokens: Column, budget: int = fixed.CHUNK_BUDGET,
                   specials: int = fixed.SPECIAL_TOKENS) -> Column:
    """E5: greedy packing of (sentence, n) structs into chunks, as a sequential fold.

    Close the current chunk when ``cur + n - specials > budget``; the first
    sentence of a chunk counts n, later ones n - specials. Returns
    array<struct<first:int, last:int, n_tokens:int>> of 1-based sentence
    positions within the input array.
    """
    chunk_t = "struct<first:int,last:int,n_tokens:int>"
    init = F.struct(F.array().cast(f"array<{chunk_t}>").alias("done"),
                    F.lit(0).alias("first"), F.lit(0).alias("last"),
                    F.lit(0).alias("cur"), F.lit(0).alias("i"))

    def step(acc, s):
        i = acc["i"] + 1
        n = s["n"]
        empty = acc["last"] == 0
        close = (acc["cur"] + n - specials > budget) & ~empty
        closed = F.struct(acc["first"].alias("first"), acc["last"].alias("last"),
                          acc["cur"].alias("n_tokens")).cast(chunk_t)
        return F.when(close, F.struct(
            F.concat(acc["done"], F.array(closed)).alias("done"),
            i.alias("first"), i.alias("last"), n.alias("cur"), i.alias("i"))).otherwise(F.struct(
                acc["done"].alias("done"),
                F.when(empty, i).otherwise(acc["first"]).alias("first"), i.alias("last"),
                (acc["cur"] + F.when(empty, n).otherwise(n - specials)).alias("cur"), i.alias("i")))

    def finish(acc):
        last = F.struct(acc["first"].alias("first"), acc["last"].alias("last"),
                        acc["cur"].alias("n_tokens")).cast(chunk_t)
        return F.when(acc["last"] > 0, F.concat(acc["done"], F.array(last))).otherwise(acc["done"])

    return F.aggregate(sent_tokens, init, step, finish)


def sentence_chunks(df: DataFrame, key: str, text_col: str = "text",
                    count: Callable[[Column], Column] = TX.token_count) -> DataFrame:
    """E5 + H16 on a text table: (key, chunk_id, chunk_text, n_sentences, n_tokens).

    Blank sentences are skipped; a text without sentences is one chunk of
    itself. ``count`` gives a sentence's token count including specials.
    """
    sents = F.filter(TX.sentences(F.col(text_col)), lambda s: ~TX.is_blank(s))
    with_n = F.transform(sents, lambda s: F.struct(s.alias("s"), count(s).alias("n")))
    packed = df.select(key, text_col, with_n.alias("_sn")).withColumn("_chunks", pack_sentences(F.col("_sn")))
    rows = packed.select(key, text_col, "_sn", F.posexplode_outer("_chunks").alias("_pos", "_c"))
    chunk_text = F.array_join(F.transform(
        F.slice("_sn", F.col("_c.first"), F.col("_c.last") - F.col("_c.first") + 1), lambda x: x["s"]), " ")
    return rows.select(
        key, F.coalesce(F.col("_pos"), F.lit(0)).alias("chunk_id"),
        F.when(F.col("_c").isNull(), F.col(text_col)).otherwise(chunk_text).alias("chunk_text"),
        F.coalesce(F.col("_c.last") - F.col("_c.first") + 1, F.lit(0)).alias("n_sentences"),
        F.coalesce(F.col("_c.n_tokens"), count(F.col(text_col))).alias("n_tokens"))


# ------------------------------------------------------------------ E6 windows

def window_starts(n_tokens: Column, content: int = fixed.MAX_POSITIONS - fixed.SPECIAL_TOKENS,
                  overlap: int = fixed.WINDOW_OVERLAP) -> Column:
    """1-based starts of overlapping windows of ``content`` tokens sharing ``overlap``."""
    return F.sequence(F.lit(1), F.greatest(n_tokens - overlap, F.lit(1)), F.lit(content - overlap))


def token_windows(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """E6 on a text table: (key, chunk_id, start_pos, n_tokens, window_text)."""
    content = fixed.MAX_POSITIONS - fixed.SPECIAL_TOKENS
    t = df.select(key, TX.basic_tokens(F.col(text_col)).alias("_toks"))
    w = t.select(key, "_toks", F.posexplode(window_starts(F.size("_toks"))).alias("chunk_id", "start_pos"))
    win = F.slice("_toks", F.col("start_pos"), F.lit(content))
    return w.select(key, "chunk_id", "start_pos", F.size(win).alias("n_tokens"),
                    F.array_join(win, " ").alias("window_text"))


# ------------------------------------------------------------------ vectors

def sigmoid(v: Column) -> Column:
    """H26 multi-label: element-wise logistic."""
    return F.transform(v, lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x.cast("double"))))


def softmax(v: Column) -> Column:
    """H26 single-label: exp(x - max) / sum."""
    m = F.array_max(v)
    e = F.transform(v, lambda x: F.exp(x.cast("double") - m))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def label_for(idx1: Column) -> Column:
    """Label name for a 1-based index, ``label_{i}`` past the vocabulary."""
    return F.coalesce(F.get(K.label_names(), idx1 - 1),
                      F.concat(F.lit("label_"), (idx1 - 1).cast("string")))


def label_map(v: Column) -> Column:
    """Vector -> map label -> score."""
    names = F.transform(F.sequence(F.lit(1), F.size(v)), label_for)
    return F.map_from_arrays(names, v)


def mean_pool(vectors: DataFrame, key: str | list[str], vec_col: str) -> DataFrame:
    """Unweighted element-wise mean of the vectors of each key.

    Elements are exploded and averaged per (key, position) with partial
    aggregation, then reassembled; the regrouped array has the vector's own
    dimension, so no group grows with the number of vectors.
    """
    key = [key] if isinstance(key, str) else list(key)
    e = vectors.select(*key, F.posexplode(vec_col).alias("_i", "_x"))
    m = e.groupBy(*key, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return m.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("_i", "_m"))).alias("_v")).select(
        *key, F.transform("_v", lambda s: s["_m"]).alias(vec_col))


def argmax_label(v: Column) -> Column:
    """D11 on a vector: struct(index (0-based), label, score); first maximum wins."""
    i = K.argmax_first(v)
    return F.struct((i - 1).alias("index"), label_for(i).alias("label"), F.element_at(v, i).alias("score"))


# ------------------------------------------------------------------ J2 / J3 plans

def keyword_vector_scorer(df: DataFrame, keys: list) -> DataFrame:
    """Default scorer: the keyword scorer's one-hot vector over the 28 labels."""
    s = K.keyword_score(df, keys)
    onehot = F.transform(K.label_names(), lambda x: F.when(x == F.col("predicted_emotion"), 1.0).otherwise(0.0))
    return s.select(*keys, onehot.alias("scores"))


def pooled_prediction(chunk_scores: DataFrame, key: str) -> DataFrame:
    """Mean-pool chunk vectors per text, then argmax and label map."""
    pooled = mean_pool(chunk_scores, key, "scores")
    best = argmax_label(F.col("scores"))
    return pooled.select(key, best.label.alias("predicted_emotion"), best.score.alias("confidence"),
                         label_map(F.col("scores")).alias("scores"))


def score_chunked(df: DataFrame, key: str, scorer: Scorer = keyword_vector_scorer,
                  text_col: str = "text") -> DataFrame:
    """Chunk each text, score chunks, pool per text, pick the label."""
    ch = sentence_chunks(df.select(key, text_col).repartition(key), key, text_col)
    scored = scorer(ch.select(key, "chunk_id", F.col("chunk_text").alias("text")), [key, "chunk_id"])
    return pooled_prediction(scored.select(key, "scores"), key)


def score_windows(df: DataFrame, key: str, scorer: Scorer = keyword_vector_scorer,
                  text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Window timeline (one prediction per window) and the pooled result."""
    w = token_windows(df.select(key, text_col).repartition(key), key, text_col)
    scored = scorer(w.select(key, "chunk_id", F.col("window_text").alias("text")), [key, "chunk_id"])
    best = argmax_label(F.col("scores"))
    timeline = scored.select(key, "chunk_id", best.label.alias("label"), best.score.alias("score"), "scores")
    return timeline, pooled_prediction(timeline.select(key, "scores"), key)


def top_labels(scores: Column, k: int = 3) -> Column:
    """the ``k`` highest entries of a label -> score map as
    array<struct<label, score>>; equal scores keep map order."""
    e = F.transform(F.map_entries(scores), lambda x, i: F.struct(i.alias("i"), x["key"].alias("label"),
                                                                  x["value"].cast("double").alias("score")))
    e = F.filter(e, lambda x: x["score"].isNotNull())
    srt = F.array_sort(e, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1)
                       .otherwise(a["i"] - b["i"]))
    return F.transform(F.slice(srt, 1, k), lambda x: F.struct(x["label"].alias("label"), x["score"].alias("score")))


def blank_safe_scores(df: DataFrame, key: str, scorer: Scorer = keyword_vector_scorer,
                      text_col: str = "text") -> DataFrame:
    """B10 + J3 batch form: blank texts get ``error`` and no scores; others are scored."""
    from ..functions.exprs import py_strip
    blank = py_strip(F.coalesce(F.col(text_col), F.lit(""))) == ""
    ok = df.where(~blank)
    _, pooled = score_windows(ok, key, scorer, text_col)
    errs = df.where(blank).select(key, F.lit(fixed.EMPTY_TEXT_ERROR).alias("error"))
    return pooled.withColumn("error", F.lit(None).cast("string")).unionByName(errs, allowMissingColumns=True)
