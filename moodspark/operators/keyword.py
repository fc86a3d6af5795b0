"""Keyword emotion scorer (J1: H24, H25, C9, D11, G2).

Rule: lower-case the text, take runs of Unicode word characters; for each
label, every word occurrence adds the length of the first of the label's
stems that it matches (equal, word starts with stem, or stem starts with
word). The best label is the first with the strictly highest sum; with no
match at all the result is neutral at confidence 0.1.

Plan: one regular expression finds the words that can match (short prefixes of
stems, and words with a stem's first letters); those are exploded and weighed
against the literal 37-stem table by codegen'd CASE columns, then summed per text
with map-side partial aggregation. No join, no word-keyed shuffle: a frequent
word is never a hot key, and one text's words stay in its scan task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed

WORD_PATTERN = r"[\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    """Lower case, runs of Unicode letters, digits and underscore."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD_PATTERN), 0)


HEAD = 3        # every stem has as many characters at least


def _heads() -> tuple[list[str], list[str]]:
    """What a word that can match begins with, and the shorter words that can."""
    stems = [s for _, _, _, s in fixed.label_stems()]
    assert min(len(s) for s in stems) >= HEAD
    return sorted({s[:HEAD] for s in stems}), sorted({s[:k] for s in stems for k in range(1, HEAD)})


def _candidate_pattern() -> str:
    """A whole word that can match some stem. The first letter is tested before the look-behind: most places fail there."""
    heads, short = _heads()
    first = sorted({h[0] for h in heads})
    tails = "|".join(f"{c}(?:{'|'.join(h[1:] for h in heads if h[0] == c)})" for c in first)
    word = r"\p{L}\p{N}_"
    # a letter beyond the basic plane makes Java look behind by code points
    return (rf"(?=[{''.join(first)}])(?<![{word}{chr(0x10000)}])(?:(?:{tails})[{word}]*+"
            rf"|(?:{'|'.join(reversed(short))})(?![{word}]))")


def _match(t: Column, stem: str) -> Column:
    return t.startswith(stem) | F.startswith(F.lit(stem), t)


def label_weight(t: Column, label: str) -> Column:
    """Weight of one word for one label: length of the first matching stem, else 0."""
    out = F.lit(0)
    for stem in reversed(fixed.stems_of(label)):
        out = F.when(_match(t, stem), F.lit(len(stem))).otherwise(out)
    return out


def candidate_words(text: Column) -> Column:
    """Words that can match some stem: a prefix of a stem, or sharing a stem's first 3 letters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_candidate_pattern()), 0)


def keyword_sums(df: DataFrame, key: list[str], text_col: str = "text") -> DataFrame:
    """(key..., _kw_sums array<long>): the 28 label sums per text.

    Candidate words are exploded (a narrow generator; most words are dropped
    by the InSet pre-filter), weighed by codegen'd CASE columns, and summed
    per key. Partial aggregation runs in the scan task, so the shuffle
    carries one row of 28 longs per text and map task, never the words.
    A text without candidates still yields one row (explode_outer).
    """
    w = df.select(*key, F.explode_outer(candidate_words(F.col(text_col))).alias("_w"))
    weights = [F.coalesce(label_weight(F.col("_w"), lab), F.lit(0)).alias(f"_k{i}")
               for i, lab in enumerate(fixed.LABELS)]
    w = w.select(*key, *weights)
    sums = w.groupBy(*key).agg(*[F.sum(f"_k{i}").alias(f"_k{i}") for i in range(len(fixed.LABELS))])
    return sums.select(*key, F.array(*[F.col(f"_k{i}") for i in range(len(fixed.LABELS))]).alias("_kw_sums"))


def argmax_first(v: Column) -> Column:
    """1-based index of the first maximum (lowest index wins ties)."""
    return F.array_position(v, F.array_max(v)).cast("int")


def label_names() -> Column:
    return F.array(*[F.lit(x) for x in fixed.LABELS])


def keyword_score(df: DataFrame, key: str | list[str], text_col: str = "text",
                  keep_sums: bool = False) -> DataFrame:
    """J1 on a text table keyed by ``key``.

    Returns (key..., predicted_emotion, confidence, match_score, model_name,
    task_type); join it back to the source by key. Rows with a NULL key are
    not scored.
    """
    key = [key] if isinstance(key, str) else list(key)
    sums = "_kw_sums"
    has_key = F.lit(True)
    for k in key:
        has_key = has_key & F.col(k).isNotNull()
    out = keyword_sums(df.where(has_key), key, text_col)
    best = F.array_max(F.col(sums))
    label = F.when(best > 0, F.element_at(label_names(), argmax_first(F.col(sums)))).otherwise(
        F.lit(fixed.DEFAULT_LABEL))
    out = out.withColumns({
        "predicted_emotion": label,
        "confidence": F.when(best > 0, F.lit(fixed.KEYWORD_CONF_MATCH)).otherwise(F.lit(fixed.KEYWORD_CONF_NONE)),
        "match_score": best.cast("long"),
        "model_name": F.lit(fixed.KEYWORD_MODEL_NAME),
        "task_type": F.lit("multi_label"),
    })
    if keep_sums:
        return out.withColumnRenamed(sums, "keyword_sums")
    return out.drop(sums)


def _labels_by_head() -> tuple[list[str], Column]:
    """The labels that have stems, and for the first letters of a word (or a short word) the labels it can match with their stems."""
    labels = [lab for lab in fixed.LABELS if fixed.stems_of(lab)]       # the others never have a sum
    heads, short = _heads()

    def near(head: str) -> Column:
        return F.array(*[F.struct(F.lit(i).alias("label"), F.array(*[F.lit(s) for s in fixed.stems_of(lab)]).alias("stems"))
                         for i, lab in enumerate(labels) if any(s.startswith(head) for s in fixed.stems_of(lab))])

    return labels, F.create_map(*[c for h in short + heads for c in (F.lit(h), near(h))])


def keyword_labels(df: DataFrame, words: Column | str) -> DataFrame:
    """J1 within the row, from its :func:`candidate_words`: ``predicted_emotion, confidence`` added, nothing grouped.

    For many short texts per row of a source, where the rows of sums of
    :func:`keyword_score` would outweigh the texts. The words of joined texts are those of each, one after the other.
    """
    labels, by_head = _labels_by_head()

    def hits(w):
        return F.transform(F.try_element_at(by_head, F.substring(w, 1, HEAD)), lambda x: F.struct(
            x["label"].alias("label"), F.length(F.try_element_at(F.filter(
                x["stems"], lambda s: w.startswith(s) | s.startswith(w)), F.lit(1))).cast("bigint").alias("n")))

    out = df.withColumn("_kw_hits", F.filter(F.flatten(F.transform(words, hits)), lambda x: x["n"].isNotNull()))
    # label sums of the row; the greatest struct has the highest sum, of equal ones the first label
    sums = F.transform(F.array_distinct(F.transform("_kw_hits", lambda x: x["label"])), lambda i: F.struct(
        F.aggregate("_kw_hits", F.lit(0).cast("bigint"), lambda acc, x: acc + F.when(x["label"] == i, x["n"]).otherwise(0)).alias("n"),
        (-i).alias("i")))
    out = out.withColumn("_kw_best", F.when(F.size("_kw_hits") > 0, F.array_max(sums)))
    found = F.col("_kw_best").isNotNull()
    return out.withColumns({
        "predicted_emotion": F.when(found, F.get(F.array(*[F.lit(x) for x in labels]), -F.col("_kw_best.i")))
        .otherwise(F.lit(fixed.DEFAULT_LABEL)),
        "confidence": F.when(found, F.lit(fixed.KEYWORD_CONF_MATCH)).otherwise(F.lit(fixed.KEYWORD_CONF_NONE)),
    }).drop("_kw_hits", "_kw_best")


def one_hot_scores(label: Column) -> Column:
    """Scores map of the keyword scorer: 1.0 for the chosen label, 0.0 elsewhere."""
    return F.map_from_arrays(label_names(), F.transform(label_names(), lambda x: F.when(x == label, 1.0).otherwise(0.0)))
