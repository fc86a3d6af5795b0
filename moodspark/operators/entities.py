"""Entity sentiment (J5, J6: C10, C11, D9, D15, E3, E4, H17-H22, B11).

Plan per text table. Names are found, cleaned and chosen on light rows (key,
sentence number, name, and a digest in the place of the sentence); these are
partitioned by key once. Texts are joined to the chosen names of their key once,
and every later step groups by that key:

1. sentences as rows, each with its raw neighbours (in-row ``arrays_zip``,
   no window) - blank pieces keep their index but produce nothing;
2. mention finding (C11): every capitalised run of every white-space piece, and
   every name of 2..n words that runs from one piece to a later one, is looked up
   in the caller's gazetteer by an equi join (Spark picks the strategy from its
   bytes); n is the gazetteer's own longest name. From left to right the longest
   name at a place wins. A caller's tagger can take the gazetteer's place with
   spans (word, label, start, end) per sentence;
3. clean-up, stop list and keep-first dedupes (D15) by ranking mention rows,
   linear in the mentions of a sentence but for the sort;
4. carry-forward (C10): a pronoun sentence without entities takes the last
   PER of the most recent earlier sentence with a PER, if <= 2 back: a
   ``last(ignorenulls)`` window over the entity/pronoun sentences of one text;
5. clause targeting (H17/H18), scoring with context fallback (E3/E4) by the
   keyword rule or a pluggable scorer: each clause and its context are scored
   once for all the targets in the clause.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as TX
from ..functions.exprs import bucket
from . import insights as I
from . import keyword as K

CAP_WORD = r"\p{Lu}\p{Ll}+"
RUNS_IN_PIECE = 1_000_000       # spacing of mention numbers between pieces
SENTENCE_TEXTS = ["sentence", "prev_sentence", "next_sentence"]
NAME_WORDS = 1_000              # within a piece: longer names first, single ones from here on

# A label scorer: (DataFrame(keys..., text), keys) -> DataFrame(keys..., predicted_emotion, confidence).
LabelScorer = Callable[[DataFrame, list], DataFrame]


def keyword_label_scorer(df: DataFrame, keys: list) -> DataFrame:
    return K.keyword_score(df, keys).select(*keys, "predicted_emotion", "confidence")


def sentence_rows(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """H16 as rows: (key, sentence_idx, sentence, prev_sentence, next_sentence).

    ``sentence_idx`` counts every split piece, blank ones included; blank
    sentences are dropped after the neighbours are attached (E3 uses the raw
    neighbours, blank or not).
    """
    s = df.select(key, TX.sentences(F.col(text_col)).alias("_s"))
    n = F.size("_s")
    prev = F.concat(F.array(F.lit(None).cast("string")), F.slice("_s", 1, F.greatest(n - 1, F.lit(0))))
    nxt = F.concat(F.slice("_s", 2, F.greatest(n - 1, F.lit(0))), F.array(F.lit(None).cast("string")))
    z = F.arrays_zip(F.col("_s").alias("sentence"), prev.alias("prev_sentence"), nxt.alias("next_sentence"))
    return (s.select(key, F.posexplode(z).alias("sentence_idx", "_z"))
            .select(key, "sentence_idx", "_z.sentence", "_z.prev_sentence", "_z.next_sentence")
            .where(~TX.is_blank(F.col("sentence"))))


def expanded_runs(sents: DataFrame, key: str) -> DataFrame:
    """H20 for every capitalised run of each sentence: (key, sentence_idx, start, word, expanded).

    No run crosses white space, so a run is widened to the piece that holds it:
    each sentence is cut once, whatever the number of its runs.
    """
    pieces = sents.select(key, "sentence_idx", F.regexp_extract_all(
        "sentence", F.lit(f"[^{TX.JAVA_WS}]+|[{TX.JAVA_WS}]+"), 0).alias("_p")).select(key, "sentence_idx", F.inline(F.arrays_zip(
            F.col("_p").alias("piece"), TX.running_sums(F.transform("_p", lambda x: F.length(x))).alias("end"))))
    runs = pieces.where(F.col("piece").rlike(CAP_WORD)).select(
        key, "sentence_idx", (F.col("end") - F.length("piece")).alias("at"),
        F.regexp_replace("piece", TX.ALNUM_EDGES, "").alias("expanded"),
        F.regexp_extract_all("piece", F.lit(CAP_WORD), 0).alias("r"), F.split("piece", CAP_WORD).alias("b"))
    # a run starts after what stands before it and all runs before
    size = F.zip_with("b", F.concat(F.array(F.lit("")), "r"), lambda b, r: F.length(F.coalesce(b, F.lit(""))) + F.length(r))
    return runs.select(key, "sentence_idx", "at", "expanded", F.inline(F.arrays_zip(
        F.col("r").alias("word"), TX.running_sums(size).alias("_start")))).where(F.col("word").isNotNull()).select(
        key, "sentence_idx", (F.col("at") + F.col("_start")).alias("start"), "word", "expanded")


# ------------------------------------------------------------------ C11 gazetteer

def corpus_gazetteer(docs: DataFrame, text_col: str = "text", min_docs: int = 3, max_words: int = 4) -> DataFrame:
    """Fixture: (word, label) of capitalised words and runs of up to ``max_words`` of them found in >= ``min_docs`` texts.

    A stand-in for the name list that a caller of J5 or J7 brings along; the
    operators never build one. Type by ``md5(word)`` (first 32 bits) mod 3 over
    PER, LOC, ORG. Partial aggregation per (word, doc) keeps the shuffle to
    distinct pairs.
    """
    words = docs.select("doc_id", F.explode(F.array_distinct(
        F.regexp_extract_all(F.col(text_col), F.lit(CAP_WORD), 0))).alias("word"))
    run = F.split("run", " ")
    starts = F.sequence(F.lit(1), F.size(run))
    runs = (docs.select("doc_id", F.explode(F.array_distinct(
        F.regexp_extract_all(F.col(text_col), F.lit(f"{CAP_WORD}(?: {CAP_WORD})+"), 0))).alias("run"))
        .select("doc_id", F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.lit(max_words)), lambda k: F.transform(
            F.filter(starts, lambda i: i + k - 1 <= F.size(run)), lambda i: F.array_join(F.slice(run, i, k), " "))))).alias("word"))
        .distinct())
    g = (words.union(runs).groupBy("word").agg(F.count(F.lit(1)).alias("n_docs"))
         .where(F.col("n_docs") >= min_docs))
    h = F.conv(F.substring(F.md5(F.col("word")), 1, 8), 16, 10).cast("long")
    types = F.array(*[F.lit(t) for t in fixed.ENTITY_TYPES])
    return g.select("word", F.element_at(types, (F.pmod(h, F.lit(3)) + 1).cast("int")).alias("label"))


def merge_word_pieces(mentions: DataFrame, key: str) -> DataFrame:
    """Merge ``##`` pieces into the preceding mention (gaps and islands).

    Input rows (key, sentence_idx, m_ord, word, label, start, end) from a
    piece-level tagger; a piece with no predecessor starts its own mention.
    Windows run per sentence, bounded by the sentence.
    """
    w = Window.partitionBy(key, "sentence_idx").orderBy("m_ord")
    piece = F.col("word").startswith("##")
    g = mentions.withColumn("_grp", F.sum(F.when(piece, 0).otherwise(1)).over(
        w.rowsBetween(Window.unboundedPreceding, 0)))
    body = F.when(piece, F.replace(F.col("word"), F.lit("##"), F.lit(""))).otherwise(F.col("word"))
    parts = F.sort_array(F.collect_list(F.struct(F.col("m_ord"), body.alias("b"))))
    return (g.groupBy(key, "sentence_idx", "_grp").agg(
        F.min("m_ord").alias("m_ord"),
        F.array_join(F.transform(parts, lambda x: x["b"]), "").alias("word"),
        F.min_by("label", "m_ord").alias("label"),
        F.min_by("start", "m_ord").alias("start"),
        F.max_by("end", "m_ord").alias("end")).drop("_grp"))


# ------------------------------------------------------------------ J5

def _keep_first(df: DataFrame, part: list, order: list) -> DataFrame:
    """Keep the first row per key in a given order (stable, unlike dropDuplicates)."""
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def longest_name(gaz: DataFrame) -> int:
    """Number of words of the gazetteer's longest name, 1 if it is empty: one aggregate."""
    return gaz.agg(F.max(F.size(F.split("word", " ")))).first()[0] or 1


def mention_candidates(sents: DataFrame, max_words: int) -> DataFrame:
    """C11 candidates as rows: ``m_ord, piece_idx, n_words, word, expanded`` added to each sentence row, without its texts.

    One word: any capitalised run of a white-space piece. More words: a run that
    ends a piece, whole words of letters in any case, and a run that starts the
    last piece ("Charles de Gaulle"). ``expanded`` is the piece, or all pieces,
    without non-alphanumerics at the ends. A sentence without candidates keeps
    one row of nulls. ``m_ord`` orders by piece, longer names first.
    """
    s = sents.withColumn("_p", F.split(F.col("sentence"), f"[{TX.JAVA_WS}]+"))
    # of all pieces only those with a capitalised run are looked at again
    s = s.withColumn("_caps", F.filter(F.sequence(F.lit(0), F.size("_p") - 1), lambda i: F.get("_p", i).rlike(CAP_WORD)))
    s = s.withColumn("_open", F.filter("_caps", lambda i: F.get("_p", i).rlike(f"({CAP_WORD})$")))

    def found(i, k, order, word, piece):
        return F.struct((i.cast("bigint") * RUNS_IN_PIECE + order).alias("m_ord"), i.cast("int").alias("piece_idx"),
                        k.cast("int").alias("n_words"), word.alias("word"), piece.alias("piece"))

    def single(i):
        p = F.get("_p", i)
        return F.transform(F.regexp_extract_all(p, F.lit(CAP_WORD), 0), lambda w, j: found(i, F.lit(1), j + NAME_WORDS, w, p))

    def names(k):
        last = F.filter("_open", lambda i: F.get("_p", i + k - 1).rlike(f"^({CAP_WORD})") & ((k < 3) | F.forall(
            F.slice("_p", i + 2, F.greatest(k - 2, F.lit(0))), lambda w: w.rlike(r"^\p{L}+$"))))
        return F.transform(last, lambda i: found(
            i, k, NAME_WORDS - k, F.concat_ws(" ", F.regexp_substr(F.get("_p", i), F.lit(f"({CAP_WORD})$")),
                                             F.slice("_p", i + 2, F.greatest(k - 2, F.lit(0))),
                                             F.regexp_substr(F.get("_p", i + k - 1), F.lit(f"^({CAP_WORD})"))),
            F.array_join(F.slice("_p", i + 1, k), " ")))

    every = F.flatten(F.transform("_caps", single))
    if max_words > 1:
        every = F.concat(every, F.flatten(F.transform(F.sequence(F.lit(2), F.lit(max_words)), names)))
    keep = [c for c in sents.columns if c not in SENTENCE_TEXTS]
    rows = s.select(*keep, F.explode_outer(every).alias("_c"))
    widened = F.regexp_replace(F.col("_c.piece"), TX.ALNUM_EDGES, "")
    return rows.select(*keep, "_c.m_ord", "_c.piece_idx", "_c.n_words", "_c.word",
                       F.when(widened != "", widened).otherwise(F.col("_c.word")).alias("expanded"))


def leftmost_longest(found) -> F.Column:
    """Of names (structs with ``piece_idx, n_words``) in the order of place and falling length, those that no earlier one covers.

    Only names of several words cover: a piece may hold several single ones.
    """
    kind = "array<struct<piece_idx:int,m_ord:bigint,n_words:int,word:string,label:string,expanded:string>>"
    start = F.struct(F.lit(-1).alias("until"), F.array().cast(kind).alias("kept"))

    def step(acc, x):
        until = F.when(x["n_words"] > 1, x["piece_idx"] + x["n_words"] - 1).otherwise(acc["until"])
        return F.when(x["piece_idx"] > acc["until"], F.struct(until.alias("until"), F.concat(
            acc["kept"], F.array(x)).alias("kept"))).otherwise(acc)

    return F.aggregate(found, start, step, lambda acc: acc["kept"])


def gazetteer_mentions(sents: DataFrame, gaz: DataFrame, max_words: int) -> DataFrame:
    """Each sentence row without its texts, once per name in it: ``piece_idx, place`` (``m_ord`` within the piece), ``word,
    label`` and ``wide``, the expanded name if it is another string than the word. A sentence without names keeps rows of nulls.

    What follows from these (:func:`whole_name`) no shuffle carries.
    """
    keep = [c for c in sents.columns if c not in SENTENCE_TEXTS]
    c = mention_candidates(sents, max_words).select(
        *keep, "piece_idx", (F.col("m_ord") - F.col("piece_idx").cast("bigint") * RUNS_IN_PIECE).alias("place"), "word",
        F.when(F.col("expanded") != F.col("word"), F.col("expanded")).alias("wide"))
    named = F.col("label").isNotNull()
    return c.join(gaz.select("word", "label"), "word", "left").select(
        *keep, *[F.when(named, F.col(x)).alias(x) for x in ("piece_idx", "place", "word", "label", "wide")])


def whole_name() -> F.Column:
    """Of a row of :func:`gazetteer_mentions`: struct<piece_idx, m_ord, n_words, word, label, expanded>, null without a name."""
    n_words = F.when(F.col("place") < NAME_WORDS, NAME_WORDS - F.col("place")).otherwise(1).cast("int")
    return F.when(F.col("label").isNotNull(), F.struct(
        "piece_idx", (F.col("piece_idx").cast("bigint") * RUNS_IN_PIECE + F.col("place")).alias("m_ord"),
        n_words.alias("n_words"), "word", "label", F.coalesce("wide", "word").alias("expanded")))


def tagged_mentions(sents: DataFrame, key: str, tagged: DataFrame) -> DataFrame:
    """As :func:`gazetteer_mentions`, from a tagger's spans: (key, sentence_idx, m_ord, word, label, start, end).

    Offsets count characters of the sentence from 0; ``##`` pieces are merged
    (H22) and spans widened to white space (H20). A span without offsets stands
    for its word. The tagger decides about overlaps.
    """
    spans = merge_word_pieces(tagged.select(key, "sentence_idx", "m_ord", "word", "label", "start", "end"), key)
    j = sents.join(spans, [key, "sentence_idx"], "left")
    wide = TX.expand_bounds(F.col("sentence"), F.col("start"), F.col("end"))
    return j.select(*[c for c in sents.columns if c not in SENTENCE_TEXTS], F.lit(0).alias("piece_idx"),
                    F.col("m_ord").cast("bigint").alias("place"), "word", "label", F.when(wide != "", wide).alias("wide"))


def _digest(sentence) -> F.Column:
    return F.unhex(F.md5(sentence))


def sentence_names(texts: DataFrame, key: str, gaz: DataFrame | None, text_col: str = "text",
                   max_words: int | None = None, tagged: DataFrame | None = None) -> DataFrame:
    """One row per sentence with a valid entity or a pronoun, partitioned by key: (key, sentence_idx, digest, pron, valid).

    ``digest`` stands for the sentence, whose text no shuffle carries. Names as in :func:`sentence_mentions`.
    """
    sents = sentence_rows(texts.select(key, text_col), key, text_col)
    sents = sents.withColumns({"digest": _digest(F.col("sentence")), "pron": TX.has_pronoun(F.col("sentence"))})
    sent = [key, "sentence_idx"]
    if tagged is not None:
        named = tagged_mentions(sents, key, tagged)
    else:
        named = gazetteer_mentions(sents, gaz, max_words or longest_name(gaz))
    per = named.where(F.col("label").isNotNull() | F.col("pron")).repartition(key).groupBy(*sent).agg(
        F.first("digest").alias("digest"), F.first("pron").alias("pron"), F.sort_array(F.collect_list(whole_name())).alias("found"))
    if tagged is None:
        per = per.withColumn("found", leftmost_longest(F.col("found")))
    j = per.select(*sent, "digest", "pron", F.explode_outer("found").alias("_m")).select(
        *sent, "digest", "pron", "_m.m_ord", "_m.word", "_m.label", "_m.expanded")
    j = j.withColumn("_k", F.row_number().over(Window.partitionBy(*sent, F.lower("word"), "label").orderBy("m_ord")))
    j = j.withColumn("entity", F.when(F.col("_k") == 1, TX.clean_entity_name(F.col("expanded"))))
    ok = (F.col("label").isin(fixed.ENTITY_TYPES) & (F.length("entity") > 1)
          & ~F.lower("entity").isin(fixed.ENTITY_STOP_WORDS))
    j = j.withColumn("entity", F.when(ok, F.col("entity")))
    j = j.withColumn("_k", F.row_number().over(Window.partitionBy(*sent, F.lower("entity"), "label").orderBy("m_ord")))
    valid = F.when(F.col("entity").isNotNull() & (F.col("_k") == 1), F.struct("m_ord", "entity", "label"))
    per = j.groupBy(*sent).agg(F.first("digest").alias("digest"), F.first("pron").alias("pron"),
                               F.array_sort(F.collect_list(valid)).alias("valid"))
    return per.where((F.size("valid") > 0) | F.col("pron"))


def with_sentences(rows: DataFrame, texts: DataFrame, key: str, text_col: str = "text", words: bool = False) -> DataFrame:
    """Rows (key, sentence_idx, digest, ..), one per sentence, with the sentence and its raw neighbours in the digest's place.

    One join on the key; each text is cut into sentences once. ``words`` adds the keyword scorer's words of the sentence
    and, as ``near_words``, of its neighbours: each sentence is searched once.
    """
    rest = [c for c in rows.columns if c not in (key, "sentence_idx", "digest")]
    per = rows.groupBy(key).agg(F.collect_list(F.struct("sentence_idx", "digest", *rest)).alias("_r"))
    j = texts.select(key, text_col).join(per, key).select(key, TX.sentences(F.col(text_col)).alias("_s"), "_r")
    if words:
        j = j.withColumn("_w", F.transform("_s", K.candidate_words))

    def found(i):
        none = F.array().cast("array<string>")
        return [F.get("_w", i).alias("words"), F.concat(F.coalesce(F.get("_w", i - 1), none), F.coalesce(
            F.get("_w", i + 1), none)).alias("near_words")] if words else []

    placed = F.transform("_r", lambda r: F.struct(
        r["sentence_idx"].alias("sentence_idx"), F.get("_s", r["sentence_idx"]).alias("sentence"),
        F.get("_s", r["sentence_idx"] - 1).alias("prev_sentence"), F.get("_s", r["sentence_idx"] + 1).alias("next_sentence"),
        r["digest"].alias("digest"), *[r[c].alias(c) for c in rest], *found(r["sentence_idx"])))
    return j.select(key, F.inline(placed)).where(_digest(F.col("sentence")) == F.col("digest")).drop("digest")


def sentence_mentions(texts: DataFrame, key: str, gaz: DataFrame | None, text_col: str = "text",
                      max_words: int | None = None, tagged: DataFrame | None = None) -> DataFrame:
    """One row per sentence with a valid entity or a pronoun: the sentence, its
    neighbours, ``pron`` and ``valid``, array<struct<m_ord, entity, label>> in mention order.

    Names come from ``gaz`` (word, label) or, if given, from a tagger's spans
    ``tagged``. Raw (word, label) are deduped, cleaned, filtered by type, length
    and stop list, and deduped again, each time the first by ``m_ord``.
    ``max_words`` is read from the gazetteer if it is not given.
    """
    return with_sentences(sentence_names(texts, key, gaz, text_col, max_words, tagged), texts, key, text_col)


def sentence_targets(names: DataFrame, key: str) -> DataFrame:
    """Rows of :func:`sentence_names` to (key, sentence_idx, digest, targets): what is to be scored in each sentence,
    array<struct<t_ord, std, type, is_coref>>, pronouns resolved and repeated sentences left out."""
    pers = F.filter("valid", lambda x: x["label"] == "PER")
    per = names.select("*", F.size("valid").alias("n_valid"),
                       F.try_element_at(pers, F.lit(-1)).getField("entity").alias("last_per"))
    # Last PER of the most recent earlier sentence that has one, <= 2 back
    w = Window.partitionBy(key).orderBy("sentence_idx").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.last(F.when(F.col("last_per").isNotNull(),
                            F.struct(F.col("last_per").alias("e"), F.col("sentence_idx").alias("i"))),
                     ignorenulls=True).over(w)
    s2 = per.withColumn("_carry", carried)
    is_coref = ((F.col("n_valid") == 0) & F.col("pron") & F.col("_carry").isNotNull()
                & (F.col("sentence_idx") - F.col("_carry.i") <= fixed.CARRY_MAX_DISTANCE))
    s2 = s2.withColumn("is_coref", is_coref).where((F.col("n_valid") > 0) | F.col("is_coref"))
    targets = F.when(F.col("is_coref"), F.array(F.struct(
        F.lit(0).cast("bigint").alias("m_ord"), F.col("_carry.e").alias("entity"), F.lit("PER").alias("label")))
    ).otherwise(F.col("valid"))
    t = s2.select(key, "sentence_idx", "digest", "is_coref", F.explode(targets).alias("_t")).select(
        key, "sentence_idx", "digest", "is_coref", F.col("_t.m_ord").alias("t_ord"),
        TX.capitalize_entity(F.col("_t.entity")).alias("std"), F.col("_t.label").alias("type")).where(F.col("std") != "")
    # same entity in the same sentence text once per text (first by position)
    t = _keep_first(t, [key, F.lower("std"), "digest"], ["sentence_idx", "t_ord"])
    return t.groupBy(key, "sentence_idx").agg(F.first("digest").alias("digest"), F.array_sort(
        F.collect_list(F.struct("t_ord", "std", "type", "is_coref"))).alias("targets"))


def entity_mentions(texts: DataFrame, key: str, gaz: DataFrame | None, scorer: LabelScorer | None = None,
                    text_col: str = "text", max_words: int | None = None, tagged: DataFrame | None = None,
                    context: bool = True) -> DataFrame:
    """(key, sentence_idx, t_ord, entity, type, context_sentence, predicted_emotion,
    emotion_bucket, confidence) - one row per scored target. Names as in :func:`sentence_mentions`.
    A caller that does not need ``context_sentence`` leaves it out by ``context``. Without a ``scorer`` the keyword rule
    scores within the row."""
    t = with_sentences(sentence_targets(sentence_names(texts, key, gaz, text_col, max_words, tagged), key), texts, key, text_col,
                       words=scorer is None)

    # H17/H18 target clause of each target; targets of one clause are scored together
    t = t.withColumn("_cl", TX.contrastive_clauses(F.col("sentence")))
    t = t.withColumn("_cl", F.when(F.size("_cl") > 1, F.col("_cl")).otherwise(F.array().cast("array<string>")))
    t = t.withColumn("_pc", F.try_element_at(F.filter("_cl", TX.has_pronoun), F.lit(1)))

    def clause(x):
        named = F.filter("_cl", lambda c: F.lower(c).contains(F.lower(x["std"])))
        return F.coalesce(F.when(x["is_coref"], F.col("_pc")).otherwise(F.try_element_at(named, F.lit(1))), F.col("sentence"))

    t = t.withColumn("_at", F.when(F.size("_cl") == 0, F.array_repeat(F.col("sentence"), F.size("targets"))).otherwise(
        F.transform("targets", clause)))
    found = ["words", "near_words"] if scorer is None else []
    t = t.select(key, "sentence_idx", *SENTENCE_TEXTS, "targets", "_at", *found, F.explode(F.array_distinct("_at")).alias("_clause"))
    mine = F.filter("targets", lambda x, i: F.get("_at", i) == F.col("_clause"))
    keys = [key, "sentence_idx", "targets", *(["sentence"] if context else [])]
    if scorer is None:
        # the words of a clause in its context are its own and its neighbours'
        own = F.when(F.col("_clause") == F.col("sentence"), F.col("words")).otherwise(K.candidate_words(F.col("_clause")))
        t = t.where(F.col(key).isNotNull()).select(key, "sentence_idx", mine.alias("targets"), "sentence", own.alias("words"), "near_words")
        r = K.keyword_labels(t, "words").withColumnsRenamed({"predicted_emotion": "_p1", "confidence": "_c1"})
        # a clause with a label of its own needs no context
        r = K.keyword_labels(r, F.when(_needs_context(), F.concat("words", "near_words"))).withColumnsRenamed(
            {"predicted_emotion": "_p2", "confidence": "_c2"})
    else:
        t = t.select(key, "sentence_idx", mine.alias("targets"), "sentence", "_clause",
                     F.concat_ws(" ", "prev_sentence", "_clause", "next_sentence").alias("_around"))
        # Target and context scored in one pass; both rows come from one
        # generator, and the scorer groups by (key, ...), so nothing is shuffled
        both = t.select(*keys, F.inline(F.array(F.struct(F.lit(1).alias("_which"), F.col("_clause").alias("text")),
                                                F.struct(F.lit(2).alias("_which"), F.col("_around").alias("text")))))
        r = scorer(both, keys + ["_which"]).groupBy(*keys).agg(
            F.max(F.when(F.col("_which") == 1, F.col("predicted_emotion"))).alias("_p1"),
            F.max(F.when(F.col("_which") == 1, F.col("confidence"))).alias("_c1"),
            F.max(F.when(F.col("_which") == 2, F.col("predicted_emotion"))).alias("_p2"),
            F.max(F.when(F.col("_which") == 2, F.col("confidence"))).alias("_c2"))
    take2 = _needs_context() & ((F.col("_p1") == "neutral") | ((F.col("_p2") != "neutral") & (F.col("_c2") > F.col("_c1"))))
    label = F.when(take2, F.col("_p2")).otherwise(F.col("_p1"))
    conf = F.when(take2, F.col("_c2")).otherwise(F.col("_c1"))
    r = r.select(*keys, label.alias("predicted_emotion"), conf.alias("confidence"), F.explode("targets").alias("_t"))
    r = r.select(key, "sentence_idx", "_t.t_ord", F.col("_t.std").alias("entity"), "_t.type",
                 *([F.col("sentence").alias("context_sentence")] if context else []),
                 "predicted_emotion", bucket("predicted_emotion").alias("emotion_bucket"), "confidence")
    return _keep_first(r, [key, "sentence_idx", "t_ord"], ["entity"])       # a key may stand on several rows of texts


def _needs_context() -> F.Column:
    return (F.col("_c1") < fixed.FALLBACK_THRESHOLD) | (F.col("_p1") == "neutral")


# ------------------------------------------------------------------ J6 / D9

def entity_votes(mentions: DataFrame, key: str) -> DataFrame:
    """Per (text, entity) sum confidence by bucket; winner by (sum, priority); drop 0."""
    name = TX.capitalize_entity(TX.clean_entity_name(F.col("entity")))
    m = mentions.withColumn("_name", name).where(F.col("_name") != "")
    order = F.struct("sentence_idx", "t_ord")
    # exact decimal sums: the winner does not depend on the order rows are added in
    conf = F.coalesce(F.col("confidence"), F.lit(0.5)).cast("decimal(38,10)")
    sums = [F.sum(F.when(F.col("emotion_bucket") == b, conf).otherwise(F.lit(0).cast("decimal(38,10)")))
            .alias(f"_s_{b}") for b in fixed.BUCKETS]
    g = m.groupBy(key, F.lower("_name").alias("entity_key")).agg(
        F.min_by("_name", order).alias("entity"), F.min_by("type", order).alias("type"),
        F.min(order).alias("_first"), *sums)
    cands = [F.struct(F.col(f"_s_{b}").alias("s"), F.lit(fixed.ENTITY_PRIORITY[b]).alias("p"), F.lit(b).alias("b"))
             for b in fixed.BUCKETS]
    best = F.greatest(*cands)
    return g.withColumn("_best", best).where(F.col("_best.s") > 0).select(
        key, "entity", "type", F.col("_best.b").alias("emotion_bucket"), F.col("_first"))


def entity_advice(votes: DataFrame, key: str, spark: SparkSession) -> DataFrame:
    """One advice row per voted entity, in first-mention order (``ord`` from 1)."""
    dim = F.broadcast(I.entity_advice_dim(spark))
    j = votes.join(dim, ["type", "emotion_bucket"], "inner")
    pre_post = F.split(F.col("template"), r"\{name\}", 2)
    text = F.concat(F.element_at(pre_post, 1), F.col("entity"), F.coalesce(F.element_at(pre_post, 2), F.lit("")))
    w = Window.partitionBy(key).orderBy("_first", "entity")
    pre, mid = I.ENTITY_RATIONALE.split("{name}")
    mid, post = mid.split("{bucket}")
    return j.select(
        key, F.row_number().over(w).alias("ord"),
        I.entity_advice_key(F.col("entity"), F.col("emotion_bucket")).alias("advice_key"),
        F.col("emotion_bucket").alias("emotion_key"),
        F.concat(F.lit(fixed.ENTITY_TITLE_PREFIX), F.col("entity")).alias("title"),
        text.alias("advice_text"),
        F.concat(F.lit(pre), F.col("entity"), F.lit(mid), F.col("emotion_bucket"), F.lit(post)).alias("rationale_text"))
