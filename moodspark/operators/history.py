"""Entry enrichment and history.

Batch form of the write path: score, insight, advice (general + entity),
stored as flat tables keyed by entry_id; read paths join them back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import fixed
from . import insights as I
from .joins import top_k_per_group


def insight_rows(analysis: DataFrame) -> DataFrame:
    """One insight row per analysed entry (bucket NULL -> neutral text, bucket kept)."""
    b = X.bucket("predicted_emotion")
    return analysis.select(
        "entry_id", F.coalesce(b, F.lit("neutral")).alias("emotion_bucket"),
        I.insight_title(b).alias("title"), I.insight_explanation(b).alias("explanation"),
        F.array().cast("array<string>").alias("details"))


def analysed_entries(entries: DataFrame, analysis: DataFrame, *keep: str) -> DataFrame:
    """entry_id, entry_time, the columns ``keep`` and predicted_emotion of the entries that have an analysis."""
    return entries.select("entry_id", "entry_time", *keep).join(
        analysis.select("entry_id", "predicted_emotion"), "entry_id", "inner")


def general_rows(analysed: DataFrame, *keep) -> DataFrame:
    """G1 + H13: the general advice (ord 0) of each row of :func:`analysed_entries`."""
    g = I.general_advice(F.col("entry_id"), X.bucket("predicted_emotion"))
    return analysed.select("entry_id", F.lit(0).alias("ord"), g.advice_key.alias("advice_key"),
                           g.emotion_key.alias("emotion_key"), g.title.alias("title"),
                           g.advice_text.alias("advice_text"), g.rationale_text.alias("rationale_text"),
                           F.col("entry_time").alias("created_at"), *keep)


def advice_rows(entries: DataFrame, analysis: DataFrame, text_advice: DataFrame | None,
                text_key: str = "doc_id", incognito_col: str | None = None) -> DataFrame:
    """G1 + H13 + J6: general advice (ord 0) followed by entity advice (ord 1..).

    ``text_advice`` holds J6 rows keyed by ``text_key`` (each distinct text
    analysed once); entries pick them up by an equi join. Incognito entries
    get the general row only.
    """
    a = analysed_entries(entries, analysis, *([text_key] if text_advice is not None else []),
                         *([incognito_col] if incognito_col else []))
    general = general_rows(a)
    if text_advice is None:
        return general
    src = a if not incognito_col else a.where(~F.coalesce(F.col(incognito_col), F.lit(False)))
    ent = src.select("entry_id", text_key, "entry_time").join(text_advice, text_key, "inner").select(
        "entry_id", "ord", "advice_key", "emotion_key", "title", "advice_text", "rationale_text",
        F.col("entry_time").alias("created_at"))
    return general.unionByName(ent)


def entity_advice_rows(entries: DataFrame, text_advice: DataFrame, text_key: str = "doc_id") -> DataFrame:
    """J6 rows of each entry's text with the entry's user and time: one join, nothing is scored.

    ``entity``, the name in the title, is taken once per text, not once per entry."""
    return entries.select("entry_id", "user_id", text_key, F.col("entry_time").alias("created_at")).join(
        text_advice.withColumn("entity", _titled_entity()), text_key, "inner").drop(text_key)


def with_defaults(advice: DataFrame, *keep: str) -> DataFrame:
    """A6 defaults for missing fields."""
    return advice.select(
        "entry_id", "ord",
        F.coalesce("advice_key", F.lit(fixed.DEFAULT_ADVICE_KEY)).alias("advice_key"),
        F.coalesce("emotion_key", F.lit("neutral")).alias("emotion_key"),
        F.coalesce("title", F.lit(fixed.DEFAULT_ADVICE_TITLE)).alias("title"),
        F.coalesce("advice_text", F.lit("")).alias("advice_text"),
        F.coalesce("rationale_text", F.lit("")).alias("rationale_text"), "created_at", *keep)


def replace_by_key(old: DataFrame, new: DataFrame, processed: DataFrame, key: str = "entry_id") -> DataFrame:
    """Drop every old row of a ``processed`` key, also if it has no new rows, then add the new rows."""
    keys = processed.select(key).distinct()
    return old.join(keys, key, "left_anti").unionByName(new, allowMissingColumns=True)


# ------------------------------------------------------------------ D3 / F2

def is_entity_key(advice_key) -> F.Column:
    """SQLite ``LIKE 'entity_%'``: ASCII case-insensitive, '_' any one char."""
    return F.col(advice_key).ilike("entity_%") if isinstance(advice_key, str) else advice_key.ilike("entity_%")


def _with_user(advice: DataFrame, entries: DataFrame | None) -> DataFrame:
    if "user_id" in advice.columns:
        return advice
    return advice.join(entries.select("entry_id", "user_id"), "entry_id", "inner")


def _titled_entity() -> F.Column:
    return X.py_strip(F.substring(F.col("title"), len(fixed.ENTITY_TITLE_PREFIX) + 1, 1 << 30))


def entity_impact(advice: DataFrame, entries: DataFrame | None = None,
                  top: int = fixed.ENTITY_IMPACT_TOP) -> DataFrame:
    """D3 + F2: per user, counts by bucket and total per entity; top 10 by total.

    The user comes with the advice rows, or from ``entries``. Ties on total are broken by entity name (stable and repeatable).
    """
    prefix = fixed.ENTITY_TITLE_PREFIX
    a = _with_user(advice.where(is_entity_key("advice_key") & F.col("title").startswith(prefix)), entries)
    name = F.col("entity") if "entity" in a.columns else _titled_entity()
    g = a.groupBy("user_id", name.alias("entity")).agg(
        *[F.count_if(F.col("emotion_key") == b).alias(b) for b in fixed.BUCKETS],
        F.count(F.lit(1)).alias("total"))
    return top_k_per_group(g, ["user_id"], [F.desc("total"), F.asc("entity")], top, rank_col="rank")


def nonzero_impact(impact: DataFrame) -> DataFrame:
    """Keep entities with any non-zero bucket."""
    return impact.where((F.col("positive") > 0) | (F.col("negative") > 0) | (F.col("neutral") > 0))


# ------------------------------------------------------------------ J10 / F1 / C5

def newest_entries(entries: DataFrame, analysis: DataFrame, insight: DataFrame,
                   limit: int = fixed.HISTORY_LIMIT, offset: int = 0, day: str | None = None) -> DataFrame:
    """C4 + F1: per user, entries newest first, rows (offset, offset + limit], left-joined with
    their analysis and insight.

    The optional day filter is a half-open timestamp range (B2), so parquet
    min/max statistics can skip row groups. Entries without an analysis stay.
    """
    e = entries.withColumnRenamed("entry_time", "occured_at")
    if day is not None:
        d0 = F.lit(day).cast("date")
        e = e.where((F.col("occured_at") >= d0.cast("timestamp_ntz"))
                    & (F.col("occured_at") < F.date_add(d0, 1).cast("timestamp_ntz")))
    page = top_k_per_group(e, ["user_id"], [F.desc("occured_at"), F.desc("entry_id")], offset + limit,
                           rank_col="position").where(F.col("position") > offset)
    return (page.join(analysis.select("entry_id", "predicted_emotion", "confidence"), "entry_id", "left")
            .join(insight.select("entry_id", "emotion_bucket", F.col("title").alias("insight_title"),
                                 F.col("explanation").alias("insight_explanation"),
                                 F.col("details").alias("insight_details")), "entry_id", "left"))


def attach_advice(page: DataFrame, advice: DataFrame, text_advice: DataFrame | None = None,
                  text_key: str = "doc_id") -> DataFrame:
    """The page with each entry's advice list in insertion order, empty if there is none.

    One join on the entry and one grouping by it: the page is read once.
    ``text_advice`` holds J6 rows keyed by ``text_key``, a column of the page: they follow the entry's own ``advice``
    (as often as it has rows, as with :func:`advice_rows`). They are gathered once per text and never moved with the entries.
    """
    fields = ["advice_key", "emotion_key", "title", "advice_text", "rationale_text"]
    line = F.when(F.col("ord").isNotNull(), F.struct("ord", *fields))
    joined = page.join(advice.select("entry_id", "ord", *fields), "entry_id", "left")
    keep = [c for c in page.columns if c != "entry_id"]
    own = joined.groupBy("entry_id").agg(*[F.first(c).alias(c) for c in keep],
                                         F.sort_array(F.collect_list(line)).alias("_a"))
    lines = F.col("_a")
    if text_advice is not None:
        per = text_advice.groupBy(text_key).agg(F.sort_array(F.collect_list(line)).alias("_t"))
        own = own.join(per, text_key, "left")
        n = F.size("_a")
        often = F.when(n == 1, F.col("_t")).otherwise(F.flatten(F.transform("_t", lambda x: F.array_repeat(x, n))))
        lines = F.when(F.col("_t").isNull(), lines).otherwise(F.concat(lines, often))
    return own.withColumn("advice", F.transform(lines, lambda x: x.dropFields("ord"))).drop("_a", "_t")


def history_page(entries: DataFrame, analysis: DataFrame, insight: DataFrame | None, advice: DataFrame,
                 limit: int = fixed.HISTORY_LIMIT, offset: int = 0, day: str | None = None) -> DataFrame:
    """A page of :func:`newest_entries` with each entry's advice list.

    Without a stored ``insight`` it is derived from the analysis rows.
    """
    page = newest_entries(entries, analysis, insight_rows(analysis) if insight is None else insight, limit, offset, day)
    return attach_advice(page, advice)


# ------------------------------------------------------------------ F6 prompts

def user_prompts(advice: DataFrame, entries: DataFrame, spark: SparkSession, seed: int = 42) -> DataFrame:
    """newest 15 entity advice rows per user, distinct entities (case-folded,
    first kept), first 2 become prompts; fill to 3 with generic prompts in a
    seeded order. Returns (user_id, prompt_no, prompt)."""
    prefix = fixed.ENTITY_TITLE_PREFIX
    a = _with_user(advice.where(is_entity_key("advice_key")), entries)
    newest = top_k_per_group(a, ["user_id"], [F.desc("created_at"), F.desc("entry_id"), F.asc("ord")],
                             fixed.PROMPT_ENTITY_LIMIT, rank_col="_r")
    ent = newest.withColumn("_e", X.py_strip(F.replace(F.col("title"), F.lit(prefix), F.lit(""))))
    firsts = top_k_per_group(ent, ["user_id", F.lower("_e")], [F.asc("_r")], 1, salt_buckets=1, rank_col="_k")
    picked = top_k_per_group(firsts, ["user_id"], [F.asc("_r")], fixed.PROMPT_ENTITY_KEEP, salt_buckets=1,
                             rank_col="prompt_no").select(
        "user_id", "prompt_no", I.prompt_text(F.col("_e"), F.col("emotion_key")).alias("prompt"))
    # generic prompts follow the entity prompts in a seeded order (md5 of
    # user, prompt number and seed); one ranking fills up to 3
    users = entries.select("user_id").distinct()
    gen = users.select("user_id", F.posexplode(F.array(*[F.lit(p) for p in I.GENERIC_PROMPTS])).alias("_g", "prompt"))
    gen = gen.select("user_id", "prompt", F.lit(1).alias("_grp"),
                     F.md5(F.concat_ws(":", F.col("user_id").cast("string"), F.col("_g").cast("string"),
                                       F.lit(str(seed)))).alias("_o"))
    allp = picked.select("user_id", "prompt", F.lit(0).alias("_grp"),
                         F.lpad(F.col("prompt_no").cast("string"), 4, "0").alias("_o")).unionByName(gen)
    from pyspark.sql import Window
    ranked = allp.withColumn("prompt_no", F.row_number().over(
        Window.partitionBy("user_id").orderBy("_grp", "_o")))
    return ranked.where(F.col("prompt_no") <= fixed.PROMPT_TOTAL).select(
        "user_id", F.col("prompt_no").cast("int"), "prompt")
