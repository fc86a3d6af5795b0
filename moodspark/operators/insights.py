"""Insight, advice and prompt texts (H12-H15, G1) as template dimensions.

Templates are small literal frames joined (broadcast) or ``when`` chains, so
the per-row work stays in the JVM. Paragraph wording is our own; keys,
titles and the structure of each text are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed

# FIXED VALUES: insight titles by bucket (NULL / unknown uses the neutral one).
INSIGHT_TITLES = {
    "positive": "Positive emotion detected",
    "negative": "Negative emotion detected",
    "neutral": "Neutral emotion detected",
}
INSIGHT_EXPLANATIONS = {
    "positive": "This entry reads as upbeat: it points to a good moment, some progress or a connection that helped.",
    "negative": "This entry carries strain: the wording suggests stress, frustration or a low mood worth a small reset.",
    "neutral": "This entry is mostly calm or descriptive: it records events or sorts thoughts in a steady tone.",
}
GENERAL_RATIONALE = {
    "positive": "The entry as a whole is positive, which supports constructive thoughts and actions.",
    "negative": "The entry as a whole is heavy; planned pleasant activity can interrupt a low loop.",
    "neutral": "The entry as a whole is neutral, a good moment to build steady routines.",
}
# Three general advice texts per bucket; the choice is entry_id % 3 (repeatable).
GENERAL_ADVICE = {
    "positive": [
        "Good days are a chance to lock in habits: plan one enjoyable activity for tomorrow as well.",
        "Keep the momentum going by scheduling something you like, such as a hobby, exercise or a call.",
        "Notice what made today work and give it a fixed place in your week.",
    ],
    "negative": [
        "Low moods pull towards withdrawal; schedule one small pleasant activity even if you do not feel like it.",
        "Break the loop with a short walk, a favourite hobby or a message to someone you trust.",
        "Pick a task that gives a small sense of accomplishment and do it today.",
    ],
    "neutral": [
        "Ordinary days are a good base: add one activity you enjoy to today's plan.",
        "Use a quiet day to check in with yourself and plan something rewarding.",
        "A steady day is a fine moment for self-care; set aside time for a favourite interest.",
    ],
}
# Entity advice by (type, bucket) in our own words; {name} is replaced by the entity.
ENTITY_ADVICE = {
    ("PER", "positive"): "You sound brighter around {name}: plan the next meeting while the good feeling is fresh.",
    ("PER", "negative"): "Something about {name} weighs on this entry: name it, then decide whether to speak up or step back.",
    ("PER", "neutral"): "Jot down what {name} means to you at the moment; a clear picture helps the next talk.",
    ("LOC", "positive"): "{name} recharges you: put another visit into this month's plan.",
    ("LOC", "negative"): "{name} drains you: find out what it is there, and shorten or swap the visit if you are able to.",
    ("LOC", "neutral"): "Watch how your mood shifts before and after {name} next time.",
    ("ORG", "positive"): "{name} is going well for you: note which part, and ask for more of it.",
    ("ORG", "negative"): "{name} is a source of strain: pick one thing there that you can change this week.",
    ("ORG", "neutral"): "Keep a short log of what {name} takes from you and what it gives back.",
}
ENTITY_RATIONALE = "The passage around '{name}' reads as {bucket}."

# FIXED VALUES: prompt formats by bucket and the generic prompts, in order.
PROMPT_FORMATS = {
    "positive": "You mentioned {name} in a positive light recently. Have you seen them since or made any plans?",
    "negative": "You had a stressful time regarding {name} recently. How are you feeling about that now?",
    "neutral": "What's new with {name}?",
}
GENERIC_PROMPTS = [
    "What's on your mind right now?",
    "What's one thing you're grateful for today?",
    "Describe a challenge you faced recently.",
    "What is something you are looking forward to?",
    "How are you feeling physically today?",
    "What did you learn recently that surprised you?",
]


def _lookup(mapping: dict, key: Column, default_key: str | None = None) -> Column:
    out = F.lit(mapping[default_key]) if default_key else F.lit(None).cast("string")
    for k, v in mapping.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def insight_title(b: Column) -> Column:
    """H12 title; NULL or unknown bucket uses the neutral text."""
    return _lookup(INSIGHT_TITLES, b, "neutral")


def insight_explanation(b: Column) -> Column:
    return _lookup(INSIGHT_EXPLANATIONS, b, "neutral")


def general_advice(entry_id: Column, b: Column) -> Column:
    """H13 as a struct: key, emotion, title, text (choice entry_id % 3), rationale."""
    bb = F.when(b.isin("positive", "negative"), b).otherwise(F.lit("neutral"))
    texts = F.map_from_arrays(
        F.array(*[F.lit(k) for k in GENERAL_ADVICE]),
        F.array(*[F.array(*[F.lit(t) for t in v]) for v in GENERAL_ADVICE.values()]))
    text = F.element_at(F.element_at(texts, bb), (F.pmod(entry_id, F.lit(3)) + 1).cast("int"))
    return F.struct(F.concat(F.lit(fixed.GENERAL_KEY_PREFIX), bb).alias("advice_key"),
                    bb.alias("emotion_key"), F.lit(fixed.GENERAL_TITLE).alias("title"),
                    text.alias("advice_text"), _lookup(GENERAL_RATIONALE, bb).alias("rationale_text"))


def entity_advice_dim(spark: SparkSession) -> DataFrame:
    """H14 template dim (type, bucket, template): 9 rows, broadcast."""
    rows = [(t, b, tpl) for (t, b), tpl in ENTITY_ADVICE.items()]
    return spark.createDataFrame(rows, "type string, emotion_bucket string, template string")


def entity_advice_key(name: Column, b: Column) -> Column:
    """``entity_{lower name, spaces -> _}_{bucket}``."""
    return F.concat(F.lit(fixed.ENTITY_KEY_PREFIX), F.replace(F.lower(name), F.lit(" "), F.lit("_")),
                    F.lit("_"), b)


def prompt_text(name: Column, b: Column) -> Column:
    """Prompt by bucket (anything but positive/negative uses the neutral form)."""
    def fmt(k):
        pre, post = PROMPT_FORMATS[k].split("{name}")
        return F.concat(F.lit(pre), name, F.lit(post))
    return F.when(b == "positive", fmt("positive")).when(b == "negative", fmt("negative")).otherwise(fmt("neutral"))
