"""Fixed values that results depend on.

FIXED VALUES: everything in this module must equal the behaviour being
reproduced (label vocabulary and order, bucket membership, stem exceptions,
stop words, pronouns, conjunctions, colours, day/slot names, key prefixes).
They are stated plainly and in their natural order. Larger tables (stems,
tie results) are built from rules further down, not typed out.
"""

from __future__ import annotations

# --- FIXED VALUES -----------------------------------------------------------

# Emotion vocabulary, in score-vector index order.
LABELS = [
    "admiration", "amusement", "anger", "annoyance", "approval", "caring",
    "confusion", "curiosity", "desire", "disappointment", "disapproval",
    "disgust", "embarrassment", "excitement", "fear", "gratitude", "grief",
    "joy", "love", "nervousness", "optimism", "pride", "realization",
    "relief", "remorse", "sadness", "surprise", "neutral",
]

# Bucket membership of each label.
POSITIVE = ["admiration", "amusement", "approval", "caring", "desire", "excitement",
            "gratitude", "joy", "love", "optimism", "pride", "relief"]
NEGATIVE = ["anger", "annoyance", "disappointment", "disapproval", "disgust",
            "embarrassment", "fear", "grief", "nervousness", "remorse", "sadness"]
NEUTRAL = ["neutral", "confusion", "curiosity", "realization", "surprise"]

BUCKETS = ["positive", "negative", "neutral"]

# Stem exceptions of the keyword scorer (label -> stems, tried in order).
STEM_EXCEPTIONS = {
    "anger": ["angr", "anger"],
    "grief": ["griev", "grief"],
    "love": ["lov", "love"],
}
# Suffixes whose removal gives the first stem (full name is the second).
STEM_SUFFIXES = ["ness", "ment"]

# Keyword scorer outputs.
KEYWORD_MODEL_NAME = "keyword-baseline"
KEYWORD_CONF_MATCH = 0.5
KEYWORD_CONF_NONE = 0.1
DEFAULT_LABEL = "neutral"

# Words never reported as entities (case-folded comparison).
ENTITY_STOP_WORDS = [
    "email", "emails", "tea", "coffee", "breakfast", "lunch", "dinner",
    "work", "home", "school", "university", "college", "class", "classes",
    "exam", "exams", "test", "tests", "task", "tasks", "project", "projects",
    "meeting", "meetings", "phone", "computer", "laptop", "movie", "movies",
    "music", "song", "songs", "book", "books", "dog", "cat", "walk", "run",
    "car", "train", "bus", "flight", "trip", "gym", "bed", "morning", "afternoon",
    "evening", "night", "weekend", "week", "day", "month", "year", "today",
    "yesterday", "tomorrow", "street", "road", "park", "river", "lake", "sea",
    "ocean", "beach", "mountain", "hill", "forest", "wood", "woods", "city",
    "town", "village", "country", "world", "earth", "sun", "moon", "star",
    "stars", "sky", "cloud", "clouds", "rain", "snow", "wind", "weather",
    "summer", "winter", "spring", "autumn", "fall", "holiday", "holidays",
    "vacation", "vacations", "weekends", "monday", "tuesday",
    "wednesday", "thursday", "friday", "saturday", "sunday",
]

ENTITY_TYPES = ["PER", "LOC", "ORG"]
PRONOUNS = ["he", "she", "they", "him", "her", "them", "his", "hers", "their", "theirs"]
CONTRASTIVE = ["but", "however", "although", "though", "while"]
CARRY_MAX_DISTANCE = 2          # sentences a pronoun may look back for a PER
FALLBACK_THRESHOLD = 0.5        # context re-score below this confidence
ENTITY_PRIORITY = {"negative": 3, "positive": 2, "neutral": 1}

# Colours.
COLOR_NO_ENTRY = "#ffffff"
COLOR_HEATMAP_EMPTY = "#f4f4f7"
COLOR_NEUTRAL = "#e2e2e2"
RGB_NEUTRAL = (226, 226, 226)
RGB_POSITIVE = (255, 179, 186)
RGB_NEGATIVE = (186, 225, 255)
BUCKET_COLOR = {"positive": "#ffb3ba", "negative": "#bae1ff", "neutral": "#e2e2e2"}

WEEKDAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
TIME_SLOTS = ["Morning", "Afternoon", "Evening"]       # [6,12), [12,18), else
SEASONS = ["Spring", "Summer", "Autumn", "Winter"]     # Mar-May, Jun-Aug, Sep-Nov, else
DAY_NIGHT = ["Day", "Night"]                           # [6,18), else

PREVIEW_CHARS = 160
NO_ENTRY_TEXT = "No entries for this day."
NO_ENTRY_BUCKET = "none"
SUMMARY_FORMAT = ('Your day had a {dominant} tone with a positivity score of {score}. '
                  'You had {pos} positive, {neg} negative and {neu} neutral entries. '
                  'Your most recent entry was: "{preview}"')
SHORT_SUMMARY_FORMAT = "{Dominant} day. {pos} positive, {neg} negative, {neu} neutral"

ENTITY_KEY_PREFIX = "entity_"
ENTITY_TITLE_PREFIX = "Regarding "
GENERAL_TITLE = "General Advice"
GENERAL_KEY_PREFIX = "general_"
DEFAULT_ADVICE_KEY = "generic_advice"
DEFAULT_ADVICE_TITLE = "Advice"
DEFAULT_INSIGHT_TITLE = "Insight"
MEMORY_DEFAULT_TITLE = "Positive moment"
MEMORY_DEFAULT_SUMMARY = "A positive moment was saved in your history."
PROMPT_ENTITY_LIMIT = 15      # newest entity advice rows considered
PROMPT_ENTITY_KEEP = 2
PROMPT_TOTAL = 3
HISTORY_LIMIT = 20
ENTITY_IMPACT_TOP = 10
EMPTY_TEXT_ERROR = "Text must not be empty"

# Chunking / windowing of token sequences.
MAX_POSITIONS = 128
SPECIAL_TOKENS = 2
CHUNK_BUDGET = 120
WINDOW_OVERLAP = 20
SIGMOID_THRESHOLD = 0.5

# Python's str.isspace() set, used for Python-style strip().
PY_WHITESPACE_CLASS = (
    "\\t\\n\\x0b\\x0c\\r\\x1c\\x1d\\x1e\\x1f \\x85\\xa0\\u1680"
    "\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
)

# --- tables built from rules --------------------------------------------------


def bucket_of(label: str) -> str | None:
    if label in POSITIVE:
        return "positive"
    if label in NEGATIVE:
        return "negative"
    if label in NEUTRAL:
        return "neutral"
    return None


def stems_of(label: str) -> list[str]:
    """Stems of a label, in the order they are tried."""
    name = label.lower()
    for suffix in STEM_SUFFIXES:
        if name.endswith(suffix):
            return [name[: -len(suffix)], name]
    return list(STEM_EXCEPTIONS.get(name, [name]))


def label_stems() -> list[tuple[int, str, int, str]]:
    """(label_index, label, stem_order, stem) for the whole vocabulary."""
    return [(i, lab, k, s) for i, lab in enumerate(LABELS) for k, s in enumerate(stems_of(lab))]


def half_tie_table() -> list[float]:
    """Python's round(x, 2) for the 100 exact half-way fractions (2i+1)/200.

    Index q (zero based) holds the result for a value between q/100 and
    (q+1)/100; Python rounds the binary double, so the direction varies.
    """
    return [round((2 * q + 1) / 200, 2) for q in range(100)]
