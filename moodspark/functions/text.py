"""Text rules as Column expressions (H16-H21, H25 helpers).

All regular expressions are Java patterns evaluated by Spark's built-in
functions; white space follows Python's ``str.isspace`` set so splits and
strips agree with the rules being reproduced.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .exprs import JAVA_WS, py_strip

WS = fixed.PY_WHITESPACE_CLASS
WORD = r"\p{L}\p{N}_"
# A basic token: a run of word characters or one other non-space character.
BASIC_TOKEN = rf"[{WORD}]+|[^{WORD}{WS}]"
ALNUM_EDGES = r"^[^a-zA-Z0-9]+|[^a-zA-Z0-9]+$"
# Names that H19 and H21 leave as they are; most names are found out here, at the cost of one match.
PLAIN_NAME = r"^[A-Z][a-z]+(?: [A-Z][a-z]+)*\z"


SPLIT_MARK = "\ue000"


def sentences(text: Column) -> Column:
    """Split after '.', '!' or '?' followed by white space (text stripped first).

    The white-space run after a terminator is replaced by a marker and the
    text split on it (same pieces as the look-behind split, several times
    faster); a text that already contains the marker uses the look-behind.
    """
    t = py_strip(F.coalesce(text, F.lit("")))
    fast = F.split(F.regexp_replace(t, rf"([.!?])[{JAVA_WS}]+", "$1" + SPLIT_MARK), SPLIT_MARK)
    slow = F.split(t, rf"(?<=[.!?])[{JAVA_WS}]+")
    return F.when(F.instr(t, SPLIT_MARK) > 0, slow).otherwise(fast)


def is_blank(s: Column) -> Column:
    return ~s.rlike(f"[^{JAVA_WS}]")


def basic_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(BASIC_TOKEN), 0)


def token_count(text: Column, specials: int = fixed.SPECIAL_TOKENS) -> Column:
    """Token count of a text including the special tokens of an encoder."""
    return F.size(basic_tokens(text)) + specials


def _word_regex(words: list[str]) -> str:
    """Whole word, any case; word characters are letters, digits and '_'
    (Python's word class), spelled out as look-arounds. The first letter is tested before them: most places fail there."""
    first = "".join(sorted({w[0] for w in words}))
    return rf"(?iu)(?=[{first}])(?<![{WORD}])(" + "|".join(words) + rf")(?![{WORD}])"


PRONOUN_RE = _word_regex(fixed.PRONOUNS)
CONTRAST_RE = _word_regex(fixed.CONTRASTIVE)


def has_pronoun(s: Column) -> Column:
    return F.coalesce(s.rlike(PRONOUN_RE), F.lit(False))


def contrastive_clauses(sentence: Column) -> Column:
    """Split on but/however/although/though/while; strip ' ,.!?'; drop empties.

    Without a conjunction the sentence itself is the only clause (unstripped).
    """
    parts = F.split(sentence, CONTRAST_RE)
    stripped = F.transform(parts, lambda p: F.regexp_replace(p, r"^[ ,.!?]+|[ ,.!?]+$", ""))
    # tested by a match first: split compiles its pattern for every row
    return F.when(~sentence.rlike(CONTRAST_RE), F.array(sentence)).otherwise(F.filter(stripped, lambda p: p != ""))


def clean_entity_name(name: Column) -> Column:
    """Strip non-alphanumerics at both ends, drop a trailing 's, trim."""
    c = F.regexp_replace(F.coalesce(name, F.lit("")), ALNUM_EDGES, "")
    low = F.lower(c)
    c = (F.when(low.endswith("'s"), F.left(c, F.length(c) - 2))
         .when(low.endswith("s'"), F.left(c, F.length(c) - 1))
         .otherwise(c))
    return F.when(name.rlike(PLAIN_NAME), name).otherwise(py_strip(c))


def expand_bounds(sentence: Column, start: Column, end: Column) -> Column:
    """Widen [start, end) to the surrounding non-space run, strip non-alphanumerics."""
    before = F.regexp_extract(F.left(sentence, start), rf"[^{JAVA_WS}]*\z", 0)
    after = F.regexp_extract(F.substring(sentence, end + 1, 1 << 30), rf"^[^{JAVA_WS}]*", 0)
    mid = F.substring(sentence, start + 1, end - start)
    out = F.regexp_replace(F.concat(before, mid, after), ALNUM_EDGES, "")
    return F.when(start.isNull() | end.isNull(), F.lit("")).otherwise(out)


SUMS_BLOCK = 256


def running_sums(sizes: Column) -> Column:
    """Of an array of int, the sum up to and with each element.

    Sums are gathered in blocks: adding one at a time to the whole result would copy it each time.
    """
    start = F.struct(F.array().cast("array<array<int>>").alias("done"), F.array().cast("array<int>").alias("block"),
                     F.lit(0).alias("at"))

    def step(acc, n):
        at, full = acc["at"] + n, F.size(acc["block"]) >= SUMS_BLOCK
        return F.struct(F.when(full, F.concat(acc["done"], F.array(acc["block"]))).otherwise(acc["done"]).alias("done"),
                        F.when(full, F.array(at)).otherwise(F.concat(acc["block"], F.array(at))).alias("block"), at.alias("at"))

    return F.aggregate(sizes, start, step, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["block"]))))


def capitalize_entity(entity: Column) -> Column:
    """Capitalise each word and each hyphen part, rest lower; single spaces."""
    words = F.filter(F.split(py_strip(entity), f"[{JAVA_WS}]+"), lambda w: w != "")
    return F.when(entity.rlike(PLAIN_NAME), entity).otherwise(F.array_join(F.transform(words, lambda w: F.array_join(
        F.transform(F.split(w, "-", -1), lambda p: F.concat(F.upper(F.left(p, F.lit(1))),
                                                            F.lower(F.substring(p, 2, 1 << 30)))), "-")), " "))
