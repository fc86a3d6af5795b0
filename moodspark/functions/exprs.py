"""Scalar rules as reusable Column expressions.

Each helper takes and returns ``pyspark.sql.Column`` so the rule runs inside
whole-stage codegen; nothing here calls back into Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- strings

# The class of fixed.PY_WHITESPACE_CLASS for Java patterns. Java tests the single characters below U+0100 by one table
# and every other member of a class one after the other; the range around those rules out other letters at once.
JAVA_WS = r"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"


def py_strip(x) -> Column:
    """Python ``str.strip()``: remove the Unicode white space set at both ends.

    Both ends are stripped with an anchored leading match (the right end on
    the reversed string): an unanchored ``[ws]+$`` would be tried at every
    white-space run of a long text.
    """
    ws = JAVA_WS
    lead = F.regexp_replace(_c(x), f"^[{ws}]+", "")
    return F.reverse(F.regexp_replace(F.reverse(lead), f"^[{ws}]+", ""))


def preview(text, n: int = fixed.PREVIEW_CHARS) -> Column:
    """Strip, newline -> space, first ``n`` characters.

    Same result as ``left(strip(text), n)`` without a right-strip over the
    whole text: after the left strip, the first ``n`` characters need a right
    strip only when nothing but white space follows them.
    """
    ws = JAVA_WS
    lead = F.regexp_replace(F.coalesce(_c(text), F.lit("")), f"^[{ws}]+", "")
    head = F.left(lead, F.lit(n))
    more = F.substring(lead, n + 1, 1 << 30).rlike(f"[^{ws}]")
    cut = F.when(more, head).otherwise(F.regexp_replace(head, f"[{ws}]+$", ""))
    return F.replace(cut, F.lit("\n"), F.lit(" "))


# ---------------------------------------------------------------- buckets

def bucket(label) -> Column:
    """H1: NULL/empty -> neutral; strip + lower; unknown -> NULL."""
    raw = _c(label)
    norm = F.lower(py_strip(F.when(raw.isNull() | (raw == ""), F.lit("neutral")).otherwise(raw)))
    return (F.when(norm.isin(fixed.POSITIVE), "positive")
            .when(norm.isin(fixed.NEGATIVE), "negative")
            .when(norm.isin(fixed.NEUTRAL), "neutral"))


def bucket_score(b) -> Column:
    """H2: positive 1.0, negative 0.0, anything else 0.5."""
    b = _c(b)
    return F.when(b == "positive", 1.0).when(b == "negative", 0.0).otherwise(0.5)


def bucket_sign(b) -> Column:
    """H2: positive +1, negative -1, anything else 0."""
    b = _c(b)
    return F.when(b == "positive", 1).when(b == "negative", -1).otherwise(0)


def bucket_color(b) -> Column:
    """H9: bucket -> colour, neutral colour by default."""
    b = _c(b)
    out = F.lit(fixed.BUCKET_COLOR["neutral"])
    for name in ("negative", "positive"):
        out = F.when(b == name, fixed.BUCKET_COLOR[name]).otherwise(out)
    return out


# ---------------------------------------------------------------- rounding

def py_round_ratio2(num, den) -> Column:
    """H6: Python ``round(num/den, 2)`` for non-negative integers, exactly.

    Integer arithmetic: q = 100*num div den, r = 100*num mod den. Above the
    half-way point round up, below round down; exactly on it take Python's
    result for the binary double from a 100-entry table. NULL when den = 0.
    """
    num, den = _c(num).cast("long"), _c(den).cast("long")
    scaled = num * 100
    q = F.floor(scaled / den).cast("long")
    r = scaled - q * den
    ties = F.array(*[F.lit(v) for v in fixed.half_tie_table()])
    exact = F.when(r * 2 > den, (q + 1) / 100.0).when(r * 2 < den, q / 100.0)
    tie = F.when(q >= 100, q / 100.0).otherwise(F.element_at(ties, (q + 1).cast("int")))
    return F.when(den != 0, F.coalesce(exact, tie))


def half_up_hundredths(num, den) -> Column:
    """Half-up rounding of num/den to 2 digits for integer hundredths (toFixed)."""
    num, den = _c(num).cast("long"), _c(den).cast("long")
    return F.when(den != 0, F.floor((num * 2 + den) / (den * 2)) / 100.0)


def js_number(x) -> Column:
    """Render a double the way JavaScript prints numbers (no trailing .0)."""
    s = _c(x).cast("string")
    return F.regexp_replace(s, r"\.0$", "")


# ---------------------------------------------------------------- colours

def positivity_color(score) -> Column:
    """H7: clamp to [0,1], piecewise linear between three colours, truncate."""
    s = F.least(F.greatest(_c(score).cast("double"), F.lit(0.0)), F.lit(1.0))
    hi = (s - 0.5) / 0.5
    lo = s / 0.5

    def chan(i):
        up = F.lit(float(fixed.RGB_NEUTRAL[i])) + hi * float(fixed.RGB_POSITIVE[i] - fixed.RGB_NEUTRAL[i])
        down = F.lit(float(fixed.RGB_NEGATIVE[i])) + lo * float(fixed.RGB_NEUTRAL[i] - fixed.RGB_NEGATIVE[i])
        return F.when(s >= 0.5, up).otherwise(down).cast("int")

    return F.when(_c(score).isNull(), fixed.COLOR_NO_ENTRY).otherwise(
        F.format_string("#%02x%02x%02x", chan(0), chan(1), chan(2)))


def heatmap_color(score, count) -> Column:
    """H8: empty cell grey; above/below 0.5 rgba with alpha 0.2 + 0.8t."""
    s, n = _c(score), _c(count)
    up = F.lit(0.2) + ((s - 0.5) / 0.5) * 0.8
    down = F.lit(0.2) + ((F.lit(0.5) - s) / 0.5) * 0.8
    return (F.when((n == 0) | s.isNull(), fixed.COLOR_HEATMAP_EMPTY)
            .when(s > 0.5, F.concat(F.lit("rgba(%d, %d, %d, " % fixed.RGB_POSITIVE), js_number(up), F.lit(")")))
            .when(s < 0.5, F.concat(F.lit("rgba(%d, %d, %d, " % fixed.RGB_NEGATIVE), js_number(down), F.lit(")")))
            .otherwise(fixed.COLOR_NEUTRAL))


# ---------------------------------------------------------------- time

def time_slot(ts) -> Column:
    """H3: Morning [6,12), Afternoon [12,18), else Evening (same weekday)."""
    h = F.hour(_c(ts))
    return (F.when((h >= 6) & (h < 12), fixed.TIME_SLOTS[0])
            .when((h >= 12) & (h < 18), fixed.TIME_SLOTS[1])
            .otherwise(fixed.TIME_SLOTS[2]))


def weekday_name(ts) -> Column:
    """H4: Mon..Sun (``weekday`` is 0 for Monday)."""
    return F.element_at(F.array(*[F.lit(d) for d in fixed.WEEKDAYS]), F.weekday(_c(ts)) + 1)


def season(ts) -> Column:
    """H5: Mar-May Spring, Jun-Aug Summer, Sep-Nov Autumn, else Winter."""
    m = F.month(_c(ts))
    return (F.when(m.between(3, 5), "Spring").when(m.between(6, 8), "Summer")
            .when(m.between(9, 11), "Autumn").otherwise("Winter"))


def day_night(ts) -> Column:
    h = F.hour(_c(ts))
    return F.when((h >= 6) & (h < 18), "Day").otherwise("Night")


def day_range(ts, as_of, range_name: str) -> Column:
    """Relative range filter against an explicit ``as_of`` timestamp."""
    t = _c(ts).cast("timestamp_ntz")
    now = F.lit(as_of).cast("timestamp_ntz")
    days = {"thisWeek": 7, "thisMonth": 30, "thisYear": 365}
    if range_name == "all":
        return F.lit(True)
    if range_name == "lastWeek":
        return (t >= now - F.expr("INTERVAL 14 DAYS")) & (t < now - F.expr("INTERVAL 7 DAYS"))
    if range_name in days:
        return t >= now - F.make_dt_interval(F.lit(days[range_name]))
    raise ValueError(f"unknown range {range_name!r}")


def flashback_label(entry_date, as_of) -> Column:
    """7/14/21 days -> weeks; same day of month -> months (<12) or whole years."""
    e = _c(entry_date).cast("date")
    t = F.lit(as_of).cast("date") if isinstance(as_of, str) else _c(as_of).cast("date")
    diff = F.datediff(t, e)
    months = (F.year(t) - F.year(e)) * 12 + (F.month(t) - F.month(e))
    years = F.floor(months / 12).cast("int")
    same_dom = F.dayofmonth(t) == F.dayofmonth(e)
    return (F.when(diff <= 0, F.lit(None).cast("string"))
            .when(diff == 7, "1 week ago today")
            .when(diff == 14, "2 weeks ago today")
            .when(diff == 21, "3 weeks ago today")
            .when(same_dom & (months == 1), "1 month ago today")
            .when(same_dom & (months > 1) & (months < 12),
                  F.format_string("%d months ago today", months))
            .when(same_dom & (months == 12), "1 year ago today")
            .when(same_dom & (months > 12) & (months % 12 == 0),
                  F.format_string("%d years ago today", years)))


def is_positive_entry(bucket_col, emotion_col) -> Column:
    """Insight bucket positive, or emotion literally 'positive'."""
    return F.coalesce((_c(bucket_col) == "positive") | (_c(emotion_col) == "positive"), F.lit(False))


def calendar_cell(day) -> Column:
    """Sunday-first month grid; (row, column) of a date."""
    d = _c(day).cast("date")
    offset = F.dayofweek(F.trunc(d, "month")) - 1
    pos = offset + F.dayofmonth(d) - 1
    return F.struct(F.floor(pos / 7).cast("int").alias("grid_row"), (pos % 7).alias("grid_col"))


# ---------------------------------------------------------------- summaries

def summary_text(dominant, score, pos, neg, neu, prev) -> Column:
    """H11 long form (score printed as Python prints a float)."""
    return F.format_string(
        fixed.SUMMARY_FORMAT.replace("{dominant}", "%s").replace("{score}", "%s")
        .replace("{pos}", "%d").replace("{neg}", "%d").replace("{neu}", "%d").replace("{preview}", "%s"),
        _c(dominant), _c(score).cast("string"), _c(pos), _c(neg), _c(neu), _c(prev))


def short_summary(dominant, pos, neg, neu) -> Column:
    """H11 short form: ``Positive day. p positive, n negative, u neutral``."""
    d = _c(dominant)
    cap = F.concat(F.upper(F.left(d, F.lit(1))), F.lower(F.substring(d, 2, 1 << 30)))
    return F.format_string(
        fixed.SHORT_SUMMARY_FORMAT.replace("{Dominant}", "%s").replace("{pos}", "%d")
        .replace("{neg}", "%d").replace("{neu}", "%d"), cap, _c(pos), _c(neg), _c(neu))


def percent(x, digits: int = 0) -> Column:
    """A 0..1 share shown as a percentage string (``42%``)."""
    return F.concat(F.format_number(_c(x) * 100, digits), F.lit("%"))


def month_day_label(d) -> Column:
    """``MMM d`` chart label."""
    return F.date_format(_c(d), "MMM d")
