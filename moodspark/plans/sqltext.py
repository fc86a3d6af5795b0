"""SQL text for the oracle side: the fixture views and the shared scalar rules.

DuckDB runs these strings against the given parquet tables. The rules mirror
``functions.exprs`` (same integers, same tie table), written independently in
SQL so the check compares two implementations, not one.
"""

from __future__ import annotations

import re

from ..functions import fixed


def _re2_class() -> str:
    # Python-style escapes -> RE2 \x{...} escapes.
    s = fixed.PY_WHITESPACE_CLASS
    s = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: "\\x{%s}" % m.group(1), s)
    s = re.sub(r"\\x([0-9a-fA-F]{2})", lambda m: "\\x{%s}" % m.group(1), s)
    return s


WS = _re2_class()


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def py_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def preview(x: str) -> str:
    stripped = py_strip(f"coalesce({x}, '')")
    return f"left(replace({stripped}, chr(10), ' '), {fixed.PREVIEW_CHARS})"


def bucket(x: str) -> str:
    norm = "lower(" + py_strip(f"CASE WHEN {x} IS NULL OR {x} = '' THEN 'neutral' ELSE {x} END") + ")"
    return (f"(CASE WHEN {norm} IN {in_list(fixed.POSITIVE)} THEN 'positive' "
            f"WHEN {norm} IN {in_list(fixed.NEGATIVE)} THEN 'negative' "
            f"WHEN {norm} IN {in_list(fixed.NEUTRAL)} THEN 'neutral' END)")


def tie_list() -> str:
    return "(CAST([" + ", ".join(repr(v) for v in fixed.half_tie_table()) + "] AS DOUBLE[]))"


def round2(num: str, den: str) -> str:
    n, d = f"CAST({num} AS BIGINT)", f"CAST({den} AS BIGINT)"
    qq = f"(({n} * 100) // {d})"
    r = f"(({n} * 100) - {qq} * {d})"
    return (f"(CASE WHEN {d} = 0 THEN NULL WHEN {r} * 2 > {d} THEN ({qq} + 1) / 100.0 "
            f"WHEN {r} * 2 < {d} THEN {qq} / 100.0 WHEN {qq} >= 100 THEN {qq} / 100.0 "
            f"ELSE {tie_list()}[{qq} + 1] END)")


def half_up2(num: str, den: str) -> str:
    n, d = f"CAST({num} AS BIGINT)", f"CAST({den} AS BIGINT)"
    return f"(CASE WHEN {d} = 0 THEN NULL ELSE (({n} * 2 + {d}) // ({d} * 2)) / 100.0 END)"


def positivity_color(s: str) -> str:
    c = f"least(greatest(CAST({s} AS DOUBLE), 0.0), 1.0)"
    hi, lo = f"(({c} - 0.5) / 0.5)", f"({c} / 0.5)"
    chans = []
    for i in range(3):
        up = f"({float(fixed.RGB_NEUTRAL[i])} + {hi} * {float(fixed.RGB_POSITIVE[i] - fixed.RGB_NEUTRAL[i])})"
        down = f"({float(fixed.RGB_NEGATIVE[i])} + {lo} * {float(fixed.RGB_NEUTRAL[i] - fixed.RGB_NEGATIVE[i])})"
        chans.append(f"CAST(trunc(CASE WHEN {c} >= 0.5 THEN {up} ELSE {down} END) AS INTEGER)")
    return (f"(CASE WHEN {s} IS NULL THEN {q(fixed.COLOR_NO_ENTRY)} ELSE "
            f"printf('#%02x%02x%02x', {chans[0]}, {chans[1]}, {chans[2]}) END)")


def js_number(x: str) -> str:
    return f"regexp_replace(CAST({x} AS VARCHAR), '\\.0$', '')"


def heatmap_color(s: str, n: str) -> str:
    up = f"(0.2 + (({s} - 0.5) / 0.5) * 0.8)"
    down = f"(0.2 + ((0.5 - {s}) / 0.5) * 0.8)"
    return (f"(CASE WHEN {n} = 0 OR {s} IS NULL THEN {q(fixed.COLOR_HEATMAP_EMPTY)} "
            f"WHEN {s} > 0.5 THEN 'rgba(%d, %d, %d, ' || {js_number(up)} || ')' "
            f"WHEN {s} < 0.5 THEN 'rgba(%d, %d, %d, ' || {js_number(down)} || ')' "
            f"ELSE {q(fixed.COLOR_NEUTRAL)} END)") % (fixed.RGB_POSITIVE + fixed.RGB_NEGATIVE)


def time_slot(ts: str) -> str:
    h = f"hour({ts})"
    return (f"(CASE WHEN {h} >= 6 AND {h} < 12 THEN 'Morning' "
            f"WHEN {h} >= 12 AND {h} < 18 THEN 'Afternoon' ELSE 'Evening' END)")


def weekday_name(ts: str) -> str:
    arr = "[" + ", ".join(q(d) for d in fixed.WEEKDAYS) + "]"
    return f"{arr}[isodow({ts})]"


def season(ts: str) -> str:
    m = f"month({ts})"
    return (f"(CASE WHEN {m} BETWEEN 3 AND 5 THEN 'Spring' WHEN {m} BETWEEN 6 AND 8 THEN 'Summer' "
            f"WHEN {m} BETWEEN 9 AND 11 THEN 'Autumn' ELSE 'Winter' END)")


def flashback_label(e: str, as_of: str) -> str:
    t = f"DATE {q(as_of)}"
    ed = f"CAST({e} AS DATE)"
    diff = f"({t} - {ed})"
    months = f"((year({t}) - year({ed})) * 12 + (month({t}) - month({ed})))"
    same = f"(day({t}) = day({ed}))"
    return (f"(CASE WHEN {diff} <= 0 THEN NULL WHEN {diff} = 7 THEN '1 week ago today' "
            f"WHEN {diff} = 14 THEN '2 weeks ago today' WHEN {diff} = 21 THEN '3 weeks ago today' "
            f"WHEN {same} AND {months} = 1 THEN '1 month ago today' "
            f"WHEN {same} AND {months} > 1 AND {months} < 12 THEN {months} || ' months ago today' "
            f"WHEN {same} AND {months} = 12 THEN '1 year ago today' "
            f"WHEN {same} AND {months} > 12 AND {months} % 12 = 0 THEN ({months} // 12) || ' years ago today' "
            f"END)")


def summary_text(dom: str, score: str, pos: str, neg: str, neu: str, prev: str) -> str:
    return ("'Your day had a ' || {d} || ' tone with a positivity score of ' || CAST({s} AS VARCHAR) || "
            "'. You had ' || {p} || ' positive, ' || {n} || ' negative and ' || {u} || "
            "' neutral entries. Your most recent entry was: \"' || {v} || '\"'").format(
                d=dom, s=score, p=pos, n=neg, u=neu, v=prev)


def short_summary(dom: str, pos: str, neg: str, neu: str) -> str:
    return (f"upper(left({dom}, 1)) || lower(substr({dom}, 2)) || ' day. ' || {pos} || ' positive, ' "
            f"|| {neg} || ' negative, ' || {neu} || ' neutral'")


# ------------------------------------------------------------------ fixture views

def labels_values() -> str:
    rows = ", ".join(f"({i}, {q(lab)}, {q(fixed.bucket_of(lab))})" for i, lab in enumerate(fixed.LABELS))
    return f"SELECT * FROM (VALUES {rows}) t(label_index, label, bucket)"


J_LABELS = f"j_labels AS ({labels_values()})"

J_ENTRIES = """j_entries AS (
  select e.event_id as entry_id, e.user_id, d.doc_id, d.text, e.ts as entry_time
  from events e
  cross join (select count(*) as n_docs from documents) c
  join documents d on d.doc_id = e.event_id % c.n_docs)"""

J_ANALYSIS = """j_analysis AS (
  select e.event_id as entry_id, l.label as predicted_emotion, e.value/(e.value+100) as confidence
  from events e left join j_labels l
    on l.label_index = (e.event_id*7 + e.user_id) % 28 and e.event_id % 31 <> 0
  where e.event_id % 37 <> 0)"""

J_ENTRIES_LONG = """j_entries_long AS (
  select o.o_orderkey as entry_id, o.o_custkey as user_id, o.o_orderdate as entry_time,
         l.label as predicted_emotion
  from orders o join j_labels l on l.label_index = o.o_orderkey % 28)"""


def with_views(*extra: str, long: bool = False) -> str:
    views = [J_LABELS, J_ENTRIES, J_ANALYSIS]
    if long:
        views.append(J_ENTRIES_LONG)
    return "WITH " + ",\n".join(views + list(extra))
