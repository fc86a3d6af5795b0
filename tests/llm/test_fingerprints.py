"""Consistent weighted sampling: collision rates against generalised Jaccard, the query against brute force, odd rows."""

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from moodspark.llm import queries
from moodspark.llm import weighted_sampling as ws

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, block int, row int, fingerprint string"


def jaccard(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    both = sum((a & b).values())
    return both / max(1, sum((a | b).values()))


def test_collision_rate_is_the_generalised_jaccard_similarity(spark):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows, n = [], 200
    for i in range(40):
        text = [w for w in draw.sample(words, 12) for _ in range(draw.choice([1, 1, 2, 5, 17]))]
        other = [w for w in text if draw.random() < 0.7] + draw.choices(words, k=draw.randint(0, 20))
        draw.shuffle(other)
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(other))]
    prints = {r.id: r.fingerprint for r in ws.signatures(
        spark.createDataFrame(rows, "id int, text string"), ["id"], "text", n).collect()}
    texts = dict(rows)
    errors = []
    for i in range(0, 80, 2):
        same = sum(prints[i][4 * k:4 * k + 4] == prints[i + 1][4 * k:4 * k + 4] for k in range(n)) / n
        errors.append(same - jaccard(texts[i], texts[i + 1]))
    assert abs(sum(errors) / len(errors)) < 0.015
    assert max(map(abs, errors)) < 5 * (0.25 / n) ** 0.5


def edited(rows):
    """(id, n, edited text) in order of id and text, nulls first."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        half = len(t) // 2
        out.append((i, len(t), t[:len(t) - half] + rows[(k + 1) % len(rows)][1][:half]))
    return rows, out


def check(got, rows):
    ordered, want = edited(rows)
    key = lambda r: (str(r[0]), r[1], r[2])
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in got], key=key) == sorted(
        [(i, n, hashlib.sha256(t.encode()).hexdigest()) for i, n, t in want], key=key)
    by_text = {}
    by_id = {r.doc_id: r for r in got}
    ids = [i for i, _ in ordered]
    for k, (i, t) in enumerate(ordered):
        if ids.count(i) > 1:
            continue
        r = by_id[i]
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
        assert len(r.fingerprint) == len(r.edited_fingerprint) == 4 * ws.SAMPLES
        j = ids[(k + 1) % len(ids)]
        if ids.count(j) == 1:
            other = by_id[j].fingerprint
            assert abs(r.near_next - sum(r.fingerprint[4 * x:4 * x + 4] == other[4 * x:4 * x + 4]
                                         for x in range(ws.SAMPLES)) / ws.SAMPLES) < 1e-9
    return ordered, want


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, SF, "documents").collect()]
    got = queries.op4(spark, SF).collect()
    ordered, want = check(got, docs)
    by_id = {r.doc_id: r for r in got}
    gaps = [by_id[i].near_edited - jaccard(t, w[2]) for (i, t), w in zip(ordered, want)]
    assert abs(sum(gaps) / len(gaps)) < 0.05


def test_odd_rows(spark):
    odd = [(5, "one two"), (3, None), (9, ""), (None, "no id"), (None, None), (7, "same"), (7, "same"), (8, " \t\n "),
           (11, "x" * 99 + " é" * 5), (12, "long word " * 40_000), (13, "😀".encode("utf-16", "surrogatepass")
                                                                     .decode("utf-16") + "ab c")]
    docs = spark.createDataFrame([(i, t, 1, 2, "f") for i, t in odd], SCHEMA)
    check(ws.edited_fingerprints(docs).collect(), odd)
    alone = ws.edited_fingerprints(docs.where("doc_id = 5")).collect()
    check(alone, odd[:1])
    assert ws.edited_fingerprints(docs.where("doc_id = -1")).count() == 0


def test_words_count_and_order_does_not(spark):
    rows = [(0, "a b b c"), (1, "b\tc\na  b "), (2, ""), (3, " \n")]
    got = {r.id: r.fingerprint for r in ws.signatures(spark.createDataFrame(rows, "id int, text string"),
                                                       ["id"], "text", 16).collect()}
    assert got[0] == got[1] and got[2] == got[3] != got[0]
    assert ws.signatures(spark.createDataFrame(rows, "id int, text string").withColumn("text", F.lit("q")),
                         ["id"], "text", 16).select("fingerprint").distinct().count() == 1


def test_default_draws_bound_the_standard_error(spark):
    row = queries.op4(spark, SF).first()
    draws = len(row.fingerprint) // ws.DIGITS
    assert 0.5 / draws ** 0.5 < 0.0725
    assert abs(row.near_edited * draws - round(row.near_edited * draws)) < 1e-9
