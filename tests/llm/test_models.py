"""Quality, toxicity, mixing and the pipeline: held-out accuracy, targets met, odd rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from moodspark.llm import features, linear, mixing, quality, queries, toxicity

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, p string"
LABELS = "doc_id bigint, quality int, toxic int, text string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, 0.5, "p") for i, t in rows], SCHEMA)


def labels_of(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], LABELS)


ODD = [(1, "fine words here"), (2, None), (2, None), (None, ""), (None, "x"), (4, "long " * 60_000), (5, "\x00 é ñ"), (5, "a")]
ODD_LABELS = [(1, 1, 0), (1, None, 1), (2, 0, 1), (None, 1, 1), (99, 0, 0), (4, 7, 0), (5, 0, 0)]


@pytest.fixture(scope="module")
def truth(spark):
    return {r.doc_id: r for r in queries.table(spark, SF, "labels").collect()}


def test_machine_learns_a_pair_that_no_weight_can():
    draw = np.random.default_rng(1)
    on = draw.random((3000, 6)) < 0.5
    y = (on[:, 0] ^ on[:, 1]).astype(int)
    rows = [np.append(np.flatnonzero(r), 9).astype(np.int32) for r in on]
    ids, table, constant = linear.fit_machine(rows[:2000], y[:2000], rate=0.2, sure=-0.5)
    starts, idx = linear.ragged(rows[2000:])
    p = linear.sigmoid(linear.machine_score(table[linear.numbered(idx, ids)], starts) + constant)
    assert ((p >= 0.5) == y[2000:]).mean() > 0.95


def test_machine_learns_a_neutral_pair_among_noise_at_its_defaults():
    draw = np.random.default_rng(1)
    one, two = draw.random((2, 7000)) < 0.5
    y = (one == two).astype(int)
    rows = [np.unique(np.concatenate([[9], [1] * int(a), [2] * int(b), 100 + draw.integers(0, 3000, 30)])).astype(np.int32)
            for a, b in zip(one, two)]
    ids, table, constant = linear.fit_machine(rows[:6000], y[:6000])
    starts, idx = linear.ragged(rows[6000:])
    p = linear.sigmoid(linear.machine_score(table[linear.numbered(idx, ids)], starts) + constant)
    assert ((p >= 0.5) == y[6000:]).mean() > 0.95


def test_machine_score_is_the_sum_over_pairs():
    draw = np.random.default_rng(2)
    own = draw.normal(size=(7, 4))
    want = [own[a:b, 0].sum() + sum(own[i, 1:] @ own[j, 1:] for i in range(a, b) for j in range(a, i))
            for a, b in ((0, 3), (3, 4), (4, 7))]
    assert np.allclose(linear.machine_score(own, np.array([0, 3, 4])), want)


def test_toxicity_query_on_held_out_rows(spark, truth):
    rows = queries.op10(spark, SF).collect()
    assert len(rows) == queries.table(spark, SF, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
               and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    one = [r.score for r in held if truth[r.doc_id].toxic]
    zero = [r.score for r in held if not truth[r.doc_id].toxic]
    assert np.mean([a > b for a in one for b in zero]) > 0.85


def test_quality_query(spark, truth):
    rows = queries.op8(spark, SF).collect()
    known = [(truth[r.doc_id].quality, r) for r in rows if r.doc_id in truth]
    good, poor = [r.score for q, r in known if q], [r.score for q, r in known if not q]
    assert np.mean([a > b for a in good for b in poor]) > 0.97
    assert np.mean([s >= 0.5 for s in good]) > 0.98 and np.mean([s < 0.5 for s in poor]) > 0.8


def test_co_training_hands_labels_over():
    draw = np.random.default_rng(3)
    y = draw.integers(0, 2, 600)
    views = [[np.unique(np.where(draw.random(6) < 0.8, 10 * v + 2 * np.arange(6) + k, 50 + np.arange(6))).astype(np.int32)
              for k in y] for v in (1, 5)]
    few = np.arange(600) < 20
    models = quality.co_train([[v[i] for i in np.flatnonzero(few)] for v in views], y[few],
                              [[v[i] for i in np.flatnonzero(~few)] for v in views], confident=0.8)
    for v in (0, 1):
        model, slope, intercept = models[v]
        z = slope * quality._margin(views[v], model) + intercept
        assert ((z > 0) == y)[~few].mean() > 0.9


def test_mixing_meets_its_targets(spark):
    rows = queries.op3(spark, SF).collect()
    assert all(0 <= r.rate <= 1 and r.copies in (0, 1) and r.tokens >= 0 for r in rows)
    words = {d: sum(r.tokens * r.rate * r[f"p_{d}"] for r in rows) for d in mixing.DOMAINS}
    total = sum(words.values())
    for d in mixing.DOMAINS:
        assert abs(words[d] / total - mixing.WEIGHTS[d]) < 0.02
    clean = [r for r in rows if r.p_clean > 0.99]
    assert np.mean([r.copies for r in clean]) > 0.99


def test_projected_gradient_against_a_dense_solver(spark):
    draw = np.random.default_rng(4)
    p = draw.dirichlet([0.3, 0.3, 0.3], 80)
    n = draw.integers(1, 50, 80)
    df = spark.createDataFrame([(i, int(k), *map(float, q)) for i, (k, q) in enumerate(zip(n, p))],
                               "doc_id bigint, tokens bigint, p0 double, p1 double, p2 double")
    steps = [[0.3, -0.2, 0.5], [0.1, 0.4, -0.6], [0.2, 0.2, 0.2]]
    got = [r.rate for r in df.withColumn("rate", mixing._rate(steps, 1.0)).orderBy("doc_id").collect()]
    want = np.ones(80)
    for s in steps:
        want = np.clip(want - p @ np.array(s), 0, 1)
    assert np.allclose(got, want)


@pytest.mark.parametrize("kind", ["soft", "scarce"])
def test_rates_reach_the_least_squares_solution(spark, kind):
    draw = np.random.default_rng(6)
    count = 400
    domain = draw.choice(3, count, p=[0.6, 0.25, 0.15] if kind == "soft" else [0.9, 0.01, 0.09])
    top, cut = draw.uniform(*((0.4, 0.9) if kind == "soft" else (0.9, 1.0)), count), draw.uniform(size=count)
    p = np.empty((count, 3))
    for d in range(3):
        p[domain == d] = np.insert(np.stack([(1 - top) * cut, (1 - top) * (1 - cut)], 1)[domain == d], d,
                                   top[domain == d], axis=1)
    n = draw.integers(20, 2000, count)
    df = spark.createDataFrame([(int(k), *map(float, q)) for k, q in zip(n, p)],
                               "tokens bigint, p0 double, p1 double, p2 double").cache()
    rated = mixing.solve_rates(df).collect()
    r, a = np.array([x.rate for x in rated]), np.array([[x.tokens * x[f"p{d}"] for d in range(3)] for x in rated])
    size = a.sum(axis=0)
    goal = np.array(mixing.targets(size.tolist(), mixing.WEIGHTS))
    want = np.ones(count)                   # one rate at a time to its best value, until nothing moves
    left = size - goal
    for _ in range(4000):
        before = want.copy()
        for i in range(count):
            to = min(1.0, max(0.0, want[i] - (a[i] / size) @ left / ((a[i] ** 2 / size).sum())))
            left += a[i] * (to - want[i])
            want[i] = to
        if abs(want - before).max() < 1e-9:
            break

    def cost(x):
        return ((a.T @ x - goal) ** 2 / size).sum() / size.sum()

    assert r.min() >= 0 and r.max() <= 1 and cost(r) <= cost(want) + 1e-5
    assert np.allclose(a.T @ r / size, a.T @ want / size, atol=0.002)
    with pytest.raises(RuntimeError, match="after 2 steps"):
        mixing.solve_rates(df, steps=2)


@pytest.mark.parametrize("labelled", [ODD_LABELS, []])
def test_odd_rows(spark, labelled):
    docs, labels = docs_of(spark, ODD), labels_of(spark, labelled)
    kept = quality.score_quality(docs, labels)
    assert kept.columns == [*docs.columns, *quality.SCORES] and kept.count() == len(ODD)
    scored = toxicity.score_toxicity(docs, labels).collect()
    assert len(scored) == len(ODD) and all(0 <= r.score <= 1 for r in scored)
    assert [r.held_out for r in scored if r.doc_id is None] == [False, False]
    rated = mixing.mixing_rates(docs, labels).collect()
    assert len(rated) == len(ODD) and all(abs(r.p0 + r.p1 + r.p2 - 1) < 1e-6 for r in rated)
    mixed = mixing.apply_mix(docs, labels)
    assert mixed.columns == docs.columns and mixed.where("doc_id is null").count() == 2


def test_empty_tables(spark):
    docs, labels = docs_of(spark, []), labels_of(spark, ODD_LABELS)
    assert quality.keep_good(docs, labels).count() == 0
    assert toxicity.score_toxicity(docs, labels).count() == 0
    assert mixing.apply_mix(docs, labels).count() == 0


def test_pipeline_stages(spark, truth, tmp_path):
    docs = queries.table(spark, SF, "documents")
    columns, before = docs.columns, {r.doc_id for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert after <= before
        if name == "packing":
            assert after == before and docs.where("start = 0").count() == len(before)
            break
        assert docs.columns == columns and docs.count() == len(after)
        if name == "exact_dedup":
            texts = [r.text.lower() for r in docs.collect()]
            assert len(texts) == len(set(texts))
        good = {i for i in before if i in truth and truth[i].quality and not truth[i].toxic}
        if name in ("quality", "mixing"):
            assert len(good & after) > 0.97 * len(good)
        before = after


def test_pipeline_on_odd_rows(spark):
    docs = docs_of(spark, ODD)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() >= 1


def test_exchange_takes_the_most_confident_of_all_unlabelled_rows(spark):
    rows = queries.table(spark, SF, "documents")
    labels = queries.table(spark, SF, "labels")
    views, y, _ = features.gather(rows, features.chosen(labels, ["quality"], 200), ["quality"], quality._views, quality.VIEWS, 2)
    models = [linear.fit_softmax(v, y[:, 0], 2) for v in views]
    got = {(r.view, r.label, r._id) for r in quality.most_confident(rows, labels, models, 15, 0.9).collect()}
    known = {r.doc_id for r in labels.collect()}
    margins = {}
    for batch in rows.select(*quality.VIEWS, "doc_id").orderBy("doc_id").toArrow().to_batches():
        for part, f in features.slices(batch):
            for v, m in enumerate(quality._margins(part, f, models)):
                for i, x in zip(part["doc_id"].to_pylist(), m.tolist()):
                    if i not in known:
                        margins.setdefault((v, int(x > 0)), {}).setdefault(abs(x), i)
    want = set()
    for (v, label), found in margins.items():
        sure = sorted(((x, i) for x, i in found.items() if 1 / (1 + np.exp(-x)) >= 0.9), key=lambda q: (-q[0], q[1]))
        want |= {(v, label, i) for _, i in sure[:15]}
    assert len(got) > 30 and got == want


def test_corpus_exchange_hands_over_in_the_other_views_terms(spark):
    docs, labels = queries.table(spark, SF, "documents").limit(300), queries.table(spark, SF, "labels")
    views, y, _ = features.gather(docs, features.chosen(labels, ["quality"], 200), ["quality"], quality._views, quality.VIEWS, 2)
    models = [linear.fit_softmax(v, y[:, 0], 2) for v in views]
    handed = quality.corpus_exchange(docs, labels, most=5, confident=0.6)(models, 0)
    chosen = quality.most_confident(docs, labels, models, 5, 0.6).collect()
    for v in (0, 1):
        rows, given = handed[v]
        mine = {r._id: r.label for r in chosen if r.view == v}
        assert len(rows) == len(given) == len(mine) > 0 and sorted(given) == sorted(mine.values())
    hidden = docs.select("doc_id").where("doc_id is null")
    assert quality.most_confident(docs.join(hidden, "doc_id", "left_semi"), labels, models, 5, 0.6).count() == 0


def test_slice_features_equal_plain_ones():
    texts = ["", None, "The the THE, (word)!! x9", "a a a b", "é ÉCOLE «Été» ...", "word\nword  other", "~~~ !!", "x" * 100_000]
    f = features.TextFeatures(pa.array(texts))
    plain = [(t or "").split() for t in texts]
    edges = features._EDGES
    of = {}
    for row, i in zip(*f.kind("word")):
        of.setdefault(int(row), set()).add(int(i))
    sets = [{w.strip(edges).lower() for w in p} for p in plain]
    assert [len(of.get(k, ())) for k in range(len(texts))] == [len(s) for s in sets]
    for a in range(len(texts)):
        for b in range(a):
            assert len(of.get(a, set()) & of.get(b, set())) == len(sets[a] & sets[b])
    n = [max(1, len(p)) for p in plain]
    assert np.allclose(f.share("caps"), [sum(w.strip(edges).isupper() and len(w.strip(edges)) > 1 for w in p) / k for p, k in zip(plain, n)])
    assert np.allclose(f.share("marks"), [sum(len(w) - len(w.strip(edges)) > 1 for w in p) / k for p, k in zip(plain, n)])
    assert np.allclose(f.share("digits"), [sum(any(c.isdigit() for c in w.strip(edges)) for w in p) / k for p, k in zip(plain, n)])
    assert np.allclose(f.repeat_share(), [sum(a == b for a, b in zip(p, p[1:])) / k for p, k in zip(plain, n)])
    assert np.allclose(f.distinct_share(), [len(set(p)) / k for p, k in zip(plain, n)])
    assert f.words.sums(f.of_word["size"]).tolist() == [sum(map(len, p)) for p in plain]
    for offsets, ids in (features.style_features(f), features.term_features(f)):
        assert len(offsets) == len(texts) + 1 and (np.diff(offsets) >= 1).all() and offsets[-1] == len(ids)
        assert all(len(set(ids[a:b])) == b - a for a, b in zip(offsets, offsets[1:]))
    assert features.term_features(features.TextFeatures(pa.array([], pa.string())))[0].tolist() == [0]


def test_columns_with_clashing_names_survive(spark):
    extra = ["_score", "_text_score", "_metadata_score", "id", "_id", "copies", "_copies", "copy"]
    docs = docs_of(spark, ODD)
    for c in extra:
        docs = docs.withColumn(c, docs["p"])
    labels = labels_of(spark, ODD_LABELS)
    for kept in (quality.keep_good(docs, labels), mixing.apply_mix(docs, labels)):
        assert kept.columns == docs.columns and all(r[c] == "p" for r in kept.collect() for c in extra)
    scored = quality.score_quality(docs, labels)
    assert scored.columns == [c for c in docs.columns if c not in quality.SCORES] + quality.SCORES
