"""Hard negatives: bit planes and tables against plain products, the miner against brute force."""

import numpy as np
import pytest

from moodspark.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, embedding array<double>, label int, uid string, v double, score int, planes string, block int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, "clash", 1.0, 7, None, 3) for i, v, y in rows], SCHEMA)


def brute(rows, every=100, positives=5, negatives=10, low=30, high=90):
    ok = [(i, y, [int(np.floor(256 * x)) for x in v]) for i, v, y in rows
          if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for k, (i, y, v) in enumerate(ok):
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, z) for n, (j, z, w) in enumerate(ok) if n != k)
        for rank, (s, j, _) in enumerate([x for x in scored if x[2] == y][:positives], 1):
            fit = [x for x in scored if x[2] != y and low * -s <= 100 * -x[0] <= high * -s]
            out += [(i, j, r, m, -s, -t, rank) for r, (t, m, _) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, **how):
    return sorted(map(tuple, hn.mine_negatives(frame(spark, rows), **how).collect()))


def test_planes_and_tables_give_the_inner_products():
    draw = np.random.default_rng(0)
    for dims, size, planes in ((8, 1, 2), (16, 255, 9), (64, 40_000, 17)):
        rows, anchors = draw.integers(-size - 1, size + 1, (30, dims)), draw.integers(-size - 1, size + 1, (7, dims))
        octets = hn.bit_planes(rows, planes)
        assert (hn.from_planes(octets) == rows).all()
        assert (hn.table_scores(octets, hn.subset_sums(anchors)) == rows @ anchors.T).all()


def test_subset_sums_hold_every_subset():
    one = np.array([[3, -5, 7, 0, 11, -13, 17, 19]])
    want = [sum(int(x) for b, x in enumerate(one[0]) if s >> b & 1) for s in range(256)]
    assert hn.subset_sums(one)[0, :, 0].tolist() == want


def test_best_keeps_the_smaller_id_of_equal_scores():
    best = hn.Best(1, 2)
    for ids in ([9, 4], [7, 3], [5]):
        n = len(ids)
        best.add(np.zeros((n, 1), np.int64), np.ones((n, 1), bool), np.array(ids), np.array(ids))
    assert best.id.tolist() == [3, 4]


@pytest.mark.parametrize("labels", [2, 40])
def test_equals_brute_force_with_ties_and_a_hot_vector(spark, labels):
    draw = np.random.default_rng(labels)
    hot = [0.25, -0.5, 0.125, 1.0, 0.0]
    rows = [(int(i), hot if i % 3 == 0 else [float(x) for x in draw.choice([-0.5, 0.0, 0.25, 0.3, 1.0], 5)],
             int(draw.integers(labels))) for i in range(600)]
    want = brute(rows, every=20)
    assert len(want) > 500 and mined(spark, rows, every=20) == want
    # blocks of a few anchors give the same
    assert mined(spark, rows, every=20, table_bytes=16 << 10) == want


def test_many_rows_pass_the_batch_threshold(spark):
    draw = np.random.default_rng(3)
    rows = [(i, [float(x) for x in draw.normal(0, 0.2, 16)], int(draw.integers(3))) for i in range(4000)]
    assert mined(spark, rows, every=400) == brute(rows, every=400)


def test_odd_rows(spark):
    v, w = [0.5, 0.25], [0.25, 0.25]
    rows = [(0, v, 1), (0, v, 1), (0, w, 2), (None, v, 1), (100, None, 1), (100, [0.5, None], 1), (100, [float("nan"), 0.0], 1),
            (200, [float("inf"), 0.0], 1), (3, v, None), (4, [], 2), (5, [0.5], 2), (6, [0.5, 0.25, 0.5], 2), (-100, w, 1),
            (8, [0.0, 0.0], 1), (9, [-0.5, -0.5], 1), (300, [0.0, 0.0], 2), (11, w, 3), (11, w, 3)]
    got = mined(spark, rows)
    assert got == brute(rows) and {r[0] for r in got} == {0, -100, 300}
    assert sum(r[:2] == (0, 0) for r in got) > 2        # a copy of the anchor is a positive, for each copy


def test_fewer_than_asked_for_and_none(spark):
    assert mined(spark, [(0, [1.0], 1)]) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2)]) == [(0, 1, 1, 2, 65536, 32768, 1)]
    assert mined(spark, []) == []
    empty = hn.mine_negatives(frame(spark, [])).dtypes
    assert [n for n, _ in empty[:6]] == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_scores_that_do_not_fit_are_an_error(spark):
    with pytest.raises(ValueError, match="bigint"):
        hn.mine_negatives(frame(spark, [(0, [1e300], 1), (1, [1.0], 1)]))
    large = [(0, [1e5, -2e5], 1), (1, [1e5, 1.0], 1), (2, [5e4, 1.0], 2)]
    assert mined(spark, large) == brute(large)
