"""Softmax regression and factorization machines over hashed presence features, trained with numpy.

A model is ``(ids, table)``: sorted feature ids, and a row of weights for each
after a row 0 of zeros that stands for all other features.
"""

from __future__ import annotations

import numpy as np

from .features import Ragged, ragged


def numbered(idx: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Row of each feature in a model's table."""
    if not len(ids):
        return np.zeros(len(idx), np.int64)
    at = np.searchsorted(ids, idx).clip(max=len(ids) - 1)
    return np.where(ids[at] == idx, at + 1, 0)


def _compact(rows: list[np.ndarray], ids: np.ndarray) -> list[np.ndarray]:
    """Rows as rows of the table, unknown features once as 0."""
    out = []
    for r in rows:
        at = numbered(r, ids)
        out.append(np.concatenate([[0], at[at > 0]]))
    return out


def frequent(rows: list[np.ndarray], least: int) -> np.ndarray:
    ids, n = np.unique(np.concatenate(rows), return_counts=True)
    return ids[n >= least]


def telling(rows: list[np.ndarray], y: np.ndarray, least: int, most: int, sure: float) -> np.ndarray:
    """Ids of the at most ``most`` features, in ``least`` rows or more, whose shares in both classes differ most surely.

    Their difference has to be over ``sure`` standard errors: among many terms a few differ by chance.
    """
    ids, place = np.unique(np.concatenate(rows), return_inverse=True)
    label = np.repeat(y, list(map(len, rows)))
    one, all_ = np.bincount(place, label, len(ids)), np.bincount(place, minlength=len(ids))
    n1, n = max(1, y.sum()), max(1, len(y))
    n0 = max(1, n - n1)
    share = all_ / n
    z = np.abs(one / n1 - (all_ - one) / n0) / np.sqrt((share * (1 - share) + 1e-9) * (1 / n1 + 1 / n0))
    z[all_ < least] = -1
    best = np.argsort(-z, kind="stable")[:most]
    return np.sort(ids[best[z[best] > sure]])


def _batches(rows: list[np.ndarray], size: int, epochs: int):
    draw = np.random.default_rng(17)
    for _ in range(epochs):
        order = draw.permutation(len(rows))
        for k in range(0, len(order), size):
            take = order[k:k + size]
            part = [rows[i] for i in take]
            starts, idx = ragged(part)
            yield take, starts, idx, np.repeat(np.arange(len(part)), list(map(len, part)))


class _Adagrad:
    def __init__(self, shape: tuple, rate: float | np.ndarray):
        self.sum, self.rate = np.full(shape, 1e-6, np.float32), rate

    def step(self, values: np.ndarray, gradient: np.ndarray) -> None:
        self.sum += gradient * gradient
        values -= self.rate * gradient / np.sqrt(self.sum)


def _by_feature(idx: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(idx, values[:, k], n) for k in range(values.shape[1])], axis=1).astype(np.float32)


def fit_softmax(rows: list[np.ndarray], y: np.ndarray, classes: int, weight: np.ndarray | None = None,
                l2: float = 1e-3, epochs: int = 8, least: int = 3, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """A model with a weight per class for each feature found in ``least`` rows or more."""
    if not len(rows):
        return np.zeros(0, np.int32), np.zeros((1, classes), np.float32)
    ids = frequent(rows, least)
    rows = _compact(rows, ids)
    w = np.zeros((len(ids) + 1, classes), np.float32)
    ada, weight = _Adagrad(w.shape, rate), np.ones(len(rows)) if weight is None else weight
    for take, starts, idx, of in _batches(rows, 256, epochs):
        p = softmax(np.add.reduceat(w[idx], starts, axis=0))
        p[np.arange(len(take)), y[take]] -= 1
        p *= weight[take][:, None]
        gradient = _by_feature(idx, p[of], len(w)) / len(take) + l2 * w
        gradient[0] = 0
        ada.step(w, gradient)
    return ids, w


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def ragged_scores(found: Ragged, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sums of the weights of each row's features."""
    offsets, idx = found
    ids, table = model
    return np.add.reduceat(table[numbered(idx, ids)], offsets[:-1], axis=0) if len(idx) else np.zeros((0, table.shape[1]), np.float32)


def scores(rows: list[np.ndarray], model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sums of the weights of each row's features."""
    offsets, idx = ragged(rows)
    return ragged_scores((np.append(offsets, len(idx)), idx), model)


def fit_machine(rows: list[np.ndarray], y: np.ndarray, factors: int = 6, l2: float = 1e-5, epochs: int = 40,
                least: int = 3, most: int = 4096, sure: float = 3.0, rate: float = 0.1, l1: float = 1e-3,
                factor_l2: float = 1e-2, factor_rate: float = 0.02) -> tuple[np.ndarray, np.ndarray, float]:
    """Factorization machine for labels 0/1 over all features found in ``least`` rows or more: model and constant.

    A feature's row holds its linear weight and its factors. The ``most`` telling
    features are held back by ``l2`` only; all others, which may count in pairs
    alone, by ``l1`` on the weight and ``factor_l2`` on factors that move at
    ``factor_rate``. Rows of the rarer class count more, by the square root of
    the odds, for the sake of recall.
    """
    if not len(rows):
        return np.zeros(0, np.int32), np.zeros((1, 1 + factors), np.float32), 0.0
    ids, told = frequent(rows, least), telling(rows, y, least, most, sure)
    rows = _compact(rows, ids)
    table = np.zeros((len(ids) + 1, 1 + factors), np.float32)
    table[1:, 1:] = np.random.default_rng(5).normal(0, 0.02, (len(ids), factors))
    plain = np.concatenate([[True], np.isin(ids, told)])
    rates, held = np.full(table.shape, rate, np.float32), np.full(table.shape, l2, np.float32)
    rates[~plain, 1:], held[~plain, 1:] = factor_rate, factor_l2
    pull = np.where(plain, 0, rate * l1).astype(np.float32)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    constant = np.array([np.log(share / (1 - share))], np.float32)
    weight = np.where(y == 1, np.sqrt((1 - share) / share), 1).clip(1, 5)
    ada, ada0 = _Adagrad(table.shape, rates), _Adagrad((1,), rate)
    for take, starts, idx, of in _batches(rows, 256, epochs):
        own = table[idx]
        total = np.add.reduceat(own, starts, axis=0)
        error = (weight[take] * (sigmoid(machine_score(own, starts) + constant[0]) - y[take])).astype(np.float32)
        gradient = np.empty_like(own)
        gradient[:, 0] = 1
        gradient[:, 1:] = total[of, 1:] - own[:, 1:]
        gradient *= error[of, None]
        gradient = _by_feature(idx, gradient, len(table)) / len(take) + held * table
        gradient[0] = 0
        ada.step(table, gradient)
        table[:, 0] = np.sign(table[:, 0]) * np.maximum(0, np.abs(table[:, 0]) - pull / np.sqrt(ada.sum[:, 0]))
        ada0.step(constant, np.array([error.mean()], np.float32))
    return ids, table, float(constant[0])


def machine_score(own: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Linear terms and all pairwise interactions, by half the square of sums less the sum of squares."""
    total = np.add.reduceat(own, starts, axis=0)
    squares = np.add.reduceat(own[:, 1:] ** 2, starts, axis=0)
    return total[:, 0] + 0.5 * (total[:, 1:] ** 2 - squares).sum(axis=1)
