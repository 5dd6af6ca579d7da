"""Random forest whose trees each have a balanced bootstrap of their own, grown tree by tree in
parallel, and exact, path-dependent Tree SHAP of its probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Draws of a tree, in expectation: they bound what a task holds.
DRAWS = 200_000

_TREE = "tree int, draws long, rows long, weight_0 double, weight_1 double, left array<int>, right array<int>, feature array<int>, threshold array<double>, cover array<double>, value array<double>"


def _poisson_steps(mean: float) -> list[float]:
    """Probabilities of at most 0, 1, 2, ... events, up to one that is 1 to 15 digits."""
    term, total, steps, k = float(np.exp(-mean)), 0.0, [], 0
    while total < 1 - 1e-15 and k < mean + 40 * max(1.0, mean) ** 0.5:
        total += term
        steps.append(total)
        k += 1
        term *= mean / k
    return steps


def bootstrap_draws(rows: DataFrame, key: str, trees: int, mean: float, seed: int) -> DataFrame:
    """``rows`` with column ``tree``: a row once for every time that a tree draws it.

    A tree draws each row a Poisson number of times with the given mean. All trees' draws of a row
    together are one Poisson number, each of which falls to a tree at random; so rows that nobody
    draws cost nothing, and draws depend on the seed and the key alone.
    """
    unit: Column = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(-1), F.col(key).cast("string")), 11).cast("double") / float(1 << 53)
    steps = F.array(*[F.lit(s) for s in _poisson_steps(trees * mean)])
    times = F.size(F.filter(steps, lambda s: s <= F.col("_u")))
    drawn = rows.withColumn("_u", unit).withColumn("_times", times).filter("_times > 0").withColumn("_draw", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return drawn.withColumn("tree", F.pmod(F.xxhash64(F.lit(seed), F.col("_draw"), F.col(key).cast("string")), F.lit(trees)).cast("int")).drop("_u", "_times", "_draw")


def _best_split(x: np.ndarray, y: np.ndarray, w: np.ndarray, least: int) -> tuple[float, float] | None:
    """(impurity left, threshold) of the best cut of one feature."""
    order = np.argsort(x, kind="stable")
    x, y, w = x[order], y[order], w[order]
    ones, all_ = np.cumsum(w * y)[:-1], np.cumsum(w)[:-1]
    cut = np.flatnonzero(x[1:] > x[:-1])
    cut = cut[(cut + 1 >= least) & (len(x) - cut - 1 >= least)]
    if not len(cut):
        return None
    total, total_ones = w.sum(), (w * y).sum()
    a, b = all_[cut], total - all_[cut]
    a1, b1 = ones[cut], total_ones - ones[cut]
    # Weighted Gini impurity of both sides, times their weight.
    impurity = 2 * (a1 * (a - a1) / a + b1 * (b - b1) / b)
    k = int(impurity.argmin())
    low, high = x[cut[k]], x[cut[k] + 1]
    middle = low + (high - low) / 2
    return float(impurity[k]), float(low if middle >= high else middle)


def grow(x: np.ndarray, y: np.ndarray, draws: np.ndarray, depth: int, least: int, tried: int, seed: int) -> dict:
    """One tree on rows drawn ``draws`` times: classes weigh the same in this draw, a node tries
    ``tried`` features that vary, leaves hold ``least`` rows or more."""
    r = np.random.default_rng(seed)
    n = np.array([draws[y == k].sum() for k in (0, 1)], np.float64)
    weight = np.divide(draws.sum(), 2 * n, out=np.zeros(2), where=n > 0)
    w = draws * weight[y]
    left, right, feature, threshold, cover, value = [], [], [], [], [], []
    stack = [(np.arange(len(y)), 0, -1, False)]
    while stack:
        rows, level, parent, is_right = stack.pop()
        k = len(left)
        if parent >= 0:
            (right if is_right else left)[parent] = k
        mine, own = w[rows].sum(), (w[rows] * y[rows]).sum()
        left.append(-1), right.append(-1), feature.append(-1), threshold.append(0.0), cover.append(float(mine)), value.append(float(own / mine) if mine else 0.0)
        if level == depth or len(rows) < 2 * least or own == 0 or own == mine:
            continue
        best, seen = None, 0
        for f in r.permutation(x.shape[1]).tolist():
            if seen >= tried and best:
                break
            column = x[rows, f]
            if column.min() == column.max():
                continue
            seen += 1
            found = _best_split(column, y[rows], w[rows], least)
            if found and (best is None or found[0] < best[0]):
                best = (*found, f)
        if best:
            feature[k], threshold[k] = best[2], best[1]
            goes = x[rows, best[2]] <= best[1]
            stack += [(rows[~goes], level + 1, k, True), (rows[goes], level + 1, k, False)]
    return {"draws": int(draws.sum()), "rows": len(y), "weight_0": float(weight[0]), "weight_1": float(weight[1]), "left": left, "right": right, "feature": feature, "threshold": threshold, "cover": cover, "value": value}


def fit_forest(rows: DataFrame, features: list[str], key: str, target: str = "target", trees: int = 100, depth: int = 12, min_leaf: int = 2, draws: int = DRAWS, seed: int = 42) -> DataFrame:
    """One row a tree: its draws, the weights of the classes in them, and its nodes as arrays.

    Each tree draws ``draws`` rows in expectation, as many as there are rows at most, and is grown in
    a task of its own; what moves is bounded by trees and draws. Targets are 0 or 1. Rows that share a
    key are drawn together.
    """
    n = rows.count()
    given = rows.select(F.col(key), F.col(target).cast("int").alias("_y"), *[F.col(f"`{f}`").cast("double").alias(f"_x{k}") for k, f in enumerate(features)])
    drawn = bootstrap_draws(given, key, trees, min(1.0, draws / max(1, n)), seed)
    names, tried = [f"_x{k}" for k in range(len(features))], max(1, int(len(features) ** 0.5))

    def run(tree: tuple, part: pd.DataFrame) -> pd.DataFrame:
        one = part.groupby([key, "_y", *names], sort=True, dropna=False).size().reset_index(name="_n")
        found = grow(one[names].to_numpy(np.float64), one["_y"].to_numpy(), one["_n"].to_numpy(np.float64), depth, min_leaf, tried, seed * 1_000_003 + tree[0])
        return pd.DataFrame({"tree": [tree[0]], **{k: [v] for k, v in found.items()}})

    return drawn.groupBy("tree").applyInPandas(run, _TREE)


class Tree:
    """One tree as arrays: children (-1 at leaves), split feature and threshold, cover, value."""

    def __init__(self, left, right, feature, threshold, cover, value) -> None:
        self.left, self.right, self.feature, self.threshold, self.cover, self.value = (np.asarray(v) for v in (left, right, feature, threshold, cover, value))

    def expected(self) -> float:
        leaves = self.left < 0
        return float((self.cover[leaves] * self.value[leaves]).sum() / self.cover[0]) if self.cover[0] else 0.0

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The leaf's value for each row."""
        at = np.zeros(len(x), np.int64)
        while (inner := np.flatnonzero(self.left[at] >= 0)).size:
            here = at[inner]
            goes = x[inner, self.feature[here]] <= self.threshold[here]
            at[inner] = np.where(goes, self.left[here], self.right[here])
        return self.value[at]

    def shap(self, x: np.ndarray, out: np.ndarray) -> None:
        """Adds each feature's contributions to this tree's values, for all rows at once.

        For a leaf the path's distinct features form a game whose Shapley values follow from the
        polynomial prod_j (zero_j + one_j t): zero_j is the share of cover that goes on when feature
        j is unknown, one_j whether the row itself goes on. Weights |S|! (m-|S|-1)! / m! integrate
        the polynomial without the feature itself, which is a division by its factor.
        """
        stack = [(0, {})]
        while stack:
            k, path = stack.pop()
            if self.left[k] >= 0:
                f = int(self.feature[k])
                share, goes_on = path.get(f, (1.0, np.ones(len(x), bool)))
                goes = x[:, f] <= self.threshold[k]
                for child, here in ((self.left[k], goes), (self.right[k], ~goes)):
                    part = self.cover[child] / self.cover[k] if self.cover[k] else 0.0
                    stack.append((int(child), {**path, f: (share * part, goes_on & here)}))
                continue
            if not path or not self.value[k]:
                continue
            weights, whole = _shapley_weights(len(path)), np.ones((1, len(x)))
            for zero, one in path.values():
                up = np.zeros((len(whole) + 1, len(x)))
                up[:-1] = whole * zero
                up[1:] += whole * one
                whole = up
            for f, (zero, one) in path.items():
                # whole / (zero + t) from the top where the row goes on, else whole / zero.
                with_one, carry = 0.0, 0.0
                for s in range(len(path) - 1, -1, -1):
                    carry = whole[s + 1] - zero * carry
                    with_one = with_one + weights[s] * carry
                without = weights @ whole[:-1] / zero if zero else np.zeros(len(x))
                out[:, f] += (one - zero) * np.where(one, with_one, without) * self.value[k]


_WEIGHTS: dict[int, np.ndarray] = {}


def _shapley_weights(m: int) -> np.ndarray:
    """|S|! (m - |S| - 1)! / m! for |S| = 0 to m - 1."""
    if m not in _WEIGHTS:
        w = [1.0 / m]
        for s in range(1, m):
            w.append(w[-1] * s / (m - s))
        _WEIGHTS[m] = np.array(w)
    return _WEIGHTS[m]


def trees_of(forest: DataFrame) -> list[Tree]:
    """The forest's trees on the driver: their size is bounded by trees and depth, not by the data."""
    names = ("left", "right", "feature", "threshold", "cover", "value")
    return [Tree(*[r[n] for n in names]) for r in forest.orderBy("tree").collect()]


def tree_shap(rows: DataFrame, forest: DataFrame, features: list[str], key: str) -> DataFrame:
    """(key, base, probability, phi array<double>); base plus the phis is the probability."""
    trees = rows.sparkSession.sparkContext.broadcast(trees_of(forest))
    kind = dict(rows.dtypes)[key]
    names = [f"_x{k}" for k in range(len(features))]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = trees.value
        base = sum(t.expected() for t in known) / max(1, len(known))
        for part in parts:
            x = part[names].to_numpy(np.float64)
            phi, p = np.zeros(x.shape), np.zeros(len(x))
            for t in known:
                t.shap(x, phi)
                p += t.predict(x)
            yield pd.DataFrame({key: part[key], "base": base, "probability": p / max(1, len(known)), "phi": list(phi / max(1, len(known)))})

    return rows.select(key, *[F.col(f"`{f}`").cast("double").alias(n) for f, n in zip(features, names, strict=True)]).mapInPandas(run, f"{key} {kind}, base double, probability double, phi array<double>")
