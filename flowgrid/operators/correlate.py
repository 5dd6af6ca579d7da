"""Correlations within windows and the learned filter of their entries."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgrid.functions.scalar import clip_unit

TOLERANCE = 1e-12


def entry_pairs(features: list[str]) -> list[tuple[str, str]]:
    """The upper triangle's entries, row by row."""
    return list(combinations(features, 2))


def window_moments(rows: DataFrame, features: list[str], by: str = "window_id") -> DataFrame:
    """Population deviations (s_f) and covariances (k_a_b) of each window, from one aggregation."""
    aggs = [F.stddev_pop(f"`{f}`").alias(f"s_{f}") for f in features] + [F.covar_pop(f"`{a}`", f"`{b}`").alias(f"k_{a}_{b}") for a, b in entry_pairs(features)]
    return rows.groupBy(by).agg(*aggs)


def _active(f: str, tolerance: float) -> Column:
    return F.coalesce(F.col(f"s_{f}") > tolerance, F.lit(False))


def window_pearson(rows: DataFrame, features: list[str], by: str = "window_id", tolerance: float = TOLERANCE) -> DataFrame:
    """Per window: corr_a_b for each pair, active_f for each feature, and how many are active.

    A feature that doesn't vary has no correlation: its entries, the diagonal too, count as 0.
    """
    m = window_moments(rows, features, by)
    corr = {f"corr_{a}_{b}": F.when(_active(a, tolerance) & _active(b, tolerance), clip_unit(F.try_divide(F.col(f"k_{a}_{b}"), F.col(f"s_{a}") * F.col(f"s_{b}")))).otherwise(0.0) for a, b in entry_pairs(features)}
    active = {f"active_{f}": _active(f, tolerance) for f in features}
    return m.select(by, *[c.alias(n) for n, c in corr.items()], *[c.alias(n) for n, c in active.items()], sum((c.cast("int") for c in active.values()), F.lit(0)).alias("varying_features"))


def pearson_arrow(rows: DataFrame, features: list[str], by: str = "window_id", tolerance: float = TOLERANCE) -> DataFrame:
    """The same for many features: (window, corr array<float> row by row, active array<boolean>).
    Windows are small and equal in size, so a batch of them is one array computation."""
    grouped = rows.groupBy(by).agg(F.collect_list(F.array(*[F.col(f"`{f}`").cast("double") for f in features])).alias("x"))
    kind = dict(rows.dtypes)[by]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for _, same in part.groupby(part["x"].map(len)):
                x = np.array([np.stack(v) for v in same["x"]])
                x = x - x.mean(1, keepdims=True)
                deviation = np.sqrt((x * x).mean(1))
                active = deviation > tolerance
                unit = np.where(active[:, None, :], x / np.where(active, deviation, 1.0)[:, None, :], 0.0)
                corr = np.clip(np.einsum("wra,wrb->wab", unit, unit) / x.shape[1], -1, 1)
                k = np.arange(x.shape[2])
                corr[:, k, k] = active
                yield pd.DataFrame({by: same[by].to_numpy(), "corr": list(corr.reshape(len(x), -1).astype(np.float32)), "active": list(active)})

    return grouped.mapInPandas(run, f"{by} {kind}, corr array<float>, active array<boolean>")


def entry_covariance(correlations: DataFrame, entries: list[str]) -> DataFrame:
    """(entry_i, entry_j, covariance) for i <= j: population covariances over the rows given.

    Each task merges its batches' moments; the tasks' moments, whose size is that of the entries'
    square, are merged pairwise on the executors.
    """
    n_entries = len(entries)

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, mean, m2 = 0, np.zeros(n_entries), np.zeros((n_entries, n_entries))
        for part in parts:
            x = part.to_numpy(np.float64)
            if len(x):
                n, mean, m2 = _merge((n, mean, m2), (len(x), x.mean(0), (x - x.mean(0)).T @ (x - x.mean(0))))
        if n:
            yield pd.DataFrame({"g": [0], "n": [n], "mean": [mean], "m2": [m2.ravel()]})

    schema = "g int, n long, mean array<double>, m2 array<double>"

    def merged(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = (0, np.zeros(n_entries), np.zeros((n_entries, n_entries)))
        for r in rows.itertuples():
            total = _merge(total, (r.n, np.asarray(r.mean), np.asarray(r.m2).reshape(n_entries, n_entries)))
        return pd.DataFrame({"g": [key[0]], "n": [total[0]], "mean": [total[1]], "m2": [total[2].ravel()]})

    moments = correlations.select(*[F.col(f"`{e}`").cast("double") for e in entries]).mapInPandas(partial, schema)
    # Two levels, so that no task meets more moments than the square root of the tasks.
    moments = moments.withColumn("g", F.spark_partition_id() % 64).groupBy("g").applyInPandas(merged, schema)
    total = moments.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(merged, schema)
    index = [(i, j) for i in range(n_entries) for j in range(i, n_entries)]
    cells = F.array(*[F.struct(F.lit(entries[i]).alias("entry_i"), F.lit(entries[j]).alias("entry_j"), F.lit(i * n_entries + j).alias("k")) for i, j in index])
    return total.select("n", "m2", F.explode(cells).alias("x")).select("x.entry_i", "x.entry_j", (F.element_at("m2", F.col("x.k") + 1) / F.col("n")).alias("covariance"))


def _merge(a: tuple, b: tuple) -> tuple:
    """Moments of two samples together (Chan, Golub and LeVeque)."""
    if not a[0] or not b[0]:
        return a if a[0] else b
    n, d = a[0] + b[0], b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)


def entry_filter(covariances: DataFrame, entries: list[str], variance_threshold: float = 1e-8, redundancy_threshold: float = 0.999) -> DataFrame:
    """(entry, variance, decision, redundant_with): low_variance, redundant or retained.

    Entries are taken by falling variance; one is redundant if its correlation with a retained one
    reaches the threshold. Sequential by nature, over entries and not rows, so it runs on the driver.
    """
    spark = covariances.sparkSession
    k = {(r["entry_i"], r["entry_j"]): r["covariance"] for r in covariances.collect()}
    cov = lambda a, b: k.get((a, b), k.get((b, a), 0.0))
    kept: list[str] = []
    out = []
    for e in sorted(entries, key=lambda e: (-cov(e, e), entries.index(e))):
        v = cov(e, e)
        if v <= variance_threshold:
            out.append((e, v, "low_variance", None))
            continue
        partner = next((o for o in kept if abs(max(-1.0, min(1.0, cov(e, o) / (v * cov(o, o)) ** 0.5))) >= redundancy_threshold), None)
        out.append((e, v, "redundant" if partner else "retained", partner))
        if not partner:
            kept.append(e)
    return spark.createDataFrame(out, "entry string, variance double, decision string, redundant_with string")


def filtered_matrix(corr: Column | str, n: int, gone: set[tuple[int, int]]) -> Column:
    """A square matrix, row by row, in which the entries ``gone`` (i < j), and their mirrors, are 0."""
    corr = F.col(corr) if isinstance(corr, str) else corr
    return F.array(*[F.lit(0.0).cast("float") if (min(i, j), max(i, j)) in gone else corr[i * n + j] for i in range(n) for j in range(n)])
