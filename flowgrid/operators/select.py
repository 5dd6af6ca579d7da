"""Feature selection: mean absolute Tree SHAP contributions of a balanced forest, ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgrid.operators.forest import fit_forest, tree_shap
from flowgrid.operators.split import sample_per_class
from flowgrid.sources.scratch import stable


def importance(shap: DataFrame, features: list[str]) -> DataFrame:
    """(feature, importance): mean absolute contributions."""
    wide = shap.agg(*[F.avg(F.abs(F.col("phi")[k])).alias(f"v_{k}") for k in range(len(features))])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(k).alias("feature_index"), F.col(f"v_{k}").alias("importance")) for k, f in enumerate(features)])).alias("x")).select("x.*")


def rank_features(importances: DataFrame, keep: int = 15) -> DataFrame:
    """Ranks from 1 by falling importance, ties by index; the first ``keep`` are selected."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.orderBy(F.desc("importance"), "feature_index"))  # a row a feature
    return importances.withColumn("rank", rank).withColumn("selected", F.col("rank") <= keep)


def select_features(rows: DataFrame, features: list[str], key: str, target: str = "target", keep: int = 15, trees: int = 100, depth: int = 12, shap_per_class: int = 500, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The ranking and the forest: grown on all rows, explained on as many rows of each class."""
    forest = stable(fit_forest(rows, features, key, target, trees, depth, seed=seed))
    sample = sample_per_class(rows, shap_per_class, key, target, seed)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shap = tree_shap(sample.repartition(parts, key), forest, features, key)
    return rank_features(importance(shap, features), keep), forest
