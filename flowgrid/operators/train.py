"""Training, resuming and frozen evaluation of a classifier on correlation entries.

A Spark ML perceptron stands where a deep network would: the loop, early stop, best checkpoint,
resume and contract checks around it are the same.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgrid.operators import metrics
from flowgrid.operators.split import class_weights
from flowgrid.sources.sinks import exists, read_manifest, write_manifest


@dataclass
class Training:
    """State of a training run: weights after the last epoch, history, and the best epoch's weights."""

    features: list[str]
    layers: list[int]
    weights: list[float] | None = None
    best_weights: list[float] | None = None
    history: list[dict] = field(default_factory=list)
    stale: int = 0


def _assembled(df: DataFrame, features: list[str], target: str) -> DataFrame:
    numbers = [F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)).alias(f) for f in features]
    rest = [F.col(f"`{c}`") for c in df.columns if c not in features]
    return VectorAssembler(inputCols=features, outputCol="_features").transform(df.select(*rest, *numbers)).withColumn("_label", F.col(target).cast("double"))


def balanced(df: DataFrame, target: str = "target", seed: int = 42) -> DataFrame:
    """Rows of the smaller class repeated so often that classes count about alike."""
    weights = {r[target]: r["weight"] for r in class_weights(df, target).collect()}
    most = min(weights.values(), default=1.0)
    times = F.create_map(*[F.lit(v) for t, w in weights.items() for v in (t, max(1, round(w / most)))])
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), times[F.col(target)]))).drop("_copy")


def fit(train: DataFrame, validation: DataFrame, features: list[str], target: str = "target", epochs: int = 20, steps: int = 10, patience: int = 5, hidden: int = 16, seed: int = 42, state: Training | None = None) -> Training:
    """Epochs of a few optimiser steps each, from where the last ended; validated after each.

    The best epoch has the greatest macro F1, then the least cross-entropy; after ``patience`` epochs
    that aren't better, training stops. Pass a state to go on from it.
    """
    state = state or Training(features, [len(features), hidden, 2])
    ready = _assembled(balanced(train, target, seed), features, target).select("_features", "_label").cache()
    for epoch in range(len(state.history) + 1, epochs + 1):
        estimator = MultilayerPerceptronClassifier(layers=state.layers, maxIter=steps, seed=seed, featuresCol="_features", labelCol="_label", blockSize=128)
        if state.weights is not None:
            estimator = estimator.setInitialWeights(Vectors.dense(state.weights))
        model = estimator.fit(ready)
        state.weights = model.weights.toArray().tolist()
        scores = metrics.evaluate(predict(model, validation, features, target), "p", target).first()
        state.history.append({"epoch": epoch, "macro_f1": scores["macro_f1"], "cross_entropy": scores["cross_entropy"], "balanced_accuracy": scores["balanced_accuracy"]})
        best = max(state.history, key=lambda h: (h["macro_f1"], -h["cross_entropy"], -h["epoch"]))
        state.stale = epoch - best["epoch"]
        if best["epoch"] == epoch:
            state.best_weights = state.weights
        if state.stale >= patience:
            break
    ready.unpersist()
    return state


def predict(model: MultilayerPerceptronClassificationModel, df: DataFrame, features: list[str], target: str = "target") -> DataFrame:
    """``df`` with the probability p of class 1, kept off 0 and 1."""
    p = vector_to_array("probability")[1]
    return model.transform(_assembled(df, features, target)).withColumn("p", F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), p))).drop("_features", "_label", "probability", "rawPrediction", "prediction")


def frozen(spark: SparkSession, state: Training) -> MultilayerPerceptronClassificationModel:
    """The model of the best epoch's weights."""
    width = len(state.features)
    two = spark.createDataFrame([(Vectors.dense(np.zeros(width)), float(k)) for k in (0, 1)], ["_features", "_label"])
    estimator = MultilayerPerceptronClassifier(layers=state.layers, maxIter=0, featuresCol="_features", labelCol="_label")
    return estimator.setInitialWeights(Vectors.dense(state.best_weights)).fit(two)


def epoch_metrics(spark: SparkSession, state: Training) -> DataFrame:
    """History as a table, with the epoch that was selected."""
    best = max(state.history, key=lambda h: (h["macro_f1"], -h["cross_entropy"], -h["epoch"]))["epoch"]
    return spark.createDataFrame([(h["epoch"], h["macro_f1"], h["cross_entropy"], h["balanced_accuracy"], h["epoch"] == best) for h in state.history], "epoch int, macro_f1 double, cross_entropy double, balanced_accuracy double, selected_as_best boolean")


def save(spark: SparkSession, state: Training, folder: str, fingerprint: str) -> None:
    """State and what it was trained on, in one manifest."""
    write_manifest(spark, folder, {"kind": "training", "features": state.features, "layers": state.layers, "weights": state.weights, "best_weights": state.best_weights, "history": state.history, "fingerprint": fingerprint})


def load(spark: SparkSession, folder: str, features: list[str], fingerprint: str) -> Training:
    """A saved state; features or data that differ from those it was trained on fail."""
    if not exists(spark, f"{folder.rstrip('/')}/manifest.json"):
        raise FileNotFoundError(folder)
    m = read_manifest(spark, folder)
    if m.get("kind") != "training" or m["features"] != features or m["fingerprint"] != fingerprint:
        raise ValueError("the model was trained on other features or data")
    return Training(m["features"], m["layers"], m["weights"], m["best_weights"], m["history"])
