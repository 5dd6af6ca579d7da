"""Classification diagnostics from scores and confusion cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgrid.functions.scalar import above, safe_divide
from flowgrid.operators.ordering import quantiles, running_sums


def confusion(df: DataFrame, target: str = "target", predicted: str = "predicted", by: list[str] | None = None) -> DataFrame:
    """tn, fp, fn, tp; cells that don't occur are 0."""
    t, p = F.col(target), F.col(predicted)
    return df.groupBy(*(by or [])).agg(*[F.count_if((t == a) & (p == b)).alias(n) for n, a, b in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))])


def _harmonic(p: Column, r: Column, default: float | None) -> Column:
    return safe_divide(2 * p * r, p + r, default)


def class_metrics(cells: DataFrame, absent: float | None = 0.0) -> DataFrame:
    """Precision, recall and F1 of both classes, accuracy, macro, weighted and balanced scores.

    ``absent`` is what a zero denominator gives: 0, or null where a class that isn't there should
    leave its scores undefined.
    """
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    zero = 0.0
    has = lambda support, c: c if absent is not None else F.when(support > 0, c)
    benign, malicious = tn + fp, fn + tp
    bp, br = has(benign, safe_divide(tn, tn + fn, zero)), has(benign, safe_divide(tn, benign, zero))
    mp, mr = has(malicious, safe_divide(tp, tp + fp, zero)), has(malicious, safe_divide(tp, malicious, zero))
    bf, mf = has(benign, _harmonic(bp, br, zero)), has(malicious, _harmonic(mp, mr, zero))
    total = benign + malicious
    return cells.withColumns(
        {
            "benign_precision": bp,
            "benign_recall": br,
            "benign_f1": bf,
            "malicious_precision": mp,
            "malicious_recall": mr,
            "malicious_f1": mf,
            "accuracy": safe_divide(tn + tp, total, absent),
            "macro_f1": (bf + mf) / 2,
            "weighted_f1": safe_divide(F.coalesce(bf, F.lit(0.0)) * benign + F.coalesce(mf, F.lit(0.0)) * malicious, total, absent),
            "balanced_accuracy": (br + mr) / 2,
        }
    )


def _by_score(df: DataFrame, score: str, target: str) -> DataFrame:
    """Distinct scores with their classes' counts: tied scores stay together."""
    return df.groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(target) == 1).alias("pos"), F.count_if(F.col(target) == 0).alias("neg"))


def roc_auc(df: DataFrame, score: str, target: str = "target") -> DataFrame:
    """Area under the ROC curve, ties counted half; null if a class is absent."""
    sums = running_sums(_by_score(df, score, target), ["score"], {"neg_upto": "neg"})
    won = F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2.0)
    return sums.agg(F.try_divide(F.sum(won), F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"))


def average_precision(df: DataFrame, score: str, target: str = "target") -> DataFrame:
    """Step-wise average precision of class 1 by falling score, and of class 0 by rising score."""
    sums = running_sums(_by_score(df, score, target), ["score"], {"pos_upto": "pos", "neg_upto": "neg"})
    total = sums.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    joined = sums.crossJoin(F.broadcast(total))
    over = (F.col("p") - F.col("pos_upto") + F.col("pos")).cast("double")
    all_over = over + F.col("n") - F.col("neg_upto") + F.col("neg")
    malicious = F.sum(F.col("pos") * F.try_divide(over, all_over))
    benign = F.sum(F.col("neg") * F.try_divide(F.col("neg_upto").cast("double"), F.col("neg_upto") + F.col("pos_upto")))
    return joined.agg(F.try_divide(malicious, F.max("p")).alias("ap_malicious"), F.try_divide(benign, F.max("n")).alias("ap_benign"))


def threshold_curve(df: DataFrame, score: str, target: str = "target") -> DataFrame:
    """Confusion and scores at every threshold: distinct scores, 0, 0.5 and 1. A score up to the
    threshold is benign."""
    spark = df.sparkSession
    fixed = spark.createDataFrame([(0.0, 0, 0), (0.5, 0, 0), (1.0, 0, 0)], "score double, pos long, neg long")
    each = _by_score(df, score, target).unionByName(fixed).groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    sums = running_sums(each, ["score"], {"fn": "pos", "tn": "neg"})
    total = sums.agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    cells = sums.crossJoin(F.broadcast(total)).select(F.col("score").alias("threshold"), "tn", (F.col("_n") - F.col("tn")).alias("fp"), "fn", (F.col("_p") - F.col("fn")).alias("tp"))
    return class_metrics(cells)


def best_threshold(curve: DataFrame) -> DataFrame:
    """The threshold of greatest macro F1, then nearest to 0.5, then least."""
    return curve.orderBy(F.round("macro_f1", 12).desc(), F.abs(F.col("threshold") - 0.5), "threshold").limit(1)


def cross_entropy(df: DataFrame, probability: str, target: str = "target") -> DataFrame:
    p = F.when(F.col(target) == 1, F.col(probability)).otherwise(1.0 - F.col(probability))
    return df.agg(F.avg(-F.log(p)).alias("cross_entropy"))


def score_quantiles(df: DataFrame, score: str, target: str = "target", at: tuple[float, ...] = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)) -> DataFrame:
    """Exact, linearly interpolated quantiles of each class's scores, and how many differ."""
    q = quantiles(df, target, score, at)
    return q.select(target, F.col("distinct_values").alias("distinct_scores"), *[F.col("q")[k].alias(f"q{round(100 * a):03d}") for k, a in enumerate(at)])


def best_epoch(history: DataFrame) -> DataFrame:
    """The epoch of greatest macro F1, then least cross-entropy, then the first."""
    return history.orderBy(F.desc("macro_f1"), "cross_entropy", "epoch").limit(1)


def decide(df: DataFrame, probability: str, threshold: float = 0.5) -> DataFrame:
    return df.withColumn("predicted", above(probability, threshold))


def evaluate(df: DataFrame, probability: str, target: str = "target", threshold: float = 0.5) -> DataFrame:
    """One row: confusion, class metrics, AUC, average precisions and cross-entropy of frozen scores."""
    scored = decide(df, probability, threshold)
    one = class_metrics(confusion(scored, target))
    for more in (roc_auc(df, probability, target), average_precision(df, probability, target), cross_entropy(df, probability, target)):
        one = one.crossJoin(F.broadcast(more))
    return one
