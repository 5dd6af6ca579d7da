"""Stratified splits, exact samples per class and balanced epochs, all keyed by seeded hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowgrid.functions.scalar import ordered_key
from flowgrid.operators.hashes import representatives
from flowgrid.operators.ordering import ordered_index, stratified_index


def stratified_split(items: DataFrame, key: str = "window_id", target: str = "target", seed: int = 42, fold: int = 0, folds: int = 5, test_fraction: float = 0.2) -> DataFrame:
    """Columns split and fold (-1 in the test part). Of each class a fifth, one at least and all
    but five at most, is test; the rest goes round the folds. A class needs six items."""
    n = items.groupBy(target).agg(F.count("*").alias("_n"))
    few = [r[target] for r in n.filter(F.col("_n") <= folds).limit(5).collect()]
    if few:
        raise ValueError(f"classes {few} have fewer than {folds + 1} items")
    placed = stratified_index(items.withColumn("_key", ordered_key(seed, key)), target, ["_key", key]).join(F.broadcast(n), target)
    tests = F.least(F.greatest(F.lit(1), F.ceil(F.round(F.col("_n") * test_fraction, 9))), F.col("_n") - folds)
    placed = placed.withColumn("fold", F.when(F.col("position") < tests, -1).otherwise(((F.col("position") - tests) % folds).cast("int")))
    split = F.when(F.col("fold") == -1, "test").when(F.col("fold") == fold, "validation").otherwise("train")
    return placed.withColumn("split", split).drop("_key", "_n", "position")


def sample_per_class(items: DataFrame, n: int, key: str, target: str = "target", seed: int = 42) -> DataFrame:
    """Exactly ``n`` of each class, or all if it has fewer, without replacement."""
    return stratified_index(items.withColumn("_key", ordered_key(seed, key)), target, ["_key", key]).filter(F.col("position") < n).drop("_key", "position")


def first_per_class(items: DataFrame, n: int, key: str, target: str = "target") -> DataFrame:
    return stratified_index(items, target, [key]).filter(F.col("position") < n).drop("position")


def counts_by_split(items: DataFrame, target: str = "target", split: str = "split") -> DataFrame:
    return items.groupBy(split).agg(F.count_if(F.col(target) == 0).alias("benign"), F.count_if(F.col(target) == 1).alias("malicious"))


def missing_classes(items: DataFrame, target: str = "target", split: str = "split") -> DataFrame:
    """Splits that lack a class; empty in a usable split."""
    return counts_by_split(items, target, split).filter((F.col("benign") == 0) | (F.col("malicious") == 0))


def balanced_epoch(items: DataFrame, key: str, epoch: int, target: str = "target", seed: int = 42, batch: int = 8) -> DataFrame:
    """An epoch whose every batch is half of either class: (batch_id, target, key).

    Both classes are drawn in whole shuffled cycles, the smaller one more often, cut to the length of
    the larger one filled up to whole half batches.
    """
    half = batch // 2
    sizes = {r[target]: r["n"] for r in items.groupBy(target).agg(F.count("*").alias("n")).collect()}
    if len(sizes) != 2 or batch % 2:
        raise ValueError("two classes and an even batch are needed")
    wanted = -(-max(sizes.values()) // half) * half
    cycles = F.create_map(*[F.lit(v) for t, n in sizes.items() for v in (t, -(-wanted // n))])
    drawn = items.select(key, target, F.explode(F.sequence(F.lit(0), cycles[F.col(target)] - 1)).alias("cycle"))
    drawn = drawn.withColumn("_key", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), F.col("cycle").cast("string"), F.col(key).cast("string")), 256))
    placed = stratified_index(drawn, target, ["cycle", "_key", key]).filter(F.col("position") < wanted)
    return placed.select(F.floor(F.col("position") / half).cast("long").alias("batch_id"), target, key)


def epoch_order(items: DataFrame, key: str, epoch: int, seed: int = 42) -> DataFrame:
    """``items`` with their place in the epoch's order, from 0: each once, by seed, epoch and key."""
    placed, _ = ordered_index(items.withColumn("_key", ordered_key(f"{seed}:{epoch}", key)), ["_key", key], "place")
    return placed.drop("_key")


def hash_balanced_epoch(items: DataFrame, key: str, epoch: int, by: str = "hash", target: str = "target", split: str = "split", seed: int = 42, batch: int = 8) -> DataFrame:
    """An epoch over the training part's distinct hashes: (place, batch_id, slot, target, hash, key).

    A hash stands for all its items by its least key, so one that thousands share weighs as much as
    any other. Every hash of the larger class comes once and at most once more to fill the last batch,
    the smaller class goes round in whole shuffled cycles. Each batch is half of either class, in a
    shuffled order. Hashes of both classes fail, since no representative could stand for them.
    """
    one = representatives(items, key, by, target, split)
    mixed = one.groupBy(by).agg(F.count("*").alias("n")).filter("n > 1").select(by).limit(5).collect()
    if mixed:
        raise ValueError(f"hashes of both classes in train: {[r[by] for r in mixed]}")
    named = one.select(F.col("representative").alias(key), target, by)
    drawn = balanced_epoch(named.select(key, target), key, epoch, target, seed, batch)
    mix = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), F.lit("batch"), F.col("batch_id").cast("string"), F.col(key).cast("string")), 256)
    # A batch is as many rows as ``batch`` says; equal keys are a cycle that ends and one that begins.
    slot = F.row_number().over(Window.partitionBy("batch_id").orderBy(mix, key)) - 1
    placed = drawn.withColumn("slot", slot.cast("long")).withColumn("place", F.col("batch_id") * batch + F.col("slot"))
    return placed.join(named.select(key, by), key).select("place", "batch_id", "slot", target, by, key)


def class_weights(items: DataFrame, target: str = "target") -> DataFrame:
    """N / (2 N_c) for each class."""
    n = items.groupBy(target).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(items.agg(F.count("*").alias("_all")))).select(target, (F.col("_all") / (2.0 * F.col("n"))).alias("weight"))


def split_fingerprint(items: DataFrame, key: str = "window_id", split: str = "split") -> DataFrame:
    """A digest of who is in which split; it doesn't depend on partitions or order."""
    row = F.sha2(F.concat_ws(":", F.col(key).cast("string"), F.col(split)), 256)
    return items.agg(F.count("*").alias("n"), F.bit_xor(F.conv(F.substring(row, 1, 15), 16, 10).cast("long")).alias("fingerprint"), F.sum(F.conv(F.substring(row, 16, 8), 16, 10).cast("long")).alias("checksum"))


#: What reconcile_membership() counts.
DIFFERENCES = ("only_saved", "only_recomputed", "repeated", "split_differs", "fold_differs", "target_differs", "unknown_split", "fold_against_split")


def reconcile_membership(saved: DataFrame, recomputed: DataFrame, key: str = "window_id", fold: int = 0, folds: int = 5) -> DataFrame:
    """One row of counts: how saved memberships (key, split, fold, target) differ from recomputed ones.

    Items that one side lacks or has more than once, columns that differ, nulls being equal to each
    other alone, and saved rows that break the rules: a split that isn't known, or a fold that doesn't
    go with it (-1 in test, ``fold`` in validation, any other in train). Nothing is replaced.
    """
    columns = ("split", "fold", "target")
    one = lambda df, side: df.groupBy(key).agg(F.count("*").alias(f"_n_{side}"), *[F.min(c).alias(f"{c}_{side}") for c in columns])
    both = one(saved, "s").withColumnRenamed(key, "_key").join(one(recomputed, "r"), F.col("_key").eqNullSafe(F.col(key)), "full_outer")
    there = F.col("_n_s").isNotNull()
    met = there & F.col("_n_r").isNotNull()
    split_, fold_ = F.col("split_s"), F.col("fold_s")
    right = F.when(split_ == "test", fold_ == -1).when(split_ == "validation", fold_ == fold).when(split_ == "train", (fold_ != fold) & fold_.between(0, folds - 1))
    counts = {
        "only_saved": there & F.col("_n_r").isNull(),
        "only_recomputed": ~there,
        "repeated": (F.coalesce("_n_s", F.lit(0)) > 1) | (F.coalesce("_n_r", F.lit(0)) > 1),
        **{f"{c}_differs": met & ~F.col(f"{c}_s").eqNullSafe(F.col(f"{c}_r")) for c in columns},
        "unknown_split": there & ~F.coalesce(split_.isin("train", "validation", "test"), F.lit(False)),
        "fold_against_split": there & split_.isin("train", "validation", "test") & ~F.coalesce(right, F.lit(False)),
    }
    return both.agg(*[F.count_if(counts[name]).alias(name) for name in DIFFERENCES])


def crossing_rows(rows: DataFrame, windows: DataFrame, size: int, index: str = "row_idx", key: str = "window_id") -> DataFrame:
    """One row of counts over rows (index, key, split): those that aren't in the window of their index,
    whose split isn't their window's, and windows that don't have ``size`` rows."""
    of = rows.groupBy(key).agg(F.count("*").alias("_n"), F.count_if(F.floor(F.col(index) / size) != F.col(key)).alias("_out"), F.min("split").alias("_lo"), F.max("split").alias("_hi"), F.count_if(F.col("split").isNull()).alias("_null"))
    met = of.join(windows.select(F.col(key).alias("_key"), F.col("split").alias("_split")), F.col(key) == F.col("_key"), "full_outer")
    mixed = ~(F.col("_lo").eqNullSafe(F.col("_hi")) & F.col("_lo").eqNullSafe(F.col("_split")) & (F.col("_null") == 0))
    return met.agg(F.coalesce(F.sum("_out"), F.lit(0)).alias("rows_outside"), F.count_if(mixed).alias("mixed_windows"), F.count_if(~F.coalesce(F.col("_n") == size, F.lit(False))).alias("incomplete_windows"))
