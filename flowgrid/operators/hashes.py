"""Exact duplicates between partitions: groups, overlap, conflicts, lookup and a leak-free split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgrid.operators.encode import small


def hash_groups(items: DataFrame, by: str = "hash", target: str = "target", split: str = "split") -> DataFrame:
    """Counts of each hash by part (train, validation) and class. Test rows aren't read."""
    cell = lambda s, t: F.count_if((F.col(split) == s) & (F.col(target) == t))
    names = [("train_benign", "train", 0), ("train_malicious", "train", 1), ("validation_benign", "validation", 0), ("validation_malicious", "validation", 1)]
    return items.filter(F.col(split) != "test").groupBy(by).agg(*[cell(s, t).alias(n) for n, s, t in names])


def hash_groups3(items: DataFrame, by: str = "hash", target: str = "target", split: str = "split") -> DataFrame:
    """Counts of each hash in all three parts, and a bit mask of its classes."""
    return items.groupBy(by).agg(*[F.count_if(F.col(split) == s).alias(s) for s in ("train", "validation", "test")], F.bit_or(F.when(F.col(target) == 1, 2).when(F.col(target) == 0, 1)).alias("class_mask"))


def distinct_summary(groups: DataFrame) -> DataFrame:
    """Over hash_groups3(): distinct hashes, those of both classes, the largest and the duplicates."""
    size = F.col("train") + F.col("validation") + F.col("test")
    return groups.agg(
        F.count("*").alias("distinct_hashes"),
        F.count_if(F.col("class_mask") == 3).alias("mixed_label_hashes"),
        F.max(size).alias("largest_group"),
        F.coalesce(F.sum(F.when(size > 1, size)), F.lit(0)).alias("duplicated_items"),
        F.coalesce(F.sum(F.when(F.col("train") > 0, F.col("test"))), F.lit(0)).alias("test_in_train"),
    )


def seen_in_train(items: DataFrame, by: str = "hash", split: str = "split") -> DataFrame:
    """Validation items whose hash is in train (left semi join)."""
    train = items.filter(F.col(split) == "train").select(by).distinct()
    return items.filter(F.col(split) == "validation").join(train, by, "left_semi")


def novel_in_validation(items: DataFrame, by: str = "hash", split: str = "split") -> DataFrame:
    """Validation items whose hash isn't in train (left anti join)."""
    train = items.filter(F.col(split) == "train").select(by).distinct()
    return items.filter(F.col(split) == "validation").join(train, by, "left_anti")


def clean_split(items: DataFrame, by: str = "hash", split: str = "split") -> DataFrame:
    """``items`` where validation items that train has seen move to train; test stays as it is."""
    train = items.filter(F.col(split) == "train").select(F.col(by).alias("_seen")).distinct()
    moved = (F.col(split) == "validation") & F.col("_seen").isNotNull()
    return items.join(train, F.col(by) == F.col("_seen"), "left").withColumn(split, F.when(moved, "train").otherwise(F.col(split))).drop("_seen")


def overlap_stats(items: DataFrame, by: str = "hash", target: str = "target", split: str = "split") -> DataFrame:
    """Seen and unseen validation items by class, the share seen, and shared hashes."""
    g = hash_groups(items, by, target, split)
    train = (F.col("train_benign") + F.col("train_malicious")) > 0
    vb, vm = F.col("validation_benign"), F.col("validation_malicious")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return g.agg(
        total(F.when(train, vb).otherwise(0)).alias("seen_benign"),
        total(F.when(train, vm).otherwise(0)).alias("seen_malicious"),
        total(F.when(~train, vb).otherwise(0)).alias("unseen_benign"),
        total(F.when(~train, vm).otherwise(0)).alias("unseen_malicious"),
        F.count_if(train & (vb + vm > 0)).alias("shared_hashes"),
    ).withColumn("seen_fraction", F.try_divide(F.col("seen_benign") + F.col("seen_malicious"), F.col("seen_benign") + F.col("seen_malicious") + F.col("unseen_benign") + F.col("unseen_malicious")))


def leaked_hashes(items: DataFrame, by: str = "hash", split: str = "split", a: str = "train", b: str = "validation") -> DataFrame:
    """Hashes in both parts; none after clean_split()."""
    return items.filter(F.col(split) == a).select(by).intersect(items.filter(F.col(split) == b).select(by))


def conflicts(groups: DataFrame) -> DataFrame:
    """Hashes of both classes, with the errors that one label for all of a hash forces."""
    b, m = F.col("train_benign") + F.col("validation_benign"), F.col("train_malicious") + F.col("validation_malicious")
    return groups.filter((b > 0) & (m > 0)).withColumn("minimum_errors", F.least("validation_benign", "validation_malicious"))


def majority_label(groups: DataFrame) -> DataFrame:
    """The majority class of all training items; a tie is benign."""
    return groups.agg((F.sum("train_malicious") > F.sum("train_benign")).cast("int").alias("majority"))


def lookup_predict(items: DataFrame, by: str = "hash", target: str = "target", split: str = "split") -> DataFrame:
    """Validation items with the majority label of their hash in train; a tie or an unseen hash gets
    the majority of all training items."""
    g = hash_groups(items, by, target, split)
    majority = majority_label(g)
    b, m = F.col("train_benign"), F.col("train_malicious")
    table = g.filter((b + m) > 0).crossJoin(F.broadcast(majority)).select(F.col(by).alias("_hash"), F.when(b == m, F.col("majority")).otherwise((m > b).cast("int")).alias("_label"))
    joined = items.filter(F.col(split) == "validation").join(small(table), F.col(by) == F.col("_hash"), "left").crossJoin(F.broadcast(majority))
    return joined.withColumn("training_hash_found", F.col("_hash").isNotNull()).withColumn("predicted", F.coalesce("_label", "majority")).drop("_hash", "_label", "majority")


def representatives(items: DataFrame, key: str, by: str = "hash", target: str = "target", split: str = "split") -> DataFrame:
    """One training item for each hash and class: its least key, and the size of its group."""
    return items.filter(F.col(split) == "train").groupBy(target, by).agg(F.min(key).alias("representative"), F.count("*").alias("group_size"))


def error_enrich(predictions: DataFrame, index: DataFrame, groups: DataFrame, key: str, by: str = "hash") -> DataFrame:
    """Wrong predictions with what is known of the item and the counts of its hash."""
    return predictions.filter(F.col("predicted") != F.col("target")).join(index, key).join(groups, by)


def coverage(predictions: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Items that only one side has or that occur twice: all 0 if predictions cover the index."""
    p = predictions.groupBy(key).agg(F.count("*").alias("_p"))
    i = index.groupBy(key).agg(F.count("*").alias("_i"))
    j = p.join(i, key, "full_outer")
    return j.agg(F.count_if(F.col("_p").isNull()).alias("missing"), F.count_if(F.col("_i").isNull()).alias("unexpected"), F.count_if((F.col("_p") > 1) | (F.col("_i") > 1)).alias("repeated"))
