"""Total order, dense indices and running sums without a one-partition window."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowgrid.sources.scratch import stable

_LOW = (1 << 33) - 1


def _ranged(df: DataFrame, keys: list[Column | str]) -> DataFrame:
    """Sorted ranges, checkpointed: their bounds come from a sample, so they are fixed once. Column
    _part numbers them and _at their rows."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    return stable(ranged.withColumns({"_part": F.shiftright("_id", 33).cast("int"), "_at": F.col("_id").bitwiseAND(F.lit(_LOW))}).drop("_id"))


def _with_offsets(ranged: DataFrame, sums: list[tuple], names: list[str]) -> DataFrame:
    """``ranged`` with, under each name, what the ranges before a row's own add up to: a row a range is
    broadcast, so plans don't grow with the ranges. ``sums`` has (number, sums...) of each range."""
    rows, before = [], [0] * len(names)
    for part, *own in sorted(sums):
        rows.append((part, *before))
        before = [b + (v or 0) for b, v in zip(before, own, strict=True)]
    kinds = ["double" if isinstance(b, float) else "decimal(38,6)" if isinstance(b, Decimal) else "long" for b in before]
    schema = ", ".join(["_of int", *[f"{n} {k}" for n, k in zip(names, kinds, strict=True)]])
    cast = {"double": float, "long": int, "decimal(38,6)": Decimal}
    rows = [(p, *[cast[k](v) for k, v in zip(kinds, values, strict=True)]) for p, *values in rows]
    offsets = ranged.sparkSession.createDataFrame(rows, schema)
    return ranged.join(F.broadcast(offsets), F.col("_part") == F.col("_of")).drop("_of")


def ordered_index(df: DataFrame, keys: list[Column | str], name: str = "row_idx") -> tuple[DataFrame, int]:
    """``df`` with a dense index from 0 in the order of ``keys``, and its number of rows.

    One range shuffle; only one count for each range comes to the driver.
    """
    ranged = _ranged(df, keys)
    counts = [(r["_part"], r["count"]) for r in ranged.groupBy("_part").count().collect()]
    placed = _with_offsets(ranged, counts, ["_before"])
    return placed.withColumn("_index", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before").withColumnRenamed("_index", name), sum(c for _, c in counts)


def running_sums(df: DataFrame, keys: list[Column | str], columns: dict[str, str]) -> DataFrame:
    """``df`` with, for each new name, the sum of a column over all rows up to this one."""
    ranged = _ranged(df, keys)
    sums = [tuple(r) for r in ranged.groupBy("_part").agg(*[F.sum(c).alias(f"_s{k}") for k, c in enumerate(columns.values())]).collect()]
    names = [f"_b{k}" for k in range(len(columns))]
    upto = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = {new: F.sum(c).over(upto) + F.col(b) for (new, c), b in zip(columns.items(), names, strict=True)}
    return _with_offsets(ranged, sums, names).withColumns(added).drop("_part", "_at", *names)


def stratified_index(df: DataFrame, stratum: str, keys: list[Column | str], name: str = "position") -> DataFrame:
    """Dense index from 0 within each stratum. Strata may be few and large: the order is global and
    a stratum's start is taken off."""
    indexed, _ = ordered_index(df, [stratum, *keys], "_global")
    starts = indexed.groupBy(stratum).agg(F.min("_global").alias("_start"))
    return indexed.join(F.broadcast(starts) if starts.count() <= 10_000 else starts, stratum).withColumn(name, F.col("_global") - F.col("_start")).drop("_global", "_start")


def quantiles(df: DataFrame, group: str, value: str, at: tuple[float, ...]) -> DataFrame:
    """(group, distinct_values, q): exact, linearly interpolated quantiles of each group's values."""
    return quantiles_of_counts(df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_n")), group, value, at)


def quantiles_of_counts(counted: DataFrame, group: str, value: str, at: tuple[float, ...]) -> DataFrame:
    """The same from rows (group, value, _n).

    Counts are summed in order over ranges, so neither a group nor its distinct values meet in one
    task. Groups are few: they are broadcast up to 10,000 rows.
    """
    summed = running_sums(counted, [group, value], {"_upto": "_n"})
    sizes = summed.groupBy(group).agg(F.min(F.col("_upto") - F.col("_n")).alias("_start"), F.sum("_n").alias("_size"), F.count("*").alias("distinct_values"))
    places = sizes.select(F.col(group).alias("_group"), "_start", "distinct_values", "_size", F.posexplode(F.array(*[F.lit(float(a)) for a in at])).alias("_k", "_a"))
    places = places.withColumn("_pos", F.col("_a") * (F.col("_size") - 1)).withColumns({"_lo": F.floor("_pos"), "_hi": F.ceil("_pos")})
    places = F.broadcast(places) if places.count() <= 10_000 else places
    held = summed.join(places, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_start") + F.col("_hi") >= F.col("_upto") - F.col("_n")) & (F.col("_start") + F.col("_lo") < F.col("_upto")))
    low, high = F.min(value), F.max(value)
    found = F.when(F.max("_lo") == F.max("_hi"), low.cast("double")).otherwise((F.max("_hi") - F.max("_pos")) * low + (F.max("_pos") - F.max("_lo")) * high)
    each = held.groupBy(group, "_k", "distinct_values").agg(found.alias("_q"))
    return each.groupBy(group, "distinct_values").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_q"))), lambda x: x["_q"]).alias("q"))


def order_report(df: DataFrame, key: str, order: list[Column | str], by: str | None = None) -> DataFrame:
    """How often ``key`` steps back or stays equal from one row to the next, by source.

    Rows are compared within sorted ranges; a range's first row meets the last one of the range
    before, of which there is one row for each range.
    """
    source = F.col(by) if by else F.lit(0)
    ranged = _ranged(df.withColumns({"_by": source, "_key": F.col(key)}), ["_by", *order])
    last = ranged.groupBy("_part").agg(F.max_by(F.struct("_by", "_key"), "_at").alias("_last"))
    last = last.withColumn("_last", F.struct(F.col("_last")["_by"].alias("_by"), F.col("_last")["_key"].alias("_key")))
    earlier = last.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_edge"))  # one row a range
    w = Window.partitionBy("_part").orderBy("_at")
    met = ranged.join(F.broadcast(earlier), "_part").withColumn("_before", F.coalesce(F.lag(F.struct("_by", "_key")).over(w), F.col("_edge")))
    same = F.col("_before").isNotNull() & F.col("_before")["_by"].eqNullSafe(F.col("_by"))
    counts = [F.count_if(same & (F.col("_key") < F.col("_before")["_key"])).alias("backward_steps"), F.count_if(same & (F.col("_key") == F.col("_before")["_key"])).alias("equal_steps")]
    return met.groupBy(*([by] if by else [])).agg(*counts)


def equal_pairs(df: DataFrame, key: str) -> DataFrame:
    """Neighbours of equal key in sorted order: a key of n rows has n - 1. No sort is needed."""
    return df.groupBy(key).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("equal_pairs"))


def order_violations(df: DataFrame, index: str, keys: list[str]) -> DataFrame:
    """Rows of a dense index whose keys aren't above those of the row before; none in a sorted set."""
    before = df.select((F.col(index) + 1).alias(index), F.struct(*keys).alias("_before"))
    return df.join(before, index).filter(F.struct(*keys) <= F.col("_before")).drop("_before")
