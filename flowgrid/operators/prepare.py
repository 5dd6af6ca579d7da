"""Prepared flows: columns dropped and appended, targets, classes, provenance and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgrid.functions.scalar import clean, finite, text_or_empty, to_decimal
from flowgrid.schemas import CATEGORICAL, DROPPED_FIELDS, FEATURES, PAPER_CLASSES, TARGETS


def binary_target(label: Column | str, strict: bool = True) -> Column:
    """0 or 1 for the two labels in any case; anything else fails, or is null if not strict."""
    known = F.when(clean(label) == "benign", TARGETS["benign"]).when(clean(label) == "malicious", TARGETS["malicious"])
    return known.otherwise(F.raise_error(F.concat(F.lit("unknown label: "), text_or_empty(label))).cast("int")) if strict else known


def class_map(label: Column | str, detail: Column | str, classes: dict[str, str] | None = None) -> Column:
    """Benign by the label, else the class of the exact, trimmed detailed label, else an empty string.

    A label that is neither benign nor malicious fails, whatever its detail says.
    """
    found = F.when(binary_target(label) == TARGETS["benign"], "Benign")
    for known, name in (classes or PAPER_CLASSES).items():
        found = found.when(F.trim(text_or_empty(detail)) == known, name)
    return found.otherwise("")


def require_class(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df``, or a failure if no row has the class ``name``."""
    if df.filter(F.col(column) == name).isEmpty():
        raise ValueError(f"no row of class {name}")
    return df


def class_counts(df: DataFrame, column: str = "paper_class", detail: str = "detailed-label") -> DataFrame:
    """Rows of each class and detailed label; details without a class are marked unresolved."""
    counted = df.groupBy(F.col(column).alias("class"), F.col(f"`{detail}`").alias("detail")).agg(F.count("*").alias("n"))
    return counted.withColumn("unresolved", F.col("class") == "")


def prepare_flows(raw: DataFrame, source_file: str | Column = "source_file", source_row: str | Column = "source_row") -> DataFrame:
    """17 features as they stand, and label, details, target and provenance."""
    named = lambda c: F.col(c) if isinstance(c, str) else c
    return raw.drop(*DROPPED_FIELDS).select(
        *[F.col(f"`{f}`") for f in FEATURES],
        clean("label").alias("label"),
        text_or_empty("`detailed-label`").alias("detailed-label"),
        F.col("label").alias("label_original"),
        binary_target("label").alias("target"),
        named(source_file).alias("source_file"),
        named(source_row).cast("long").alias("source_row"),
    )


def check_times(df: DataFrame, ts: str = "ts") -> DataFrame:
    """``df``, failing on the first time that is no finite number."""
    return df.withColumn(ts, F.when(finite(F.col(ts).try_cast("double")), F.col(ts)).otherwise(F.raise_error(F.concat(F.lit("invalid time: "), F.coalesce(F.col(ts), F.lit("null")))).cast("string")))


def sort_flows(df: DataFrame, ts: str = "ts", source_row: str = "source_row") -> DataFrame:
    """The total order: numeric time, then source row. A range-partitioned, spilling sort."""
    return df.sort(F.col(ts).cast("double"), F.col(source_row))


def pilot_sort(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Stable order by exact decimal time within each file."""
    return df.sort("source_file", to_decimal(ts), "source_row")


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that aren't unique; empty in sound data."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def type_features(df: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Numeric features as doubles, markers of missing values as nulls everywhere."""
    from flowgrid.functions.scalar import is_missing, to_number

    kept = [c for c in df.columns if c not in FEATURES]
    wanted = features or FEATURES
    typed = [F.when(~is_missing(f"`{f}`"), F.col(f"`{f}`") if f in CATEGORICAL else to_number(f"`{f}`")).alias(f) for f in wanted]
    return df.select(*typed, *[F.col(f"`{c}`") for c in kept])


def union_blocks(blocks: list[DataFrame], source: str | None = None) -> DataFrame:
    """All rows of blocks of one schema; with ``source``, fails if a source is in two blocks."""
    first = blocks[0]
    for b in blocks[1:]:
        if set(b.columns) != set(first.columns):
            raise ValueError(f"columns differ: {sorted(set(b.columns) ^ set(first.columns))}")
    if source:
        seen = None
        for b in blocks:
            own = b.select(source).distinct()
            if seen is not None and not own.join(seen, source, "left_semi").isEmpty():
                raise ValueError("a source is present already")
            seen = own if seen is None else seen.unionByName(own)
    out = first
    for b in blocks[1:]:
        out = out.unionByName(b)
    return out


def reconcile(a: DataFrame, b: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """Keys whose measures differ between two aggregates, or that one of them lacks."""
    joined = a.select(key, *[F.col(m).alias(f"{m}_a") for m in measures]).join(b.select(key, *[F.col(m).alias(f"{m}_b") for m in measures]), key, "full_outer")
    differs = F.lit(False)
    for m in measures:
        differs = differs | ~F.col(f"{m}_a").eqNullSafe(F.col(f"{m}_b"))
    return joined.filter(differs)
