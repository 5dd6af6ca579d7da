"""Dictionary codes and train-fitted preprocessing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgrid.functions.scalar import min_max
from flowgrid.operators.ordering import ordered_index, quantiles_of_counts
from flowgrid.schemas import MISSING_CODE, UNKNOWN_CODE
from flowgrid.sources.scratch import stable

#: Rows of a dictionary up to which it is broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, to be broadcast if it has few enough rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def vocabulary(df: DataFrame, column: str) -> DataFrame:
    """(value, code): codes from 0 in the order of code points."""
    values = df.select(F.col(f"`{column}`").alias("value")).filter(F.col("value").isNotNull()).distinct()
    return ordered_index(values, ["value"], "code")[0]


def dict_encode(df: DataFrame, column: str, dictionary: DataFrame, out: str | None = None, strict: bool = True) -> DataFrame:
    """``df`` with the code of a column; null stays null. A value that the dictionary lacks fails,
    or is null if not strict."""
    out = out or f"{column}_code"
    d = small(dictionary.select(F.col("value").alias("_value"), F.col("code").alias("_code")))
    joined = df.join(d, F.col(f"`{column}`") == F.col("_value"), "left")
    lost = F.col(f"`{column}`").isNotNull() & F.col("_code").isNull()
    code = F.when(lost, F.raise_error(F.concat(F.lit("value without code: "), F.col(f"`{column}`"))).cast("long")).otherwise(F.col("_code")) if strict else F.col("_code")
    return joined.withColumn(out, code).drop("_value", "_code")


@dataclass
class FittedCategory:
    """Codes of the values seen in training."""

    column: str
    dictionary: DataFrame

    def transform(self, df: DataFrame, out: str | None = None) -> DataFrame:
        """Known values to their codes, unseen ones to -1, missing ones to -2."""
        encoded = dict_encode(df, self.column, self.dictionary, "_fitted", strict=False)
        code = F.when(F.col(f"`{self.column}`").isNull(), MISSING_CODE).otherwise(F.coalesce("_fitted", F.lit(UNKNOWN_CODE)))
        return encoded.withColumn(out or f"{self.column}_code", code.cast("long")).drop("_fitted")


def fit_category(df: DataFrame, column: str, fit_filter: Column) -> FittedCategory:
    return FittedCategory(column, vocabulary(df.filter(fit_filter), column))


def fit_medians(df: DataFrame, columns: list[str], fit_filter: Column) -> DataFrame:
    """(feature, median, training_missing, all_missing): exact medians of the rows to fit on.

    One scan counts each feature's values, nulls among them; medians and missing counts follow from
    the counts.
    """
    rows = df.filter(fit_filter).select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    counted = stable(rows.groupBy("feature", "v").agg(F.count("*").alias("_n")))
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    missing = counted.filter("v is null").select("feature", F.col("_n").alias("training_missing"))
    medians = quantiles_of_counts(counted.filter("v is not null"), "feature", "v", (0.5,)).select("feature", F.col("q")[0].alias("median"))
    found = every.join(missing, "feature", "left").join(medians, "feature", "left")
    return found.select("feature", F.coalesce("median", F.lit(0.0)).alias("median"), F.coalesce("training_missing", F.lit(0)).alias("training_missing"), F.col("median").isNull().alias("all_missing"))


def impute(df: DataFrame, medians: DataFrame) -> DataFrame:
    """Nulls of the fitted features become their medians. One row a feature comes to the driver."""
    of = {r["feature"]: r["median"] for r in medians.collect()}
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(m)) for c, m in of.items()})


def fit_extrema(df: DataFrame, columns: list[str], fit_filter: Column) -> DataFrame:
    """(feature, least, greatest) of the rows to fit on."""
    wide = df.filter(fit_filter).agg(*[a for k, c in enumerate(columns) for a in (F.min(f"`{c}`").cast("double").alias(f"a_{k}"), F.max(f"`{c}`").cast("double").alias(f"b_{k}"))])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"a_{k}").alias("least"), F.col(f"b_{k}").alias("greatest")) for k, c in enumerate(columns)])).alias("x")).select("x.*")


def normalise(df: DataFrame, extrema: DataFrame) -> DataFrame:
    """Fitted features onto [-1, 1]; values outside the fitted range aren't clipped."""
    of = {r["feature"]: (r["least"], r["greatest"]) for r in extrema.collect()}
    return df.withColumns({c: min_max(F.col(f"`{c}`").cast("double"), a, b) if a is not None else F.lit(0.0) for c, (a, b) in of.items()})


def out_of_range(normalised: DataFrame, columns: list[str], by: str, slack: float = 1e-10) -> DataFrame:
    """Values beyond [-1, 1] in each part."""
    outside = [F.count_if(F.abs(F.col(f"`{c}`")) > 1 + slack).alias(c) for c in columns]
    return normalised.groupBy(by).agg(*outside)


def unknown_counts(df: DataFrame, code: str, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count_if(F.col(code) == UNKNOWN_CODE).alias("unknown"), F.count_if(F.col(code) == MISSING_CODE).alias("missing"), F.count("*").alias("rows"))
