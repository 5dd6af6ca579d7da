"""Profiles of columns, labels, files and schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from flowgrid.functions.scalar import clean, finite, is_empty_set, is_missing, safe_divide, to_number
from flowgrid.schemas import BENIGN_TOKENS, LABEL_CANDIDATES


def label_counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    """Count, share and binary guess of each normalised label; blank ones are unlabelled."""
    n = df.groupBy(F.coalesce(clean(label), F.lit("")).alias("label")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("_all"))
    guess = F.when(F.col("label") == "", "unlabelled").when(F.col("label").isin(BENIGN_TOKENS), "benign").otherwise("malicious")
    return n.crossJoin(F.broadcast(total)).select("label", "n", (F.col("n") / F.col("_all")).alias("fraction"), guess.alias("guess"))


def label_shares(counts: DataFrame, by: str) -> DataFrame:
    """The same from counts (by, label, n) of labels as they stand, within each value of ``by``."""
    n = counts.groupBy(by, F.coalesce(clean("label"), F.lit("")).alias("label")).agg(F.sum("n").alias("n"))
    total = n.groupBy(F.col(by).alias("_by")).agg(F.sum("n").alias("_all"))
    guess = F.when(F.col("label") == "", "unlabelled").when(F.col("label").isin(BENIGN_TOKENS), "benign").otherwise("malicious")
    return n.join(total, F.col(by) == F.col("_by")).select(by, "label", "n", (F.col("n") / F.col("_all")).alias("fraction"), guess.alias("guess"))


def _unpivot(aggregated: DataFrame, columns: list[str], measures: list[str]) -> DataFrame:
    """One wide row to one row a column."""
    one = lambda k, c: F.struct(F.lit(c).alias("column"), *[F.col(f"{m}_{k}").alias(m) for m in measures])
    return aggregated.select(F.explode(F.array(*[one(k, c) for k, c in enumerate(columns)])).alias("x")).select("x.*")


def _is_number(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, NumericType)


def missing_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing markers, empty-set markers and constancy of text columns, in one pass."""
    aggs = []
    for k, c in enumerate(columns):
        q = F.col(f"`{c}`")
        if _is_number(df, c):  # numbers aren't spelt out to look for markers
            aggs += [F.count_if(q.isNull() | F.isnan(q.cast("double"))).alias(f"missing_{k}"), F.lit(0).cast("long").alias(f"empty_sets_{k}"), F.coalesce(F.min(q) == F.max(q), F.lit(True)).alias(f"constant_{k}")]
            continue
        aggs += [F.count_if(is_missing(q)).alias(f"missing_{k}"), F.count_if(is_empty_set(q)).alias(f"empty_sets_{k}"), F.coalesce(F.min(q) == F.max(q), F.lit(True)).alias(f"constant_{k}")]
    return _unpivot(df.agg(*aggs), columns, ["missing", "empty_sets", "constant"])


def constant_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    aggs = [(F.coalesce(F.min(f"`{c}`") == F.max(f"`{c}`"), F.lit(True)) & (F.count_if(F.col(f"`{c}`").isNull()).isin(0, F.count("*")))).alias(f"constant_{k}") for k, c in enumerate(columns)]
    return _unpivot(df.agg(*aggs), columns, ["constant"])


def column_profile(df: DataFrame, columns: list[str], threshold: float = 0.999) -> DataFrame:
    """Rows, missing, numeric and non-numeric values, range and likely type of each column."""
    aggs = []
    for k, c in enumerate(columns):
        if _is_number(df, c):
            number = F.col(f"`{c}`").cast("double")
            gone = number.isNull() | F.isnan(number)
            number = F.when(finite(number), number)
        else:
            text = F.col(f"`{c}`").cast("string")
            gone, number = is_missing(text), to_number(text)
        aggs += [
            F.count("*").alias(f"rows_seen_{k}"),
            F.count_if(gone).alias(f"missing_{k}"),
            F.count_if(~gone & number.isNotNull()).alias(f"numeric_{k}"),
            F.count_if(~gone & number.isNull()).alias(f"not_numeric_{k}"),
            F.min(F.when(~gone, number)).alias(f"least_{k}"),
            F.max(F.when(~gone, number)).alias(f"greatest_{k}"),
        ]
    wide = _unpivot(df.agg(*aggs), columns, ["rows_seen", "missing", "numeric", "not_numeric", "least", "greatest"])
    share = safe_divide(F.col("numeric"), F.col("numeric") + F.col("not_numeric"))
    return wide.withColumns({"numeric_fraction": share, "likely_numeric": share >= threshold})


def bounds(df: DataFrame, ts: str, by: str | None = None) -> DataFrame:
    """Least and greatest finite time, and how many aren't."""
    t = F.col(ts).try_cast("double") if dict(df.dtypes)[ts] == "string" else F.col(ts).cast("double")
    return df.groupBy(*([by] if by else [])).agg(F.min(F.when(finite(t), t)).alias("ts_min"), F.max(F.when(finite(t), t)).alias("ts_max"), F.count_if(~finite(t)).alias("ts_invalid"))


def find_label_column(columns: list[str]) -> str | None:
    """The best-ranked column: candidates in their order by exact name, then in any case and without
    white space around; of columns that are alike but for that, the last."""
    exact = {c: k for k, c in reversed(list(enumerate(LABEL_CANDIDATES)))}
    loose = {c.lower(): len(exact) + k for k, c in reversed(list(enumerate(LABEL_CANDIDATES)))}
    ranked = [(min(exact.get(c, 2 * len(exact)), loose.get(c.strip().lower(), 2 * len(exact))), -at, c) for at, c in enumerate(columns)]
    rank, _, name = min(ranked, default=(2 * len(exact), 0, None))
    return name if rank < 2 * len(exact) else None


def schema_inventory(files: DataFrame, columns: str = "columns") -> DataFrame:
    """How many files have each ordered list of columns, their rows, and the first of them. Takes
    (file, columns, rows)."""
    return files.groupBy(F.concat_ws("|", columns).alias("columns"), F.size(columns).alias("column_count")).agg(F.count("*").alias("files"), F.sum("rows").alias("rows"), F.min("file").alias("example_file"))
