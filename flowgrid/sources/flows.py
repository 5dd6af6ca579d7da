"""Strict readers of delimited connection logs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgrid.operators.encode import small
from flowgrid.schemas import LABEL_FIELDS, RAW_FIELDS, RENAMED
from flowgrid.sources.records import checked_cells, first_record, only, read_records

#: Files of a folder that count: those ending in .csv in any case.
GLOB = "*.[cC][sS][vV]"


def discover(spark: SparkSession, folder: str, recursive: bool = False) -> list[str]:
    """Paths of the CSV files below a folder, sorted; the ending counts in any case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", GLOB).load(folder)
    return sorted(r["path"] for r in files.select("path").collect())


def header_cells(spark: SparkSession, path: str) -> list[str]:
    """The header's cells, without a byte-order mark."""
    return first_record(spark, path)


def parse_header(cells: list[str], expected: list[str] | None = None) -> list[list[str]]:
    """The fields that each cell holds: one, or several that white space separates.

    Old names become new ones. Blank, repeated, missing and extra fields fail, by name.
    """
    groups = [[RENAMED.get(n, n) for n in c.split()] for c in cells]
    names = [n for g in groups for n in g]
    if any(not g for g in groups):
        raise ValueError("a header cell is blank")
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"fields occur twice: {twice}")
    wanted = set(expected or RAW_FIELDS + LABEL_FIELDS)
    missing, extra = sorted(wanted - set(names)), sorted(set(names) - wanted)
    if missing or extra:
        raise ValueError(f"missing fields: {missing}; extra fields: {extra}")
    return groups


def _projection(groups: list[list[str]], cells: Column) -> list[Column]:
    out = []
    for k, g in enumerate(groups):
        c = cells[k]
        if len(g) == 1:
            out.append(c.alias(g[0]))
            continue
        parts = F.split(F.regexp_replace(c, r"^\s+|\s+$", ""), r"\s+")
        sound = F.when(F.size(parts) == len(g), parts).otherwise(F.raise_error(F.concat(F.lit("a merged cell doesn't hold its fields: "), c)).cast("array<string>"))
        out += [sound[j].alias(n) for j, n in enumerate(g)]
    return out


def _read(spark: SparkSession, path: str, expected: list[str] | None, blank_count: bool, wanted: Column) -> DataFrame:
    groups = parse_header(header_cells(spark, path), expected)
    records = only(read_records(spark, path), wanted).withColumn("_cells", checked_cells(F.col("cells"), len(groups)))
    number = F.col("record" if blank_count else "row").alias("source_row")
    return records.select(*_projection(groups, F.col("_cells")), F.element_at(F.split("file", "/"), -1).alias("source_file"), number)


def read_flows(spark: SparkSession, path: str, expected: list[str] | None = None, blank_count: bool = True) -> DataFrame:
    """Records of one file, every value as it stands, with source_file and source_row.

    source_row counts records from 1, blank ones with them unless ``blank_count`` is off; blank
    records give no rows. A record with too few or too many cells, or a bad quote, fails.
    """
    return _read(spark, path, expected, blank_count, F.col("record") > 0)


def read_prefix(spark: SparkSession, path: str, rows: int, expected: list[str] | None = None, blank_count: bool = True) -> DataFrame:
    """The first ``rows`` records by position; blank records don't count for that. Records know their
    position, so nothing is sorted."""
    return _read(spark, path, expected, blank_count, (F.col("record") > 0) & (F.col("row") <= rows))


def read_folder(spark: SparkSession, folder: str, files: DataFrame | None = None, expected: list[str] | None = None, recursive: bool = False) -> DataFrame:
    """Records of a folder's files, or of those that ``files`` (file) names, each under its own header,
    in one scan: the expected fields in their order, source_file, and source_row, which counts the
    rows that aren't blank. Headers may order and merge the fields as they like; missing, extra and
    repeated fields and records that don't go with their header fail.
    """
    fields = expected or RAW_FIELDS + LABEL_FIELDS
    records = read_records(spark, folder, GLOB, recursive)
    if files is not None:
        records = records.join(small(files.select("file").distinct()), "file", "left_semi")
    words = lambda c: F.split(F.regexp_replace(c, r"^\s+|\s+$", ""), r"\s+")
    headers = only(records, F.col("record") == 0).select(F.col("file").alias("_file"), F.transform("cells", lambda c: F.transform(words(c), _renamed)).alias("_groups"))
    names = F.flatten("_groups")
    sound = (F.array_sort(names) == F.array_sort(F.array(*[F.lit(f) for f in fields]))) & (F.size(names) == len(fields))
    checked = F.when(sound, F.col("_groups")).otherwise(F.raise_error(F.concat(F.lit("missing, extra or repeated fields: "), F.col("_file"), F.lit(": "), F.array_join(names, ","))).cast("array<array<string>>"))
    headers = headers.select("_file", checked.alias("_groups"))
    rows = only(records, F.col("record") > 0).join(small(headers), F.col("file") == F.col("_file"))
    parts = F.zip_with(checked_cells(F.col("cells"), F.size("_groups")), "_groups", lambda v, g: F.when(F.size(g) == 1, F.array(v)).when(F.size(words(v)) == F.size(g), words(v)).otherwise(F.raise_error(F.concat(F.lit("a merged cell doesn't hold its fields: "), v)).cast("array<string>")))
    named = rows.withColumn("_values", F.map_from_arrays(names, F.flatten(parts)))
    return named.select(*[F.col("_values")[f].alias(f) for f in fields], F.element_at(F.split("file", "/"), -1).alias("source_file"), F.col("row").alias("source_row"))


def _renamed(name: Column) -> Column:
    for old, new in RENAMED.items():
        name = F.when(name == old, new).otherwise(name)
    return name


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df``, or a failure that names the columns it lacks."""
    lacks = sorted(set(columns) - set(df.columns))
    if lacks:
        raise ValueError(f"missing columns: {lacks}")
    return df


def read_table(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A report with a header, all text, that must have some columns."""
    return require(spark.read.option("header", True).csv(path), required)


def read_json(spark: SparkSession, path: str) -> dict:
    """A small JSON document, wherever Spark can read it."""
    return json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def unchanged(spark: SparkSession, path: str) -> tuple:
    """Sizes and times of the files at a path: equal before and after a run over the same data."""
    rows = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime").collect()
    return tuple(sorted((r["path"], r["length"], str(r["modificationTime"])) for r in rows))
