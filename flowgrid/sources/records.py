"""Records of delimited text whose quoted cells may hold line breaks.

A file is read in blocks. Whether a line of a block starts inside quotes depends on the quotes of all
blocks before; so each block's lines are numbered for either case, streaming and in their order, the
blocks' sums are added up block by block, and then every line knows its state and its record. Only
lines that share a record are brought together.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowgrid.operators.encode import small
from flowgrid.sources.scratch import stable

_SCANNED = "file string, block long, at long, line string, inside boolean, odd boolean, blank boolean, ends0 long, ends1 long, rows0 long, rows1 long"


def _lines(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """(file, block, line): lines end at a line feed alone, a carriage return before it stays."""
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", recursive)
    return (reader.option("pathGlobFilter", glob) if glob else reader).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers a block's lines as they come. Column ``inside`` is right if the block starts outside
    quotes; ends and rows are the records, and those that aren't blank, which end before the line if
    it starts outside (0) or inside (1)."""
    now, carried = None, np.zeros(6, np.int64)  # of the block: lines, quotes, ends0, ends1, rows0, rows1
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block, line = batch.columns
        odd = pc.count_substring(line, '"').to_numpy(zero_copy_only=False).astype(np.int64) & 1
        blank = pc.is_in(line, pa.array(["", "\r"])).to_numpy(zero_copy_only=False)
        names, starts = file.dictionary_encode().indices.to_numpy(zero_copy_only=False), block.to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]) | (starts[1:] != starts[:-1])) + 1).tolist(), batch.num_rows]
        out = np.zeros((6, batch.num_rows), np.int64)
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if (own := (file[lo].as_py(), block[lo].as_py())) != now:
                now, carried = own, np.zeros(6, np.int64)
            after = (carried[1] + np.cumsum(odd[lo:hi])) & 1
            before = after ^ odd[lo:hi]
            ends = np.stack([after == 0, after == 1])
            rows = ends & ~(blank[lo:hi] & np.stack([before == 0, before == 1]))
            sums = np.cumsum(np.vstack([np.ones((1, hi - lo)), odd[None, lo:hi], ends, rows]).astype(np.int64), axis=1)
            out[:, lo:hi] = carried[:, None] + np.hstack([np.zeros((6, 1), np.int64), sums[:, :-1]])
            carried = carried + sums[:, -1]
        at, quotes, ends0, ends1, rows0, rows1 = out
        yield pa.RecordBatch.from_arrays([file, block, pa.array(at), line, pa.array((quotes & 1).astype(bool)), pa.array(odd.astype(bool)), pa.array(blank), *map(pa.array, (ends0, ends1, rows0, rows1))], names=[f.split()[0] for f in _SCANNED.split(", ")])


def _blocks(scanned: DataFrame) -> DataFrame:
    """A row a block: whether it starts inside quotes, and the records and rows in it and before it."""
    ended = F.col("inside") == F.col("odd")
    blank0, blank1 = F.col("blank") & ~F.col("inside"), F.col("blank") & F.col("inside")
    blocks = scanned.groupBy("file", "block").agg(
        F.count_if("odd").alias("_odd"), F.count_if(ended).alias("_ends0"), F.count_if(~ended).alias("_ends1"), F.count_if(ended & ~blank0).alias("_rows0"), F.count_if(~ended & ~blank1).alias("_rows1")
    )
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    before = lambda c: F.coalesce(F.sum(c).over(upto), F.lit(0))
    open_ = F.sum("_odd").over(Window.partitionBy("file")) % 2 == 1
    inside = F.when(open_, F.raise_error(F.concat(F.lit("a quote isn't closed: "), F.col("file"))).cast("boolean")).otherwise(before("_odd") % 2 == 1)
    own = lambda k: F.when(F.col("starts_inside"), F.col(f"_{k}1")).otherwise(F.col(f"_{k}0"))
    counted = blocks.withColumn("starts_inside", inside).withColumns({"records": own("ends"), "rows": own("rows")})
    return counted.select(F.col("file").alias("_file"), F.col("block").alias("_block"), "starts_inside", "records", "rows", before("records").alias("records_before"), before("rows").alias("rows_before"))


def _quoted_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells of records with quotes, by the strict rules of the csv module."""
    for batch in batches:
        cells = []
        for text in batch.column(3).to_pylist():
            try:
                found = list(csv.reader(io.StringIO(text, newline=""), strict=True))
            except csv.Error as e:
                raise ValueError(f"a record is malformed ({e}): {text[:200]}") from e
            if len(found) != 1:
                raise ValueError(f"a line break isn't inside quotes: {text[:200]}")
            cells.append(found[0])
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cells, pa.list_(pa.string()))], names=["file", "record", "row", "cells"])


def read_records(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """(file, record, row, cells): the records of a delimited file, or of a folder's, strictly read.

    ``record`` counts a file's records from 0, the header, blank ones included; ``row`` counts only
    those that aren't blank. Blank records give no rows. Quoted cells may hold delimiters, doubled
    quotes and line breaks, which stay as they are. A quote that isn't closed, one that opens inside a
    cell and stays open at the line's end, and text after a closing quote fail. A byte-order mark at a
    file's start isn't part of the first cell.

    Two scans; lines without quotes aren't shuffled.
    """
    scanned = _lines(spark, path, glob, recursive).mapInArrow(_scan, _SCANNED)
    starts = small(stable(_blocks(scanned).drop("records", "rows")))
    own = lambda k: F.when(F.col("starts_inside"), F.col(f"{k}1")).otherwise(F.col(f"{k}0"))
    placed = scanned.join(starts, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    placed = placed.select(
        "file", "block", "at", F.when((F.col("block") == 0) & (F.col("at") == 0), F.regexp_replace("line", "^﻿", "")).otherwise(F.col("line")).alias("line"),
        (F.col("records_before") + own("ends")).alias("record"), (F.col("rows_before") + own("rows")).alias("row"), (F.col("inside") != F.col("starts_inside")).alias("inside"), "odd",
    )
    # What is open at a line's end must have been opened at a cell's start: said before lines meet.
    rest = F.regexp_replace("line", '"[^"]*"', "")
    sound = F.when(~F.col("inside") & F.col("odd") & ~rest.rlike('(^|,)"[^"]*$'), F.raise_error(F.concat(F.lit("a quote stands inside a cell: "), F.col("line"))).cast("boolean")).otherwise(True)
    placed = placed.filter(sound)
    alone = ~F.col("inside") & ~F.col("odd")
    quoted = F.contains(F.col("line"), F.lit('"'))
    plain = placed.filter(alone & ~quoted).withColumn("line", F.regexp_replace("line", "\r$", "")).filter(F.col("line") != "")
    whole = F.when(F.contains(F.col("line"), F.lit("\r")), F.raise_error(F.concat(F.lit("a carriage return stands outside quotes: "), F.col("line"))).cast("string")).otherwise(F.col("line"))
    cells = plain.select("file", "record", "row", F.split(whole, ",", -1).alias("cells"))
    several = placed.filter(~alone).groupBy("file", "record", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "line"))), lambda x: x["line"]), "\n").alias("line"))
    texts = placed.filter(alone & quoted).select("file", "record", "row", "line").unionByName(several)
    return cells.unionByName(texts.mapInArrow(_quoted_cells, "file string, record long, row long, cells array<string>"))


def record_counts(spark: SparkSession, path: str) -> DataFrame:
    """(file, data_rows, blank_rows) of delimited files, without their headers: one scan."""
    blocks = _blocks(_lines(spark, path).mapInArrow(_scan, _SCANNED))
    return blocks.groupBy(F.col("_file").alias("file")).agg((F.sum("rows") - 1).alias("data_rows"), (F.sum("records") - F.sum("rows")).alias("blank_rows"))


def first_record(spark: SparkSession, path: str) -> list[str]:
    """The cells of a file's first record, without a byte-order mark. Only its first lines are read."""
    lines, n = [], 1
    while True:
        lines = [r["line"] for r in _lines(spark, path).select("line").take(n)]
        for k in range(1, len(lines) + 1):
            text = "\n".join(lines[:k]).lstrip("﻿")
            if text.count('"') % 2 == 0:
                if not text.strip("\r"):
                    raise ValueError(f"{path} has no header")
                return next(csv.reader(io.StringIO(text, newline=""), strict=True))
        if len(lines) < n:
            raise ValueError(f"{path} is empty" if not lines else f"a quote isn't closed: {path}")
        n *= 4


def only(records: DataFrame, wanted: Column) -> DataFrame:
    """The wanted records. They are generated, not filtered: checks of their cells, which may fail, are
    never tried on the others, wherever the optimiser puts them."""
    return records.select("file", "record", "row", F.explode(F.when(wanted, F.array("cells"))).alias("cells"))


def checked_cells(cells: Column, n: int | Column) -> Column:
    """``cells``, or a failure where there aren't ``n``."""
    return F.when(F.size(cells) == n, cells).otherwise(F.raise_error(F.concat(F.lit("a record has another number of cells: "), F.array_join(cells, ","))).cast("array<string>"))
