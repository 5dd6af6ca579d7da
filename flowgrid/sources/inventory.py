"""Audits and inventories of folders of delimited files of any schema, all files in one scan."""

from __future__ import annotations

import csv
import hashlib
import io
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgrid.functions.scalar import is_empty_set, is_missing, safe_divide, to_number
from flowgrid.operators.encode import small
from flowgrid.operators.ordering import order_report
from flowgrid.operators.profile import find_label_column
from flowgrid.schemas import MERGED_HEADERS
from flowgrid.sources.flows import GLOB
from flowgrid.sources.records import checked_cells, only, read_records
from flowgrid.sources.scratch import scratch_path, stable

#: Labels of one file that a task counts before it hands them on.
LABELS_HELD = 100_000


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


@dataclass
class Audit:
    """Tables of an audit: a row a file, a row a file and column, a row a file, label column and label."""

    files: DataFrame
    columns: DataFrame
    labels: DataFrame


def _words(x: Column) -> Column:
    return F.split(_strip(x), r"\s+")


def _fields(header: Column | str) -> Column:
    """The fields of each of a header's cells: one, or those of a known merged cell."""
    merged = lambda c: F.array_join(_words(c), " ").isin([" ".join(n) for n in MERGED_HEADERS])
    return F.transform(header, lambda c: F.when(merged(c), _words(c)).otherwise(F.array(_strip(c))))


def _cells_by_name(records: DataFrame) -> DataFrame:
    """(file, record, row, position, width, column, value, wrong): every cell of every record under its
    own file's header. A cell under a merged header is split into its fields. Records that don't go
    with the header have one row with ``wrong`` and no column."""
    headers = only(records, F.col("record") == 0).select(F.col("file").alias("_file"), _fields("cells").alias("groups"))
    rows = only(records, F.col("record") > 0).join(small(headers), F.col("file") == F.col("_file"))
    parts = F.zip_with("cells", "groups", lambda v, g: F.when(F.size(g) > 1, _words(v)).otherwise(F.array(_strip(v))))
    sound = (F.size("cells") == F.size("groups")) & F.forall(F.zip_with("parts", "groups", lambda v, g: F.size(v) == F.size(g)), lambda x: x)
    rows = rows.withColumn("parts", parts).withColumn("wrong", ~F.coalesce(sound, F.lit(False)))
    named = F.arrays_zip(F.flatten("groups").alias("column"), F.flatten("parts").alias("value"))
    none = F.array(F.struct(F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("value")))
    each = rows.select("file", "record", "row", F.size("groups").alias("width"), "wrong", F.posexplode(F.when(F.col("wrong"), none).otherwise(named)).alias("position", "x"))
    return each.select("file", "record", "row", "position", "width", "wrong", F.col("x.column").alias("column"), F.col("x.value").alias("value"))


def audit_files(spark: SparkSession, folder: str, limit: int | None = None, recursive: bool = False, glob: str | None = GLOB) -> Audit:
    """Profiles of delimited files of any headers below a folder, read as one table of cells.

    Of each file's rows, or its first ``limit`` ones by position: status (complete_file,
    sampled_prefix, error, empty), rows, columns in their order, the merged ones among them, times of
    column ``ts``: least and greatest as they are written, of equal ones the first, how many are no
    finite numbers and how often they step back in the file's order. Of each column: missing markers,
    empty sets and constancy; of each column whose name holds ``label``: every label's rows, in its own
    case. A record that doesn't go with its header makes its file an error and isn't counted.

    Files without a byte aren't listed, those of a header alone are ``empty``. One scan counts cells by file and column, label columns by value too; another one of times alone
    is sorted for their steps.
    """
    records = read_records(spark, folder, glob, recursive)
    cells = _cells_by_name(records)
    kept = cells.filter(F.col("row") <= limit) if limit else cells
    value, number = F.col("value"), to_number("value")
    is_label = F.contains(F.lower("column"), F.lit("label"))
    is_time = F.col("column") == "ts"
    time = F.when(is_time & number.isNotNull(), F.struct(number.alias("t"), F.col("record").alias("r"), value.alias("text")))
    last = F.when(is_time & number.isNotNull(), F.struct(number.alias("t"), (-F.col("record")).alias("r"), value.alias("text")))
    counted = kept.groupBy("file", "position", "column", "width", F.when(is_label, value).alias("label")).agg(
        F.count_if(~F.col("wrong")).alias("rows"),
        F.count_if("wrong").alias("wrong_rows"),
        F.min(F.when(F.col("wrong"), F.col("record"))).alias("first_wrong"),
        F.count_if(~F.col("wrong") & is_missing(value)).alias("missing"),
        F.count_if(is_empty_set(value)).alias("empty_sets"),
        F.min(value).alias("lo"),
        F.max(value).alias("hi"),
        F.min(time).alias("t_min"),
        F.max(last).alias("t_max"),
        F.count_if(is_time & number.isNull()).alias("t_invalid"),
    )
    counted = stable(counted)  # a row a file, column and label
    columns = counted.filter("column is not null").groupBy("file", "position", "column").agg(F.sum("rows").alias("rows"), F.sum("missing").alias("missing"), F.sum("empty_sets").alias("empty_sets"), (F.min("lo") == F.max("hi")).alias("constant"))
    labels = counted.filter(F.col("label").isNotNull()).select("file", "column", "label", F.col("rows").alias("n"))
    one = counted.groupBy("file", "position", "column", "width").agg(
        *[F.sum(c).alias(c) for c in ("rows", "wrong_rows", "t_invalid")], F.min("first_wrong").alias("first_wrong"), F.min("t_min").alias("t_min"), F.max("t_max").alias("t_max")
    )
    found = one.groupBy("file").agg(
        F.coalesce(F.max("rows"), F.lit(0)).alias("rows"),
        F.sum("wrong_rows").alias("wrong_rows"),
        F.min("first_wrong").alias("first_wrong_record"),
        F.max(F.col("column") == "ts").alias("ts_present"),
        F.min("t_min")["text"].alias("ts_min"),
        F.max("t_max")["text"].alias("ts_max"),
        F.sum("t_invalid").alias("ts_invalid"),
    )
    steps = order_report(kept.filter(is_time & number.isNotNull()).select("file", "record", number.alias("t")), "t", ["record"], "file")
    sizes = records.groupBy("file").agg(F.max("row").alias("_all"), F.max(F.when(F.col("record") == 0, F.size("cells"))).alias("original_columns"), F.max(F.when(F.col("record") == 0, F.col("cells"))).alias("_header"))
    files = sizes.join(found, "file", "left").join(steps.select("file", "backward_steps"), "file", "left")
    status = F.when(F.col("_all") == 0, "empty").when(F.col("wrong_rows") > 0, "error")
    status = (status.when(F.col("_all") > limit, "sampled_prefix") if limit else status).otherwise("complete_file")
    files = files.withColumn("columns", F.flatten(_fields("_header"))).select(
        "file", status.alias("status"), F.coalesce("rows", F.lit(0)).alias("rows"), "original_columns", F.size("columns").alias("parsed_columns"), "columns", "wrong_rows", "first_wrong_record",
        F.array_contains("columns", "ts").alias("ts_present"), "ts_min", "ts_max", "ts_invalid", F.coalesce("backward_steps", F.lit(0)).alias("backward_steps"),
    )
    return Audit(files, columns, labels)


def column_profiles(spark: SparkSession, folder: str, threshold: float = 0.999, recursive: bool = True, glob: str | None = GLOB) -> DataFrame:
    """(schema, position, column, rows_seen, missing, numeric, not_numeric, non_finite, least, greatest,
    numeric_fraction, likely_numeric): the cells of all files of one header together, in one scan. The
    schema is the header's columns, joined by ``|``. Infinities are non-finite and no numbers."""
    records = read_records(spark, folder, glob, recursive)
    headers = only(records, F.col("record") == 0).select(F.col("file").alias("_file"), F.transform("cells", _strip).alias("names"))
    rows = only(records, F.col("record") > 0).join(small(headers), F.col("file") == F.col("_file"))
    each = rows.select(F.array_join("names", "|").alias("schema"), F.posexplode(F.arrays_zip(F.col("names").alias("column"), checked_cells(F.col("cells"), F.size("names")).alias("value"))).alias("position", "x")).select("schema", "position", "x.*")
    gone, number = is_missing("value"), to_number("value")
    infinite = F.coalesce(F.lower(_strip(F.col("value"))).rlike("^[+-]?inf(inity)?$"), F.lit(False))
    found = each.groupBy("schema", "position", "column").agg(
        F.count("*").alias("rows_seen"),
        F.count_if(gone).alias("missing"),
        F.count_if(~gone & number.isNotNull()).alias("numeric"),
        F.count_if(~gone & number.isNull()).alias("not_numeric"),
        F.count_if(infinite).alias("non_finite"),
        F.min(F.when(~gone, number)).alias("least"),
        F.max(F.when(~gone, number)).alias("greatest"),
    )
    share = safe_divide(F.col("numeric"), F.col("numeric") + F.col("not_numeric"))
    return found.withColumns({"numeric_fraction": share, "likely_numeric": share >= threshold})


@dataclass
class _File:
    """A file as its lines come: its digest, and its records as far as they are whole."""

    path: str
    size: int
    label: str | None
    #: Spark's reader takes a byte-order mark away, which only the number of bytes tells at the end.
    digest: object = field(default_factory=hashlib.sha256)
    marked: object = field(default_factory=lambda: hashlib.sha256(b"\xef\xbb\xbf"))
    read: int = 0
    columns: list[str] | None = None
    at: int | None = None
    rows: int = 0
    open: list[bytes] = field(default_factory=list)
    odd: int = 0
    labels: Counter = field(default_factory=Counter)

    def add(self, lines: list[bytes]) -> None:
        text = b"\n".join(lines)
        text = b"\n" + text if self.read else text  # the line feed before this line
        self.read += len(text)
        self.digest.update(text)
        self.marked.update(text)
        for line in lines:
            if not self.open and b'"' not in line:
                self._record(line.rstrip(b"\r").decode(errors="replace").split(",") if line not in (b"", b"\r") else [])
                continue
            self.open.append(line)
            self.odd = (self.odd + line.count(b'"')) % 2
            if not self.odd:
                whole, self.open = b"\n".join(self.open).decode(errors="replace"), []
                self._record(next(csv.reader(io.StringIO(whole, newline="")), []))

    def _record(self, cells: list[str]) -> None:
        if not cells:
            return
        if self.columns is None:
            self.columns = [cells[0].lstrip("\ufeff"), *cells[1:]]
            name = self.label or find_label_column(self.columns)
            self.at = self.columns.index(name) if name in self.columns else None
            return
        self.rows += 1
        if self.at is not None:
            self.labels[cells[self.at].strip() if self.at < len(cells) else ""] += 1

    def sha256(self) -> str:
        """Of the whole file, which may end with a line feed."""
        mark, end = divmod(self.size - self.read, 3)
        if mark not in (0, 1) or end not in (0, 1):
            raise ValueError(f"{self.path} has changed while it was read")
        digest = self.marked if mark else self.digest
        digest.update(b"\n" * end)
        return digest.hexdigest()

    def counts(self) -> Iterator[tuple]:
        for label, n in self.labels.items():
            yield self.path, None, None, None, 0, label, n
        self.labels.clear()


_INVENTORY = "file string, bytes long, sha256 string, columns array<string>, rows long, label string, n long"


def file_inventory(spark: SparkSession, folder: str, label: str | None = None, glob: str = GLOB) -> tuple[DataFrame, DataFrame]:
    """Files (file, bytes, sha256, rows, columns, column_count, label_column, distinct_labels) and their
    labels (file, label, n), from one pass over each file's lines.

    A digest needs a file's bytes in their order, so a file is one task's stream, whatever its size;
    neither it nor its records are held. Files run in parallel. The label column is the one given or the
    first known name in each header; blank records don't count. Files without a byte aren't listed.
    """
    own = spark.newSession()  # files aren't split: a setting of this read alone
    own.conf.set("spark.sql.files.maxPartitionBytes", str((1 << 63) - 1))
    own.conf.set("spark.sql.files.openCostInBytes", str(1 << 40))
    lines = own.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("lineSep", "\n").text(folder)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("line"))

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "bytes", "sha256", "columns", "rows", "label", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _File | None = None

        def ended(f: _File) -> list[tuple]:
            return [(f.path, f.size, f.sha256(), f.columns, f.rows, f.columns[f.at] if f.at is not None else None, None), *f.counts()]

        for batch in batches:
            names, sizes, found = (c.to_pylist() for c in batch.columns)
            lo = 0
            while lo < len(names):
                hi = lo
                while hi < len(names) and names[hi] == names[lo]:
                    hi += 1
                if now is None or now.path != names[lo]:
                    if now:
                        yield table(ended(now))
                    now = _File(names[lo], sizes[lo], label)
                now.add(found[lo:hi])
                if len(now.labels) > LABELS_HELD and (rows := list(now.counts())):
                    yield table(rows)
                lo = hi
        if now:
            yield table(ended(now))

    each = lines.mapInArrow(run, _INVENTORY)
    path = scratch_path(spark, "inventory")
    each.write.parquet(path)
    each = spark.read.schema(each.schema).parquet(path)
    counts = each.filter("sha256 is null").groupBy("file", "label").agg(F.sum("n").alias("n"))
    files = each.filter("sha256 is not null").select("file", "bytes", "sha256", "columns", "rows", F.col("label").alias("label_column"))
    distinct = counts.groupBy(F.col("file").alias("_of")).agg(F.count("*").alias("distinct_labels"))
    files = files.join(distinct, F.col("file") == F.col("_of"), "left")
    files = files.select("file", "bytes", "sha256", "rows", "columns", F.coalesce(F.size("columns"), F.lit(0)).alias("column_count"), "label_column", F.coalesce("distinct_labels", F.lit(0)).alias("distinct_labels"))
    return files, counts
