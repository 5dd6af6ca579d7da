"""Line dedup over levelled sorted runs of line hashes.

A store holds runs: tables of (line hash, first document), bucketed and sorted by hash. A new batch
is reduced to one row per hash, merge-anti-joined against every run and adds what is new as a run of
its own; when a level is full its runs are merged into one of the next level. Batches come in the
order of their documents, so the run that holds a hash names its smallest document.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowgrid.llm.bpe import slices
from flowgrid.llm.common import drop_path, materialise, scratch_path

#: Runs of one level before they are merged into the next.
FAN_OUT = 2
LEAST_CHARS = 10
_LAST = 2**63 - 1


def line_key(line: bytes) -> bytes | None:
    """Digest of a line's key, or None if the key is too short to count."""
    key = line.strip(b" \t\n\r\x0b\x0c").lower()  # of bytes: A-Z alone
    if len(key) < LEAST_CHARS or (len(key) < 4 * LEAST_CHARS and len(key.decode()) < LEAST_CHARS):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


class LineRuns:
    """The levelled store of one corpus, in bucketed tables under the shared folder."""

    def __init__(self, spark: SparkSession, buckets: int, fan_out: int = FAN_OUT) -> None:
        self.spark, self.buckets, self.fan_out = spark, buckets, fan_out
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(t) for level in self.levels for t in level]

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"flowgrid_run_{uuid.uuid4().hex}"
        path = self.paths[name] = scratch_path(self.spark, "run")
        # Dealt out by the bucket itself: whatever the number of partitions is, no two tasks hold rows of
        # one bucket, and a run has one file a bucket.
        dealt = rows.select("h", "first_doc").repartition(F.expr(f"pmod(hash(h), {self.buckets})"))
        dealt.write.bucketBy(self.buckets, "h").sortBy("h").option("path", path).format("parquet").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def add(self, firsts: DataFrame) -> None:
        """Add a batch's new hashes as a run; merge levels that are full."""
        self._write(firsts, 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fan_out:
            old = self.levels[level]
            self.levels[level] = []
            self._write(reduce(DataFrame.unionByName, [self.spark.table(t) for t in old]), level + 1)
            for t in old:
                self._drop(t)
            level += 1

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop_path(self.spark, self.paths.pop(name))

    def clear(self) -> None:
        for t in list(self.paths):
            self._drop(t)
        self.levels = []


def line_hashes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, h) for every key of every text, once a row; a null doc_id counts as the largest."""
    schema = T.StructType([T.StructField("doc", T.LongType()), T.StructField("h", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for small in slices(batch):
                ids, keys = [], []
                for doc, t in zip(small.column(0).to_pylist(), small.column(1), strict=True):
                    found = {k for k in map(line_key, (t.as_py() or "").encode().split(b"\n")) if k}
                    ids += [doc] * len(found)
                    keys += found
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], names=schema.names)

    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)), F.col(text).cast("string")).mapInArrow(run, schema)


def shared_lines(hashes: DataFrame, batches: int, buckets: int | None = None, fan_out: int = FAN_OUT) -> DataFrame:
    """(h, first_doc) of every hash that several documents hold, through the levelled runs.

    ``hashes`` has columns doc, h and batch (0 to batches - 1, in the order of doc).
    """
    spark = hashes.sparkSession
    buckets = buckets or min(max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8), 4096)
    store, found = LineRuns(spark, buckets, fan_out), []
    for b in range(batches):
        # One row per hash before anything is joined: a line that a third of all documents hold
        # is one row from here on.
        own = hashes.filter(F.col("batch") == b).groupBy("h").agg(F.min("doc").alias("first_doc"), (F.min("doc") != F.max("doc")).alias("several"))
        own = materialise(own, "batch", reduced=True)
        fresh = own
        for run in store.runs():
            seen = own.select("h").join(run.hint("merge"), "h")
            found.append(materialise(seen, "seen", reduced=True))
            fresh = fresh.join(run.select("h").hint("merge"), "h", "left_anti")
        found.append(fresh.filter("several").select("h", "first_doc"))
        if b < batches - 1:
            fresh = materialise(fresh, "fresh", reduced=True)
            found[-1] = fresh.filter("several").select("h", "first_doc")
            store.add(fresh)
        else:
            found[-1] = materialise(found[-1], "shared", reduced=True)
    store.clear()
    # A hash is seen again in each later batch that holds it; its first document is the same.
    return reduce(DataFrame.unionByName, found).groupBy("h").agg(F.min("first_doc").alias("first_doc"))


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = 4, counts: bool = True) -> DataFrame:
    """Drop the lines of every whole text whose key stands in a document with a smaller id.

    Returns the columns of ``docs`` with ``text`` changed, and ``n_lines`` and ``n_dropped``
    (columns of those names in ``docs`` are replaced; without ``counts`` all of ``docs`` stay as they
    are, and no others come). A null or empty text is one empty line; a
    null text stays null. Rows of one doc_id are one document; a null doc_id comes after all others.
    """
    names = [c for c in docs.columns if not counts or c not in ("n_lines", "n_dropped")]
    hashes = line_hashes(docs, doc_id, text)
    ids = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("doc"))
    cuts = ids.agg(F.percentile_approx("doc", F.array(*[F.lit(k / batches) for k in range(1, batches)]), 1000)).first()[0] or [] if batches > 1 else []
    batch = sum([(F.col("doc") > c).cast("int") for c in cuts], F.lit(0))
    lines = materialise(hashes.withColumn("batch", batch), "lines")
    # Written first, so that the join's sides are plain shuffles and a common line's can be split.
    shared = materialise(shared_lines(lines, batches), "shared", reduced=True)
    drops = lines.join(shared, "h").filter(F.col("doc") != F.col("first_doc")).groupBy("doc").agg(F.collect_set("h").alias("_drops"))
    given = docs.select(F.struct(F.lit(True).alias("_"), *[F.col(f"`{c}`") for c in names if c != text]).alias("_row"), F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("_doc"), F.col(text).cast("string").alias("_text"))
    joined = given.join(drops.hint("shuffle_hash"), F.col("_doc") == F.col("doc"), "left").select("_row", "_text", "_drops")
    schema = T.StructType([joined.schema["_row"], T.StructField("_new", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for small in slices(batch):
                new, total, dropped = [], [], []
                for t, drop in zip(small.column(1), small.column(2), strict=True):
                    t = t.as_py()
                    parts = (t or "").split("\n")
                    total.append(len(parts))
                    if drop.is_valid and t:
                        out = set(drop.as_py())
                        kept = [p for p in parts if line_key(p.encode()) not in out]
                        dropped.append(len(parts) - len(kept))
                        t = "\n".join(kept)
                    else:
                        dropped.append(0)
                    new.append(t)
                yield pa.RecordBatch.from_arrays([small.column(0), pa.array(new, pa.string()), pa.array(total, pa.int64()), pa.array(dropped, pa.int64())], names=schema.names)

    done = joined.mapInArrow(run, schema)
    return done.select(*[F.col("_new").alias(c) if c == text else F.col("_row")[c].alias(c) for c in names], *(["n_lines", "n_dropped"] if counts else []))
