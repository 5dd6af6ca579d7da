"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is what ``spark.checkpoint.dir`` names. Only where that is unset and the master is this
    machine, as in tests, a temporary folder is made, once a session, and set as checkpoint folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        base = named
    else:
        base = spark.conf.get("flowgrid.scratch.dir", None)
        if not base and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="flowgrid-")
            spark.conf.set("flowgrid.scratch.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    # Whole texts go to Python in batches bounded by bytes, unless the session bounds them itself.
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, "8MB")
    return base


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for a table that cuts lineage."""
    return f"{shared_dir(spark).rstrip('/')}/flowgrid/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, reduced: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later jobs reuse the rows and a
    lost executor costs no recomputation of what stands before.

    ``reduced``: the rows are what an aggregation or a selective join has left; an eighth as many
    tasks as shuffles have partitions write them, so that small tables are not many tiny files.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if reduced:
        df = df.coalesce(max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.scratch_path = path
    return written


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``materialise`` that nothing reads any more; a collection lets go of the
    shuffle files of finished steps."""
    for table in tables:
        drop_path(table.sparkSession, table.scratch_path)
    gc.collect()
    if spark := SparkSession.getActiveSession():
        spark.sparkContext._jvm.System.gc()


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch table through Hadoop's file system, wherever it lies."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Bits of the filter that ``only_with`` broadcasts: 1 MB at any size of the input.
FILTER_BITS = 1 << 23


def only_with(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be among those of ``wanted``, and perhaps some others, so
    that rows which a join would drop aren't shuffled for it. Null keys go.

    A hash filter of one bit a slot is broadcast; its size is fixed. It lets all rows through where
    ``wanted`` has many more keys than bits, and never holds back one that is wanted.
    """
    bits = f"pmod(xxhash64({{}}), {FILTER_BITS}L)"
    words = wanted.select(F.expr(bits.format(f"`{key}`")).alias("s")).selectExpr("shiftright(s, 6) as id", "shiftleft(1L, cast(s & 63 as int)) as bit").groupBy("id").agg(F.bit_or("bit").alias("w"))
    every = df.sparkSession.range(FILTER_BITS // 64).join(words, "id", "left").selectExpr("id", "coalesce(w, 0L) as w")
    every = every.agg(F.expr("transform(array_sort(collect_list(struct(id, w))), x -> x.w)").alias("_words"))
    kept = df.filter(df[key].isNotNull()).withColumn("_slot", F.expr(bits.format(f"`{key}`"))).crossJoin(F.broadcast(every))
    return kept.filter("shiftright(get(_words, cast(shiftright(_slot, 6) as int)), cast(_slot & 63 as int)) & 1L = 1").drop("_words", "_slot")
