"""Images in shards that are committed one by one.

A shard holds the images of a range of keys. It is written aside, moved to its place, and then gets a
sidecar with its configuration, size and digests, whose last name marks it as complete. A run that is
killed leaves complete shards, which the next run checks and keeps, and others, which it writes again.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgrid.sources.lease import acquire
from flowgrid.sources.sinks import _delete, _path, exists

SHARD = 1000
#: Shards that one job writes; their sidecars, at most as many digests as they hold images, pass the
#: driver together.
WAVE = 256


def shard_of(key: Column | str, shard: int = SHARD) -> Column:
    return F.floor((F.col(key) if isinstance(key, str) else key) / shard).cast("long")


def _name(shard: int) -> str:
    return f"shard={shard:09d}"


def _size(spark: SparkSession, path: str) -> int:
    p, fs = _path(spark, path)
    return sum(f.getLen() for f in fs.listStatus(p) if not f.getPath().getName().startswith(("_", "."))) if fs.exists(p) else -1


def _write_json(spark: SparkSession, path: str, content: dict) -> None:
    """Under another name first; the rename is the commit."""
    part, fs = _path(spark, f"{path}.partial")
    out = fs.create(part, True)
    out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    out.close()
    fs.rename(part, _path(spark, path)[0])


def sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, start, stop, images, bytes, configuration_hash, sha256): a row for each committed shard."""
    schema = "shard long, start long, stop long, images long, bytes long, configuration_hash string, sha256 array<string>"
    if not exists(spark, f"{folder.rstrip('/')}/sidecars"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("pathGlobFilter", "*.json").json(f"{folder.rstrip('/')}/sidecars")


def completed_shards(spark: SparkSession, folder: str, configuration_hash: str) -> list[int]:
    """Shards that are committed and whose files have the size that was committed. A shard of another
    configuration fails: it isn't this run's to replace."""
    out = []
    for r in sidecars(spark, folder).select("shard", "bytes", "configuration_hash").collect():
        if r["configuration_hash"] != configuration_hash:
            raise FileExistsError(f"{folder} has shards of another configuration")
        if _size(spark, f"{folder.rstrip('/')}/data/{_name(r['shard'])}") == r["bytes"]:
            out.append(r["shard"])
    return sorted(out)


def write_shards(images: DataFrame, folder: str, configuration_hash: str, key: str = "window_id", shard: int = SHARD, wave: int = WAVE) -> dict:
    """Writes what isn't committed of (key, png) and returns how many shards were kept and written.

    A shard's images stand in one file in the order of their keys, so the same images give the same
    files. One writer has the folder at a time.
    """
    spark, folder = images.sparkSession, folder.rstrip("/")
    with acquire(spark, folder) as lease:
        done = completed_shards(spark, folder, configuration_hash)
        placed = images.select(F.col(key), "png", shard_of(key, shard).alias("_shard"))
        every = sorted(r["_shard"] for r in placed.select("_shard").distinct().collect())
        left = sorted(set(every) - set(done))
        for at in range(0, len(left), wave):
            now = left[at : at + wave]
            part = f"{folder}/_partial-{lease.number}"
            _delete(spark, part)
            rows = placed.filter(F.col("_shard").between(now[0], now[-1]) & F.col("_shard").isin(now))
            rows = rows.withColumn("shard", F.format_string("%09d", "_shard")).repartition(len(now), "shard").sortWithinPartitions("shard", key)
            rows.select("shard", key, "png").write.partitionBy("shard").parquet(part)
            written = spark.read.parquet(part).withColumn("shard", F.col("shard").cast("long"))
            facts = written.groupBy("shard").agg(F.count("*").alias("images"), F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.sha2("png", 256).alias("h")))), lambda x: x["h"]).alias("sha256")).collect()
            lease.check()
            for r in facts:
                n = r["shard"]
                _commit(spark, folder, part, n, {"shard": n, "start": n * shard, "stop": (n + 1) * shard, "images": r["images"], "configuration_hash": configuration_hash, "sha256": r["sha256"]})
            _delete(spark, part)
    return {"kept": len(done), "written": len(left)}


def _commit(spark: SparkSession, folder: str, part: str, shard: int, facts: dict) -> None:
    """What stands in the shard's place is of a run that died, or isn't what its sidecar says."""
    place = f"{folder}/data/{_name(shard)}"
    sidecar = f"{folder}/sidecars/{_name(shard)}.json"
    _delete(spark, sidecar)
    _delete(spark, place)
    source, fs = _path(spark, f"{part}/{_name(shard)}")
    target, _ = _path(spark, place)
    fs.mkdirs(target.getParent())
    fs.mkdirs(_path(spark, f"{folder}/sidecars")[0])
    if not fs.rename(source, target):
        raise OSError(f"{source} can't be renamed")
    _write_json(spark, sidecar, facts | {"bytes": _size(spark, place)})


def read_images(spark: SparkSession, folder: str, keys: DataFrame, key: str = "window_id", shard: int = SHARD) -> DataFrame:
    """(key, png) of many images: keys are dealt by shard and only their shards' files are opened, each
    once, however many of its images are asked for."""
    wanted = keys.select(F.col(key).alias("_key"), shard_of(key, shard).alias("_shard")).distinct()
    shards = [r["_shard"] for r in wanted.select("_shard").distinct().limit(100_001).collect()]
    stored = spark.read.parquet(f"{folder.rstrip('/')}/data")
    if len(shards) <= 100_000:  # so many folders can be named; more are found by the join alone
        stored = stored.filter(F.col("shard").isin(shards))
    return stored.join(wanted, (F.col("shard") == F.col("_shard")) & (F.col(key) == F.col("_key"))).select(key, "png")


def read_image(spark: SparkSession, folder: str, key_value: int, key: str = "window_id", shard: int = SHARD) -> bytes:
    """One image; only its shard's file is opened."""
    path = f"{folder.rstrip('/')}/data/{_name(key_value // shard)}"
    row = spark.read.parquet(path).filter(F.col(key) == key_value).select("png").first() if exists(spark, path) else None
    if row is None:
        raise KeyError(key_value)
    return bytes(row["png"])


def damaged_images(spark: SparkSession, folder: str, key: str = "window_id") -> DataFrame:
    """(shard, images, committed): shards whose images' digests aren't those of their sidecars."""
    there = spark.read.parquet(f"{folder.rstrip('/')}/data").groupBy(F.col("shard").cast("long").alias("shard")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.sha2("png", 256).alias("h")))), lambda x: x["h"]).alias("now"))
    said = sidecars(spark, folder).select("shard", "sha256")
    return said.join(there, "shard", "full_outer").filter(~F.col("sha256").eqNullSafe(F.col("now"))).select("shard", F.size("now").alias("images"), F.size("sha256").alias("committed"))
