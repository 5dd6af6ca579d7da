"""Sinks that never overwrite, with a manifest as the last file written."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgrid.sources.lease import acquire
from flowgrid.sources.proof import Observed, Proof, require_preserved


def configuration_hash(configuration: dict) -> str:
    return hashlib.sha256(json.dumps(configuration, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def write_manifest(spark: SparkSession, folder: str, content: dict) -> None:
    """Beside the data, under another name first and then renamed: it marks completion."""
    p, fs = _path(spark, f"{folder.rstrip('/')}/manifest.json")
    if fs.exists(p):
        raise FileExistsError(str(p))
    part, _ = _path(spark, f"{folder.rstrip('/')}/manifest.json.partial")
    out = fs.create(part)
    out.write(bytearray(json.dumps(content, sort_keys=True, indent=1).encode()))
    out.close()
    fs.rename(part, p)


def read_manifest(spark: SparkSession, folder: str) -> dict:
    return json.loads(spark.read.text(f"{folder.rstrip('/')}/manifest.json", wholetext=True).first()["value"])


def write_stage(df: DataFrame, folder: str, configuration: dict, partition_by: list[str] | None = None, proof: Proof | None = None, before: dict | None = None, more: Callable[[dict], dict] | None = None) -> dict:
    """A stage's rows as Parquet and its manifest with configuration, row count and proof.

    A folder that is complete and has the same configuration is kept as it is; one that another
    writer holds, or that has another configuration, fails before anything is written. Rows get their
    place only after the proof holds: what ``proof`` says must be zero is, and what it shares with
    ``before``, the proof of the stage's input, is equal. ``more`` adds fields to the manifest from
    the observed values and may fail too. What a writer has left that died in between goes.
    """
    spark, folder = df.sparkSession, folder.rstrip("/")
    own = configuration_hash(configuration)
    if exists(spark, f"{folder}/manifest.json"):
        return _kept(spark, folder, own)
    with acquire(spark, folder) as lease:
        if exists(spark, f"{folder}/manifest.json"):  # by the writer that has just ended
            return _kept(spark, folder, own)
        if exists(spark, f"{folder}/data"):
            if lease.number == 1:
                raise FileExistsError(f"{folder}/data isn't a stage's")
            _delete(spark, f"{folder}/data")
        part = f"{folder}/_partial-{lease.number}"
        _delete(spark, part)
        observed = Observed(df, proof or Proof())
        writer = observed.frame.write.mode("errorifexists")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(part)
        values = observed.values()
        if before:
            require_preserved(before, values)
        manifest = {"configuration": configuration, "configuration_hash": own, "rows": values["rows"], "columns": df.columns, "proof": values, "spark": spark.version, **(more(values) if more else {})}
        lease.check()
        source, fs = _path(spark, part)
        if not fs.rename(source, _path(spark, f"{folder}/data")[0]):
            raise OSError(f"{part} can't be renamed")
        write_manifest(spark, folder, manifest)
        return manifest


#: Fields that are a stage's own, whatever it goes on from.
OWN_FIELDS = ("configuration", "configuration_hash", "rows", "columns", "proof", "spark")


def patched(manifest: dict, note: str, **changes) -> dict:
    """What a stage takes over from an earlier manifest: all but that stage's own fields, with some
    replaced and a note added to its notes."""
    kept = {k: v for k, v in manifest.items() if k not in OWN_FIELDS}
    return kept | changes | {"notes": [*manifest.get("notes", []), note], "patched_from": manifest["configuration_hash"]}


def _kept(spark: SparkSession, folder: str, own: str) -> dict:
    found = read_manifest(spark, folder)
    if found["configuration_hash"] != own:
        raise FileExistsError(f"{folder} was written with another configuration")
    return found


def _delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def write_report(df: DataFrame, path: str) -> None:
    """A small report as one CSV file with a header."""
    df.coalesce(1).write.mode("errorifexists").option("header", True).csv(path)


def write_dictionary(dictionary: DataFrame, path: str) -> None:
    dictionary.write.mode("errorifexists").option("compression", "gzip").json(path)


def split_view(items: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """The same items under another split: a small table of changes over unchanged data."""
    changed = overrides.select(F.col(key).alias("_key"), F.col("split").alias("_split"))
    return items.join(changed, F.col(key) == F.col("_key"), "left").withColumn("split", F.coalesce("_split", "split")).drop("_key", "_split")


def data_fingerprint(df: DataFrame, columns: list[str]) -> str:
    """A digest of the rows' content; order, files and times don't matter."""
    row = F.sha2(F.to_json(F.struct(*columns)), 256)
    r = df.agg(F.count("*").alias("n"), F.bit_xor(F.conv(F.substring(row, 1, 15), 16, 10).cast("long")).alias("x"), F.sum(F.conv(F.substring(row, 16, 8), 16, 10).cast("decimal(38,0)")).alias("s")).first()
    return hashlib.sha256(f"{r['n']}:{r['x']}:{r['s']}".encode()).hexdigest()
