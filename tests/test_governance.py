"""Single writers and proofs observed while writing."""

import time

import pytest
from pyspark.sql import functions as F

from flowgrid.sources import lease, sinks
from flowgrid.sources.proof import Proof


def test_one_writer_of_two(spark, tmp_path):
    folder = f"file://{tmp_path}/stage"
    first = lease.acquire(spark, folder, owner="one")
    with pytest.raises(lease.LeaseHeld, match="one"):
        sinks.write_stage(spark.range(3), folder, {"a": 1})
    assert not (tmp_path / "stage/data").exists() and not list((tmp_path / "stage").glob("_partial*"))
    first.release()
    assert sinks.write_stage(spark.range(3), folder, {"a": 1})["rows"] == 3
    assert lease.holder(spark, folder)["done"]


def test_dead_owner_gives_way(spark, tmp_path):
    folder = f"file://{tmp_path}/stage"
    spark.range(9).write.parquet(f"{folder}/data")  # where the dead owner had just put its rows
    spark.range(9).write.parquet(f"{folder}/_partial-1")
    dead = lease.acquire(spark, folder, seconds=2, owner="dead")
    dead.renew()
    with pytest.raises(lease.LeaseHeld):
        lease.acquire(spark, folder)
    time.sleep(2.5)
    assert sinks.write_stage(spark.range(4), folder, {"a": 1})["rows"] == 4
    assert spark.read.parquet(f"{folder}/data").count() == 4
    with pytest.raises(lease.LeaseLost):
        dead.check()


def test_renewed_while_working(spark, tmp_path):
    folder = f"file://{tmp_path}/stage"
    with lease.acquire(spark, folder, seconds=3) as held:
        time.sleep(5)
        held.check()
        with pytest.raises(lease.LeaseHeld):
            lease.acquire(spark, folder)
    lease.acquire(spark, folder).release()


def test_a_number_is_taken_once(spark, tmp_path):
    path = f"file://{tmp_path}/_lease/000000001.lease"
    assert [lease._create(spark, path, "x") for _ in range(3)] == [True, False, False]
    # A lease whose owner died before it wrote its name ends after the usual time.
    lease._create(spark, f"file://{tmp_path}/f/_lease/000000001.lease")
    assert lease.holder(spark, f"file://{tmp_path}/f")["until"] == pytest.approx(time.time() + lease.SECONDS, abs=30)


def test_foreign_data_is_not_touched(spark, tmp_path):
    spark.range(2).write.parquet(f"{tmp_path}/s/data")
    with pytest.raises(FileExistsError):
        sinks.write_stage(spark.range(1), f"{tmp_path}/s", {"a": 1})
    assert spark.read.parquet(f"{tmp_path}/s/data").count() == 2


def test_proofs(spark, tmp_path):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 3).cast("int").alias("target"), F.when(F.col("id") % 2 == 0, "train").otherwise("test").alias("split"))
    proof = Proof(labels="target", keys=("id", "target"), counts={"test_rows": F.col("split") == "test"})
    first = sinks.write_stage(df, f"{tmp_path}/a", {"s": 1}, proof=proof)["proof"]
    assert (first["rows"], first["label_0"], first["label_1"], first["label_other"], first["test_rows"]) == (100, 34, 33, 33, 50)
    again = sinks.write_stage(df.repartition(5).orderBy(F.desc("id")), f"{tmp_path}/b", {"s": 1}, proof=proof, before=first)["proof"]
    assert again == first
    broken = {
        "lost": df.filter("id != 7"),
        "doubled": df.filter("id != 7").union(df.filter("id = 10")),  # as many rows and classes
        "swapped": df.withColumn("target", F.when(F.col("id") == 1, 2).when(F.col("id") == 2, 1).otherwise(F.col("target"))),
    }
    for name, rows in broken.items():
        with pytest.raises(AssertionError, match="preserved"):
            sinks.write_stage(rows, f"{tmp_path}/{name}", {"s": 1}, proof=proof, before=first)
        assert not (tmp_path / name / "data").exists() and not (tmp_path / name / "manifest.json").exists()
    with pytest.raises(AssertionError, match="must be zero.*crossed"):
        sinks.write_stage(df, f"{tmp_path}/c", {"s": 1}, proof=Proof(never={"crossed": F.col("id") > 98}))
    # Nothing is scanned for a proof but the rows that are written.
    empty = sinks.write_stage(df.filter("false"), f"{tmp_path}/d", {"s": 1}, proof=proof)["proof"]
    assert (empty["rows"], empty["key_sum"], empty["key_xor"]) == (0, None, None)
