"""The file-to-file stages from a raw log to reports, and the training loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowgrid import __main__ as cli
from flowgrid import schemas
from flowgrid.operators import train
from flowgrid.plans import stages
from flowgrid.sources import flows, sinks


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    r = np.random.default_rng(8)
    folder = tmp_path_factory.mktemp("raw")
    lines = [",".join([*schemas.RAW_FIELDS[:-1], "tunnel_parents label detailed-label"])]
    for k in range(450):
        bad = k % 90 >= 45
        port, size = int(r.integers(1, 9)) * (10 if bad else 1), int(r.integers(1, 500)) * (5 if bad else 1)
        cells = [f"{1000 - k % 7 + k}", f"u{k}", f"10.0.0.{k % 5}", str(port), f"10.1.0.{k % 3}", "443", "tcp" if k % 2 else "udp", "-", "-" if k % 11 == 0 else f"{r.random():.3f}", str(size), str(size // 2), "SF", "-", "-", "0", "Sh", "1", str(size + 1), "3", "4"]
        lines.append(",".join([*cells, "- Malicious DDoS" if bad else "-  Benign -"]))
    (folder / "log.csv").write_text("\n".join(lines) + "\n\n")
    return folder


def test_stages(spark, raw, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "build_session", lambda _: spark)
    at = lambda x: f"{tmp_path}/{x}"
    proof = lambda x: sinks.read_manifest(spark, at(x))["proof"]
    path = flows.discover(spark, str(raw))[0]
    assert cli.main(["audit", "--folder", str(raw), "--out", at("audit")])["rows"] == 23
    counted = {(x["column"], x["label"]): x["n"] for x in spark.read.parquet(at("audit/labels/data")).collect()}
    assert counted == {("label", "Benign"): 225, ("label", "Malicious"): 225, ("detailed-label", "-"): 225, ("detailed-label", "DDoS"): 225}
    one = spark.read.parquet(at("audit/files/data")).first()
    assert (one["rows"], one["backward_steps"], one["ts_min"], one["ts_max"]) == (450, 0, "1000", "1448")
    assert cli.main(["external-audit", "--folder", str(raw), "--out", at("external")])["rows"] == 21
    done = cli.main(["prepare", "--path", path, "--out", at("flows")])
    assert (done["rows"], done["blank_rows"], done["proof"]["label_1"], done["proof"]["missing_duration"]) == (450, 1, 225, 41)
    cli.main(["sort", "--folder", at("flows"), "--out", at("sorted")])
    assert proof("sorted")["key_sum"] == proof("flows")["key_sum"] and sinks.read_manifest(spark, at("sorted"))["first_ts"] == "1000"
    cli.main(["encode", "--folder", at("sorted"), "--out", at("coded")])
    coded = spark.read.parquet(at("coded/data"))
    ordered = coded.orderBy("row_idx").toPandas()
    assert list(zip(ordered.ts, ordered.source_row, strict=True)) == sorted(zip(ordered.ts, ordered.source_row, strict=True))
    assert ordered["duration"].isna().sum() == 41
    done = cli.main(["split", "--folder", at("coded"), "--out", at("split")])
    assert done["crossing"] == {"rows_outside": 0, "mixed_windows": 0, "incomplete_windows": 0} and done["tail_rows"] == 0
    assert done["fitted_on"]["train_rows"] > 0 == done["fitted_on"]["test_rows"] and done["proof"]["key_sum"] == proof("coded")["key_sum"]
    assert spark.read.parquet(at("split/windows/data")).count() == 30
    assert cli.main(["validate", "--folder", at("coded"), "--split_folder", at("split"), "--out", at("valid")])["rows"] == 1
    with pytest.raises(ValueError, match="fold_differs"):
        cli.main(["validate", "--folder", at("coded"), "--split_folder", at("split"), "--out", at("valid2"), "--seed", "7"])
    cli.main(["select", "--folder", at("split"), "--out", at("ranking"), "--without", "uid", "--keep", "5", "--trees", "3", "--depth", "3", "--shap-per-class", "20"])
    ranked = spark.read.parquet(at("ranking/data")).toPandas()
    assert "uid" not in set(ranked.feature) and ranked.selected.sum() == 5
    assert spark.read.parquet(at("ranking/forest/data")).count() == 3
    assert cli.main(["correlate", "--folder", at("split"), "--ranking", at("ranking"), "--out", at("images")])["rows"] == 30
    assert spark.read.parquet(at("images/images/data")).count() == 30
    assert cli.main(["represent-audit", "--images", at("images"), "--out", at("repeats"), "--feature", "ts"])["rows"] >= 2
    cli.main(["index", "--images", at("images"), "--split_folder", at("split"), "--out", at("index")])
    index = spark.read.parquet(at("index/data"))
    assert index.count() == 30 and index.filter(F.col("hash").rlike("^[0-9a-f]{64}$")).count() == 30
    cli.main(["lookup", "--index", at("index"), "--out", at("lookup")])
    done = cli.main(["hash-split", "--index", at("index"), "--out", at("clean")])
    assert done["proof"]["train_to_validation"] == 0 and done["proof"]["key_sum"] is not None
    assert sum(n for c in done["class_counts"].values() for n in c.values()) == 30 and done["patched_from"] == sinks.read_manifest(spark, at("index"))["configuration_hash"]
    assert done["class_counts"]["test"] == {"benign": index.filter("split = 'test' and target = 0").count(), "malicious": index.filter("split = 'test' and target = 1").count()} and len(done["notes"]) == 1
    index.filter("split = 'validation'").select("window_id", "target", (F.col("window_id") / 40.0).alias("p")).write.parquet(at("predictions"))
    cli.main(["diagnose", "--predictions", at("predictions"), "--index", at("index"), "--out", at("reports")])
    assert spark.read.parquet(at("reports/data")).first()["tp"] is not None
    index.filter("split = 'train'").select("window_id", "target", F.lit(0.5).alias("p")).write.parquet(at("wrong"))
    with pytest.raises(ValueError, match="cover"):
        stages.diagnose_stage(spark, at("wrong"), at("index"), at("other"))
    with pytest.raises(FileExistsError):
        cli.main(["split", "--folder", at("coded"), "--out", at("split"), "--fold", "1"])
    # Training on distinct images, then test, once.
    cli.main(["train", "--index", at("index"), "--images", at("images"), "--out", at("model"), "--epochs", "2", "--steps", "3", "--hidden", "3", "--batch", "4"])
    epoch = spark.read.parquet(at("model/epoch/data")).groupBy("batch_id").agg(F.sum("target").alias("t"), F.count("*").alias("n")).collect()
    assert epoch and all((x["t"], x["n"]) == (2, 4) for x in epoch)
    with pytest.raises(ValueError, match="confirm"):
        cli.main(["evaluate", "--index", at("index"), "--images", at("images"), "--model", at("model"), "--out", at("test")])
    done = cli.main(["evaluate", "--index", at("index"), "--images", at("images"), "--model", at("model"), "--out", at("test"), "--confirm"])
    assert done["test_windows_used"] == index.filter("split = 'test'").count() == spark.read.parquet(at("test/predictions/data")).count()
    with pytest.raises(FileExistsError, match="evaluated"):
        cli.main(["evaluate", "--index", at("index"), "--images", at("images"), "--model", at("model"), "--out", at("test"), "--confirm"])
    with pytest.raises(ValueError, match="other features or data"):
        clean = at("clean") if spark.read.parquet(at("clean/data")).filter("split <> original_split").count() else at("index")
        stages.evaluate_stage(spark, clean, at("images"), at("model"), at("test2"), True) if clean != at("index") else train.load(spark, at("model/state"), ["x"], "")


def test_broken_stages_fail(spark, raw, tmp_path, monkeypatch):
    path = flows.discover(spark, str(raw))[0]
    stages.prepare_stage(spark, path, f"{tmp_path}/flows")
    real = stages.ordering.ordered_index
    for name, broken in (("lost", lambda df, keys, *a: (real(df, keys)[0].filter("row_idx <> 7"), 450)), ("twice", lambda df, keys, *a: (real(df, keys)[0].filter("row_idx <> 7").unionByName(real(df, keys)[0].filter("row_idx = 9")), 450))):
        monkeypatch.setattr(stages.ordering, "ordered_index", broken)
        with pytest.raises(AssertionError, match="preserved"):
            stages.sort_stage(spark, f"{tmp_path}/flows", f"{tmp_path}/{name}")
        assert not sinks.exists(spark, f"{tmp_path}/{name}/data")
    monkeypatch.undo()
    index = spark.createDataFrame([(k, f"{k % 6:064d}", k % 2, ["train", "validation", "test"][k % 3]) for k in range(30)], "window_id long, hash string, target int, split string")
    sinks.write_stage(index, f"{tmp_path}/index", {"i": 1})
    monkeypatch.setattr(stages.hashes, "clean_split", lambda df: df.withColumn("split", F.when(F.col("split") == "train", "validation").otherwise(F.col("split"))))
    with pytest.raises(AssertionError, match="must be zero.*train_to_validation"):
        stages.hash_split_stage(spark, f"{tmp_path}/index", f"{tmp_path}/clean")


def test_pilot_and_labels(spark, tmp_path):
    cells = lambda ts, detail, label="Malicious": [ts, "u", "a", "1", "b", "2", "tcp", "-", "0", "1", "1", "SF", "-", "-", "0", "h", "1", "1", "1", "1", f"- {label} {detail}"]
    (tmp_path / "in").mkdir()

    def write(name, rows, header=(*schemas.RAW_FIELDS[:-1], "tunnel_parents label detailed-label"), where="in"):
        (tmp_path / where / name).write_text("\n".join([",".join(header), *(",".join(r) for r in rows)]) + "\n")

    write("a.csv", [cells("2.00000000000000001", "DDoS"), [], cells("2", "-", "Benign"), cells("1", "C&C")])
    swapped = [*schemas.RAW_FIELDS[1:-1], "ts", "tunnel_parents   label det_label"]  # its own order and names
    write("b.csv", [[*r[1:20], r[0], r[20]] for r in [cells("5", "FileDownload"), cells("4", "DDoS")]], swapped)
    write("big.csv", [cells(str(k), "DDoS") for k in range(9)])
    at = lambda x: f"{tmp_path}/{x}"
    stages.audit(spark, at("in"), at("audit"))
    done = stages.pilot_stage(spark, at("audit"), at("in"), at("pilot"), most=5)
    assert (done["rows"], done["proof"]["label_0"], done["proof"]["label_1"]) == (5, 1, 4)
    got = [(x["source_file"], x["source_row"], x["ts"]) for x in spark.read.parquet(at("pilot/data")).sort("source_file", F.col("ts").cast("decimal(38,18)")).collect()]
    assert got == [("a.csv", 3, "1"), ("a.csv", 2, "2"), ("a.csv", 1, "2.00000000000000001"), ("b.csv", 2, "4"), ("b.csv", 1, "5")]
    (tmp_path / "more").mkdir()
    write("extra.csv", [cells("9", "Okiru"), cells("8", "Okiru"), cells("7", "Attack")], where="more")
    done = stages.label_stage(spark, at("pilot"), at("more/extra.csv"), at("labelled"), rows=2)
    assert (done["rows"], done["proof"]["class_Mirai"], done["proof"]["class_unresolved"], done["proof"]["class_Benign"]) == (7, 2, 1, 1)
    assert spark.read.parquet(at("labelled/classes/data")).filter("unresolved").first()["detail"] == "FileDownload"
    write("none.csv", [cells("9", "DDoS")], where="more")
    with pytest.raises(ValueError, match="Mirai"):
        stages.label_stage(spark, at("pilot"), at("more/none.csv"), at("l2"))
    write("a.csv", [cells("9", "Okiru")], where="more")
    with pytest.raises(ValueError, match="present already"):
        stages.label_stage(spark, at("pilot"), at("more/a.csv"), at("l3"))
    write("a.csv", [cells("2", "DDoS"), cells("3", "x", "Benign")])  # another file than was audited
    with pytest.raises(ValueError, match="audit and the files differ"):
        stages.pilot_stage(spark, at("audit"), at("in"), at("p2"), most=5)


def test_external_audit_by_header(spark, tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/a.csv").write_text("n,Label\n1,Normal Traffic\n2,x\n")
    (tmp_path / "in/deep/b.csv").write_text("Label,n\nbenign_traffic,3\n,4\n")
    stages.external_audit(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    numeric = spark.read.parquet(f"{tmp_path}/out/columns/data").filter("column = 'n'").collect()
    assert sorted((r["least"], r["greatest"], r["not_numeric"]) for r in numeric) == [(1, 2, 0), (3, 4, 0)]
    guessed = {r["label"]: r["guess"] for r in spark.read.parquet(f"{tmp_path}/out/labels/data").collect()}
    assert guessed == {"normal traffic": "benign", "x": "malicious", "benign_traffic": "benign", "": "unlabelled"}


def test_training(spark, tmp_path):
    r = np.random.default_rng(2)
    rows = [(k, int(k % 5 == 0), float(r.normal() + 2 * (k % 5 == 0)), float(r.normal())) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, target int, a double, b double")
    tr, va = df.filter("id < 150"), df.filter("id >= 150")
    state = train.fit(tr, va, ["a", "b"], epochs=2, steps=5, hidden=3)
    fingerprint = sinks.data_fingerprint(df, df.columns)
    train.save(spark, state, f"{tmp_path}/m", fingerprint)
    again = train.load(spark, f"{tmp_path}/m", ["a", "b"], fingerprint)
    again = train.fit(tr, va, ["a", "b"], epochs=3, steps=5, hidden=3, state=again)
    assert [h["epoch"] for h in again.history] == [1, 2, 3] and train.epoch_metrics(spark, again).filter("selected_as_best").count() == 1
    scored = train.predict(train.frozen(spark, again), va, ["a", "b"])
    assert scored.filter("(p > 0.5) = (target = 1)").count() > 35
    with pytest.raises(ValueError, match="other features"):
        train.load(spark, f"{tmp_path}/m", ["a"], fingerprint)
