import csv
import gzip
import hashlib
import json
import random

import pytest

from flowgrid import schemas
from flowgrid.operators import prepare
from flowgrid.sources import flows, records, shards, sinks
from flowgrid.streaming import profile as streaming

HEADER = schemas.RAW_FIELDS[:-1]


def record(ts="1.5", label="Benign", detail="-", tunnel="-"):
    return [ts, "u1", "10.0.0.1", "80", "10.0.0.2", "443", "tcp", "-", "0.1", "5", "6", "SF", "-", "-", "0", "Sh", "1", "2", "3", "4"], f"{tunnel}   {label}   {detail}"


def write(path, header, rows, bom=False):
    text = "\n".join([",".join(header), *rows]) + "\n"
    path.write_text(("\ufeff" if bom else "") + text, encoding="utf-8")
    return str(path)


def merged(tmp_path, rows, name="m.csv", last="tunnel_parents   label   detailed-label", bom=False):
    return write(tmp_path / name, [*HEADER, last], [",".join([*a, b]) if a else "" for a, b in rows], bom)


def test_merged_header_and_blank_rows(spark, tmp_path):
    path = merged(tmp_path, [record(), ([], ""), record("2.5", "Malicious", "C&C")], bom=True)
    got = flows.read_flows(spark, path).orderBy("source_row").collect()
    assert [(r["source_row"], r["label"], r["detailed-label"]) for r in got] == [(1, "Benign", "-"), (3, "Malicious", "C&C")]
    assert got[0]["source_file"] == "m.csv"
    assert records.record_counts(spark, path).first()["blank_rows"] == 1
    prepared = prepare.prepare_flows(flows.read_flows(spark, path)).toPandas()
    assert prepared.target.tolist() == [0, 1] and len([c for c in prepared if c in schemas.FEATURES]) == 17
    assert sorted(r["source_row"] for r in flows.read_prefix(spark, path, 2).collect()) == [1, 3]  # blank lines don't count
    typed = prepare.type_features(prepare.prepare_flows(flows.read_flows(spark, path))).toPandas()
    assert typed.ts.tolist() == [1.5, 2.5]


def test_renamed_label(spark, tmp_path):
    path = merged(tmp_path, [record()], last="tunnel_parents label det_label")
    assert flows.read_flows(spark, path).first()["detailed-label"] == "-"


def test_bad_headers():
    every = schemas.RAW_FIELDS + schemas.LABEL_FIELDS
    with pytest.raises(ValueError, match="extra fields: \\['more'\\]"):
        flows.parse_header([*every, "more"])
    with pytest.raises(ValueError, match="missing fields: \\['ts'\\]"):
        flows.parse_header(every[1:])
    with pytest.raises(ValueError, match="twice"):
        flows.parse_header([*every, "ts"])
    with pytest.raises(ValueError, match="blank"):
        flows.parse_header([*every, " "])


def test_bad_records(spark, tmp_path):
    short = record()[0][:-1]
    path = merged(tmp_path, [(short, "- a b")])
    with pytest.raises(Exception, match="number of cells|MALFORMED"):
        flows.read_flows(spark, path).collect()
    path = merged(tmp_path, [(record()[0], "- Benign")], "n.csv")
    with pytest.raises(Exception, match="merged cell"):
        flows.read_flows(spark, path).collect()
    path = merged(tmp_path, [record("abc")], "t.csv")
    with pytest.raises(Exception, match="invalid time"):
        prepare.check_times(flows.read_flows(spark, path)).collect()


def csv_file(r, path, n, bom):
    """A file of n records, some blank, some cells quoted, with line breaks, quotes and delimiters."""
    parts, quoted = ["a,\"b\nc\",d"], ["plain", "", "x y", " lead", "tab\t", "'", "end\\"]
    for _ in range(n):
        cells = []
        for _ in range(3):
            if r.random() < 0.3:
                cells.append('"' + "".join(r.choice(["a", ",", "\n", '""', " ", "\r\n", "\n\n", "\\", "é"]) for _ in range(r.randint(0, 6))) + '"')
            else:
                cells.append(r.choice(quoted) + str(r.randint(0, 9)) + r.choice(["", "", 'in"side"']))
        parts.append("" if r.random() < 0.1 else ",".join(cells))
    text = "".join(p + r.choice(["\n", "\r\n"]) for p in parts)
    path.write_bytes((("\ufeff" if bom else "") + (text if r.random() < 0.5 else text.rstrip("\r\n") + "\nlast,1,2")).encode())


def test_records_equal_the_csv_module(spark, tmp_path):
    r = random.Random(11)
    (tmp_path / "in").mkdir()
    want, blanks = {}, {}
    for k in range(6):
        path = tmp_path / f"in/f{k}.csv"
        csv_file(r, path, 60, k % 2)
        with path.open(encoding="utf-8-sig", newline="") as f:
            every = list(csv.reader(f, strict=True))
        rows = [(n, c) for n, c in enumerate(every) if c]
        want[path.name] = [(n, m, c) for m, (n, c) in enumerate(rows)]
        blanks[path.name] = (len(rows) - 1, len(every) - len(rows))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("128m", "97", "500"):  # blocks that end inside quotes, within line breaks and characters
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1" if size != "128m" else was[1])
            got = {}
            for x in records.read_records(spark, str(tmp_path / "in")).collect():
                got.setdefault(x["file"].rsplit("/", 1)[1], []).append((x["record"], x["row"], x["cells"]))
            assert {k: sorted(v) for k, v in got.items()} == want
            counted = {x["file"].rsplit("/", 1)[1]: (x["data_rows"], x["blank_rows"]) for x in records.record_counts(spark, str(tmp_path / "in")).collect()}
            assert counted == blanks
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was[0])
        spark.conf.set("spark.sql.files.openCostInBytes", was[1])
    assert records.first_record(spark, str(tmp_path / "in/f1.csv")) == ["a", "b\nc", "d"]


@pytest.mark.parametrize(("text", "message"), [("a,b\n1,\"x\n2,3\n", "isn't closed"), ("a,b\nx\"y,1\n2,z\"3\n", "inside a cell"), ("a,b\n\"x\"y,1\n", "malformed"), ("a,b\n1,2\r3,4\n", "carriage return")])
def test_bad_quotes_fail(spark, tmp_path, text, message):
    (tmp_path / "x.csv").write_bytes(text.encode())
    with pytest.raises(Exception, match=message):
        records.read_records(spark, str(tmp_path / "x.csv")).collect()


def test_flows_with_line_breaks(spark, tmp_path):
    cells, label = record()
    broken = [*cells[:1], '"u\n""1"', *cells[2:]]
    path = merged(tmp_path, [record(), (broken, label), ([], ""), record("3.5", "Malicious", "C&C")])
    got = flows.read_flows(spark, path).orderBy("source_row").collect()
    assert [(x["source_row"], x["uid"]) for x in got] == [(1, "u1"), (2, 'u\n"1'), (4, "u1")]
    pilot = flows.read_flows(spark, path, blank_count=False).orderBy("source_row").collect()
    assert [x["source_row"] for x in pilot] == [1, 2, 3]
    assert sorted(x["source_row"] for x in flows.read_prefix(spark, path, 3).collect()) == [1, 2, 4]


def test_discovery(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("b.CSV", "a.csv", "c.txt", "sub/d.csv"):
        (tmp_path / name).write_text("x\n1\n")
    found = [p.rsplit("/", 1)[1] for p in flows.discover(spark, str(tmp_path))]
    assert found == ["a.csv", "b.CSV"]
    assert len(flows.discover(spark, str(tmp_path), recursive=True)) == 3
    assert flows.unchanged(spark, str(tmp_path / "a.csv")) == flows.unchanged(spark, str(tmp_path / "a.csv"))
    with pytest.raises(ValueError, match="missing columns"):
        flows.read_table(spark, str(tmp_path / "a.csv"), ["y"])


def test_union_blocks(spark):
    a = spark.createDataFrame([(1, "x")], "v int, f string")
    with pytest.raises(ValueError, match="present"):
        prepare.union_blocks([a, a], "f")
    with pytest.raises(ValueError, match="differ"):
        prepare.union_blocks([a, a.drop("f")])
    assert not prepare.duplicate_keys(a.union(a), "v").isEmpty()
    assert prepare.reconcile(a, a.withColumn("v", a["v"] + 1), "f", ["v"]).count() == 1


def test_stages_are_kept_and_not_overwritten(spark, tmp_path):
    folder = f"{tmp_path}/stage"
    df = spark.range(5)
    assert sinks.write_stage(df, folder, {"a": 1})["rows"] == 5
    assert sinks.write_stage(df, folder, {"a": 1}) == sinks.read_manifest(spark, folder)
    with pytest.raises(FileExistsError):
        sinks.write_stage(df, folder, {"a": 2})
    assert sinks.data_fingerprint(df, ["id"]) == sinks.data_fingerprint(df.repartition(3), ["id"])
    sinks.write_dictionary(spark.createDataFrame([("a", 0)], "value string, code long"), f"{tmp_path}/d")
    found = [json.loads(x) for p in (tmp_path / "d").glob("*.json.gz") for x in gzip.open(p).read().splitlines()]
    assert found == [{"value": "a", "code": 0}]
    with pytest.raises(Exception, match="exists"):
        sinks.write_report(df, f"{tmp_path}/d")


def test_shards(spark, tmp_path, monkeypatch):
    images = spark.range(60).selectExpr("id * 70 AS window_id", "CAST(concat('image ', id) AS BINARY) AS png")
    whole, folder = f"{tmp_path}/whole", f"{tmp_path}/s"
    assert shards.write_shards(images, whole, "c") == {"kept": 0, "written": 5}
    commit = shards._commit

    def killed(spark, folder, part, shard, facts):
        if shard == 3:
            (tmp_path / "s/data/shard=000000003").mkdir(parents=True)  # moved in part
            raise KeyboardInterrupt
        commit(spark, folder, part, shard, facts)

    monkeypatch.setattr(shards, "_commit", killed)
    with pytest.raises(KeyboardInterrupt):
        shards.write_shards(images, folder, "c", wave=2)
    monkeypatch.undo()
    kept = shards.completed_shards(spark, folder, "c")
    assert kept in ([0, 1], [0, 1, 2])
    (tmp_path / "s/data/shard=000000001/part-x").write_bytes(b"more")  # not what was committed
    done = shards.write_shards(images.repartition(7), folder, "c", wave=2)
    assert done == {"kept": len(kept) - 1, "written": 6 - len(kept)}
    assert shards.write_shards(images, folder, "c") == {"kept": 5, "written": 0}
    # Resumed and whole runs hold the same bytes.
    body = lambda at: {p.parent.name: p.read_bytes() for p in (tmp_path / at / "data").rglob("*.parquet")}
    assert len(body("s")) == 5 and {k: len(v) for k, v in body("s").items()} == {k: len(v) for k, v in body("whole").items()}
    every = lambda at: sorted(map(tuple, spark.read.parquet(f"{at}/data").select("shard", "window_id", "png").collect()))
    assert every(folder) == every(whole) and len(every(folder)) == 60
    sides = lambda at: sorted((x["shard"], x["images"], x["sha256"]) for x in shards.sidecars(spark, at).collect())
    assert sides(folder) == sides(whole) and sides(folder)[0][2][1] == hashlib.sha256(b"image 1").hexdigest()
    assert shards.read_image(spark, folder, 2100) == b"image 30"
    for absent in (1, 10**9):
        with pytest.raises(KeyError):
            shards.read_image(spark, folder, absent)
    some = shards.read_images(spark, folder, spark.range(40, 60).selectExpr("id * 70 AS window_id").union(spark.createDataFrame([(2800,), (5,)], "window_id long")))
    assert sorted((x["window_id"], bytes(x["png"])) for x in some.collect()) == [(k * 70, b"image %d" % k) for k in range(40, 60)]
    assert shards.damaged_images(spark, folder).isEmpty()
    with pytest.raises(FileExistsError, match="another configuration"):
        shards.write_shards(images, folder, "other")


def test_streaming(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    stream = streaming.stream_table(spark, f"{tmp_path}/in", events.schema)
    counts = streaming.label_counts(stream, "event_type").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    counts.awaitTermination()
    assert spark.table("counts").agg({"n": "sum"}).first()[0] == 1000
    stream = streaming.stream_table(spark, f"{tmp_path}/in", events.schema)
    streaming.run_available(stream.select("event_id"), f"{tmp_path}/out", f"{tmp_path}/check")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1000
