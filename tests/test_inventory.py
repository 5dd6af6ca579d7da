"""Audits and inventories of folders of files of several schemas, against the csv module."""

import csv
import hashlib
import random
from collections import Counter

import pytest

from flowgrid.sources import inventory
from flowgrid.sources.inventory import audit_files, file_inventory

MARKERS = {"", "-", "nan", "null", "none"}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    r = random.Random(12)
    at = tmp_path_factory.mktemp("files") / "in"
    (at / "deep").mkdir(parents=True)
    cell = lambda: r.choice(["a", " b ", "-", "NaN", "(empty)", '"q,""x""\n y"', "7", ""])
    def write(name, header, rows, end="\n", bom=False):
        text = end.join([header, *rows]) + r.choice(["", end])
        (at / name).write_bytes((("﻿" if bom else "") + text).encode())
    times = lambda: r.choice(["1.50", "1.5", "-2", " 30 ", "abc", "inf", "2e1"])
    write("flows.csv", "ts,x,tunnel_parents   label   detailed-label", [f"{times()},{cell()},- {r.choice(['Benign', 'benign', 'Malicious'])}  C&C" for _ in range(50)], bom=True)
    write("other.CSV", "Label,fixed,n", [f"{r.choice(['x', 'Y', ' y '])},same,{cell()}" if k % 7 else "" for k in range(40)], "\r\n")
    write("deep/wrong.csv", "ts,label", ["1,a", "2", "3,b,c", "4,a"])
    write("none.csv", "ts,label", [])
    (at / "skip.txt").write_text("a\n")
    (at / "zero.csv").write_text("")  # not listed
    return at


def brute(path, limit=None):
    with path.open(encoding="utf-8-sig", newline="") as f:
        records = [x for x in csv.reader(f, strict=True) if x]
    names = [g for c in records[0] for g in (c.split() if len(c.split()) == 3 else [c.strip()])]
    rows, wrong = [], 0
    for x in records[1 : None if limit is None else limit + 1]:
        values = [v for c, v in zip(records[0], x, strict=False) for v in (v.split() if len(c.split()) == 3 else [v.strip()])]
        if len(x) != len(records[0]):
            wrong += 1
        else:
            rows.append(values)
    return names, rows, wrong, len(records) - 1


@pytest.mark.parametrize("limit", [None, 10])
def test_audit(spark, folder, limit):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    try:
        audit = audit_files(spark, str(folder), limit, recursive=True)
        files = {x["file"].rsplit("/", 1)[1]: x for x in audit.files.collect()}
        columns = {(x["file"].rsplit("/", 1)[1], x["column"]): x for x in audit.columns.collect()}
        labels = {(x["file"].rsplit("/", 1)[1], x["column"], x["label"]): x["n"] for x in audit.labels.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    wanted = {}
    for path in (folder / "flows.csv", folder / "other.CSV"):
        names, rows, wrong, every = brute(path, limit)
        f = files[path.name]
        assert (f["status"], f["rows"], f["columns"], f["wrong_rows"]) == ("sampled_prefix" if limit and every > limit else "complete_file", len(rows), names, wrong)
        for k, name in enumerate(names):
            values = [x[k] for x in rows]
            c = columns[path.name, name]
            assert (c["position"], c["missing"], c["empty_sets"], c["constant"]) == (k, sum(v.lower() in MARKERS for v in values), values.count("(empty)"), len(set(values)) == 1)
            if "label" in name.lower():
                wanted.update({(path.name, name, v): n for v, n in Counter(values).items()})
        if "ts" in names:
            times = [(float(x[0]), x[0]) for x in rows if x[0] not in ("abc", "inf")]
            assert (f["ts_min"], f["ts_max"], f["ts_invalid"]) == (min(times, key=lambda t: t[0])[1], max(times, key=lambda t: t[0])[1], len(rows) - len(times))
            assert f["backward_steps"] == sum(b[0] < a[0] for a, b in zip(times, times[1:], strict=False))
    assert {k: n for k, n in labels.items() if k[0] != "wrong.csv"} == wanted
    assert files["none.csv"]["status"] == "empty" and files["none.csv"]["columns"] == ["ts", "label"]
    assert set(files) == {"flows.csv", "other.CSV", "wrong.csv", "none.csv"}
    if limit is None:
        assert (files["wrong.csv"]["status"], files["wrong.csv"]["rows"], files["wrong.csv"]["wrong_rows"], files["wrong.csv"]["first_wrong_record"]) == ("error", 2, 2, 2)


def test_inventory(spark, folder, monkeypatch):
    for held in (100_000, 1):
        monkeypatch.setattr(inventory, "LABELS_HELD", held)
        files, labels = file_inventory(spark, str(folder))
        got = {x["file"].rsplit("/", 1)[1]: x for x in files.collect()}
        counted = {}
        for x in labels.collect():
            counted.setdefault(x["file"].rsplit("/", 1)[1], {})[x["label"]] = x["n"]
        assert set(got) == {"flows.csv", "other.CSV", "wrong.csv", "none.csv"}
        for path in (folder / "flows.csv", folder / "other.CSV", folder / "deep/wrong.csv", folder / "none.csv"):
            body, f = path.read_bytes(), got[path.name]
            assert (f["bytes"], f["sha256"]) == (len(body), hashlib.sha256(body).hexdigest()), path.name
            with path.open(encoding="utf-8-sig", newline="") as h:
                records = [x for x in csv.reader(h) if x]
            assert (f["rows"], f["columns"], f["column_count"]) == (len(records) - 1, records[0], len(records[0]))
        other = Counter(x[0].strip() for x in csv.reader((folder / "other.CSV").open(newline="")) if x)
        other.pop("Label")
        assert counted["other.CSV"] == dict(other) and got["other.CSV"]["distinct_labels"] == len(other) and got["other.CSV"]["label_column"] == "Label"


def test_a_file_larger_than_a_batch_is_one_stream(spark, tmp_path):
    body = b"n,label\n" + b"".join(b"%d,%s\n" % (k, b"ab"[k % 2 : k % 2 + 1]) for k in range(60_000))
    (tmp_path / "big.csv").write_bytes(body)
    files, labels = file_inventory(spark, str(tmp_path))
    assert (f := files.first())["sha256"] == hashlib.sha256(body).hexdigest() and f["rows"] == 60_000
    assert {x["label"]: x["n"] for x in labels.collect()} == {"a": 30_000, "b": 30_000}
