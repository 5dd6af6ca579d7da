"""File-to-file stages: each reads what the one before has written and leaves a manifest last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgrid.functions.scalar import finite, flat_name, is_missing, is_sha256
from flowgrid.operators import correlate, encode, hashes, metrics, ordering, prepare, profile, represent, select, split, train, windows
from flowgrid.schemas import CATEGORICAL, FEATURES, NUMERIC, PAPER_CLASSES, UNKNOWN_CODE, WINDOW_ROWS
from flowgrid.sources import flows, inventory, records, shards, sinks
from flowgrid.sources.proof import Observed, Proof


def _in(spark: SparkSession, folder: str) -> DataFrame:
    """A completed stage's rows."""
    sinks.read_manifest(spark, folder)
    return spark.read.parquet(f"{folder.rstrip('/')}/data")


#: What a table of flows must keep from stage to stage.
FLOWS = Proof(labels="target", keys=("source_file", "source_row"))


def _proof(spark: SparkSession, folder: str) -> dict:
    return sinks.read_manifest(spark, folder)["proof"]


def audit(spark: SparkSession, folder: str, out: str, recursive: bool = False, limit: int | None = None) -> dict:
    """Of every file, in one scan: rows, columns, times, missing markers, empty sets and constancy of
    each column, and the counts of each label column."""
    found = inventory.audit_files(spark, folder, limit, recursive)
    configuration = {"folder": folder, "limit": limit, "recursive": recursive}
    for name, table in (("files", found.files), ("columns", found.columns), ("labels", found.labels)):
        sinks.write_stage(table, f"{out}/{name}", {"stage": f"audit_{name}", **configuration})
    return sinks.write_stage(_in(spark, f"{out}/columns"), out, {"stage": "audit", **configuration})


def external_audit(spark: SparkSession, folder: str, out: str, label: str | None = None, threshold: float = 0.999) -> dict:
    """Any CSV tree: an inventory of files with their digests, of schemas, column profiles of all files
    of one schema together, and label counts; blank labels stay apart."""
    configuration = {"folder": folder, "label": label, "threshold": threshold}
    files, labels = inventory.file_inventory(spark, folder, label)
    sinks.write_stage(files, f"{out}/files", {"stage": "external_files", **configuration})
    files = _in(spark, f"{out}/files")
    sinks.write_stage(profile.schema_inventory(files), f"{out}/schemas", {"stage": "external_schemas", **configuration})
    manifest = sinks.write_stage(inventory.column_profiles(spark, folder, threshold), f"{out}/columns", {"stage": "external_audit", **configuration})
    named = labels.join(files.select("file", F.array_join("columns", "|").alias("schema")), "file")
    sinks.write_stage(profile.label_shares(named.groupBy("schema", "label").agg(F.sum("n").alias("n")), "schema"), f"{out}/labels", {"stage": "external_labels", **configuration})
    return manifest


def pilot_stage(spark: SparkSession, audited: str, folder: str, out: str, most: int = 200_000) -> dict:
    """The small files of an audit, complete and with 1 to ``most`` rows, in the order of file, exact
    time and row. Rows and labels are reconciled with the audit, file by file."""
    chosen = _in(spark, f"{audited}/files").filter(F.col("status").isin("complete_file") & (F.col("rows") > 0) & (F.col("rows") <= most))
    if chosen.isEmpty():
        raise ValueError("no file is small enough")
    read = flows.read_folder(spark, folder, chosen)
    rows = prepare.check_times(read.withColumn("target", prepare.binary_target("label")))
    manifest = sinks.write_stage(prepare.pilot_sort(rows), out, {"stage": "pilot", "audit": audited, "folder": folder, "most": most}, proof=FLOWS)
    name = F.element_at(F.split("file", "/"), -1).alias("source_file")
    text = F.regexp_replace("label", r"^\s+|\s+$", "")
    got = _in(spark, out).groupBy("source_file", text.alias("label")).agg(F.count("*").alias("n"))
    said = _in(spark, f"{audited}/labels").filter(F.col("column") == "label").join(chosen.select("file"), "file", "left_semi").select(name, "label", "n")
    keyed = [x.withColumn("_key", F.concat_ws("|", "source_file", "label")).select("_key", "n") for x in (got, said)]
    differs = prepare.reconcile(*keyed, "_key", ["n"])
    if not differs.isEmpty():
        raise ValueError(f"the audit and the files differ: {[r.asDict() for r in differs.limit(5).collect()]}")
    return manifest


def label_stage(spark: SparkSession, pilot: str, extra: str, out: str, rows: int = 10_000, wanted: str = "Mirai") -> dict:
    """The pilot and the first rows of one more file, with the paper's classes. The extra block must
    hold the wanted class and no file of the pilot; details without a class stay and are counted."""
    block = flows.read_prefix(spark, extra, rows, blank_count=False)
    block = prepare.pilot_sort(prepare.check_times(block.withColumn("target", prepare.binary_target("label"))))
    classed = lambda df: df.withColumn("paper_class", prepare.class_map("label", "`detailed-label`"))
    block = prepare.require_class(classed(block), "paper_class", wanted)
    both = prepare.union_blocks([classed(_in(spark, pilot)), block], "source_file")
    counts = {f"class_{c or 'unresolved'}": F.col("paper_class") == c for c in ["Benign", *sorted(set(PAPER_CLASSES.values())), ""]}
    manifest = sinks.write_stage(both, out, {"stage": "label", "pilot": pilot, "extra": extra, "rows": rows}, proof=Proof("target", keys=FLOWS.keys, counts=counts))
    sinks.write_stage(prepare.class_counts(_in(spark, out)), f"{out}/classes", {"stage": "classes", "labelled": out})
    return manifest


def prepare_stage(spark: SparkSession, path: str, out: str) -> dict:
    """Checked flows of one file, whose rows, labels and blank records are observed on the way; the
    file must not change meanwhile."""
    was = flows.unchanged(spark, path)

    def more(values: dict) -> dict:
        if flows.unchanged(spark, path) != was:
            raise ValueError(f"{path} changed while it was read")
        counted = records.record_counts(spark, path).first()
        if counted["data_rows"] != values["rows"]:
            raise AssertionError(f"{counted['data_rows']} records became {values['rows']} rows")
        return {"blank_rows": counted["blank_rows"], "source": [list(x) for x in was]}

    ready = prepare.check_times(prepare.prepare_flows(flows.read_flows(spark, path)))
    gaps = {f"missing_{flat_name(f)}": is_missing(f"`{f}`") for f in FEATURES}
    return sinks.write_stage(ready, out, {"stage": "prepare", "input": path}, proof=Proof("target", keys=FLOWS.keys, counts=gaps), more=more)


def sort_stage(spark: SparkSession, folder: str, out: str) -> dict:
    """The total order, as a dense index: row order in files means nothing from here on. First and
    last time stay as they were written."""
    df = _in(spark, folder).withColumn("_t", F.col("ts").cast("double"))
    twice = prepare.duplicate_keys(df, "source_file", "source_row")
    if not twice.isEmpty():
        raise ValueError("source rows aren't unique")
    indexed, n = ordering.ordered_index(df, ["_t", "source_row"])
    ends = indexed.agg(F.min_by("ts", "row_idx").alias("first_ts"), F.max_by("ts", "row_idx").alias("last_ts")).first().asDict()
    ties = ordering.equal_pairs(df, "_t").first()["equal_pairs"]
    proof = Proof("target", keys=FLOWS.keys, never={"outside": ~F.col("row_idx").between(0, n - 1)})
    return sinks.write_stage(indexed.drop("_t"), out, {"stage": "sort", "input": folder}, proof=proof, before=_proof(spark, folder), more=lambda _: {**ends, "equal_time_pairs": ties})


def encode_stage(spark: SparkSession, folder: str, out: str) -> dict:
    """Numeric features as doubles, categories as codes of their sorted values; missing is null."""
    df = prepare.type_features(_in(spark, folder))
    for c in CATEGORICAL:
        dictionary = encode.vocabulary(df, c)
        sinks.write_dictionary(dictionary, f"{out}/dictionaries/{flat_name(c)}")
        df = encode.dict_encode(df, c, dictionary, "_coded").drop(F.col(f"`{c}`")).withColumnRenamed("_coded", c)
    odd = {f"odd_code_{flat_name(c)}": F.col(f"`{c}`") < 0 for c in CATEGORICAL} | {f"not_finite_{flat_name(c)}": F.col(f"`{c}`").isNotNull() & ~finite(f"`{c}`") for c in NUMERIC}
    return sinks.write_stage(df, out, {"stage": "encode", "input": folder}, proof=Proof("target", keys=FLOWS.keys, never=odd), before=_proof(spark, folder))


def split_stage(spark: SparkSession, folder: str, out: str, seed: int = 42, fold: int = 0) -> dict:
    """Windows with split and fold, and their rows with categories and medians fitted on train.

    Proved on the way: every row of a whole window is there once, in its window and its window's split,
    the rest is the incomplete tail, both classes are in all splits, and nothing was fitted on rows out
    of train. The manifest of the windows has the fingerprint of who is in which split.
    """
    df = _in(spark, folder)
    before = _proof(spark, folder)
    total = before["rows"]
    rows = windows.count_windows(df, total)
    configuration = {"input": folder, "seed": seed, "fold": fold}
    assigned = split.stratified_split(windows.window_manifest(rows), seed=seed, fold=fold)
    sinks.write_stage(assigned, f"{out}/windows", {"stage": "windows", **configuration}, proof=Proof("target", keys=("window_id", "split", "fold", "target")))
    places = _in(spark, f"{out}/windows")
    lacking = [r["split"] for r in split.missing_classes(places).collect()]
    if lacking:
        raise ValueError(f"splits without both classes: {lacking}")
    joined = rows.join(places.select("window_id", "split"), "window_id")
    sinks.write_stage(joined, f"{out}/rows", {"stage": "rows", **configuration}, proof=Proof("target", keys=FLOWS.keys, never={"outside_window": F.floor(F.col("row_idx") / WINDOW_ROWS) != F.col("window_id"), "without_split": F.col("split").isNull()}))
    placed = _in(spark, f"{out}/rows")  # written once: the fits below read it, not each other's plans
    crossed = split.crossing_rows(placed, places, WINDOW_ROWS).first().asDict()
    kept = _proof(spark, f"{out}/rows")
    tail = total - kept["rows"]
    if any(crossed.values()) or tail != total % WINDOW_ROWS:
        raise AssertionError(f"rows cross windows: {crossed}, tail {tail}")
    train = F.col("split") == "train"
    fitting = Observed(placed.filter(train), Proof(counts={s: F.col("split") == s for s in ("train", "validation", "test")}))
    fitting.frame.select("split").write.format("noop").mode("overwrite").save()
    used = fitting.values()
    fitted = [encode.fit_category(placed, c, train) for c in CATEGORICAL]
    for f in fitted:  # known values get dense codes of the training rows
        placed = f.transform(placed, "_coded").drop(F.col(f"`{f.column}`")).withColumnRenamed("_coded", f.column)
    placed = encode.impute(placed, encode.fit_medians(placed, NUMERIC, train))
    unknown = {f"unknown_{flat_name(c)}": F.col(f"`{c}`") == UNKNOWN_CODE for c in CATEGORICAL}
    more = {"tail_rows": tail, "crossing": crossed, "fitted_on": {"train_rows": used["train"], "validation_rows": used["validation"], "test_rows": used["test"]}, "split_fingerprint": _proof(spark, f"{out}/windows")["key_sum"]}
    return sinks.write_stage(placed, out, {"stage": "split", **configuration}, ["split"], Proof("target", keys=FLOWS.keys, counts=unknown), kept, lambda _: more)


def validate_stage(spark: SparkSession, folder: str, split_folder: str, out: str, seed: int = 42, fold: int = 0) -> dict:
    """Saved memberships against those recomputed from the coded rows: any difference fails; no split
    is ever replaced."""
    df = _in(spark, folder)
    places = _in(spark, f"{split_folder}/windows")
    now = split.stratified_split(windows.window_manifest(windows.count_windows(df, _proof(spark, folder)["rows"])), seed=seed, fold=fold)
    found = split.reconcile_membership(places, now, fold=fold).first().asDict()
    found |= split.crossing_rows(_in(spark, f"{split_folder}/rows"), places, WINDOW_ROWS).first().asDict()
    if any(found.values()):
        raise ValueError(f"the saved split isn't that of the rows: {found}")
    return sinks.write_stage(spark.createDataFrame([found]), out, {"stage": "validate", "input": folder, "split": split_folder, "seed": seed, "fold": fold})


def select_stage(spark: SparkSession, folder: str, out: str, without: tuple[str, ...] = (), keep: int = 15, trees: int = 100, depth: int = 12, shap_per_class: int = 500) -> dict:
    """Ranking of features by a balanced forest and SHAP on training rows; ``without`` leaves some out.
    Times count from the first of train, so that they keep their detail as 32-bit numbers."""
    df = _in(spark, folder).filter(F.col("split") == "train")
    names = {f: flat_name(f) for f in FEATURES if f not in without}
    origin = df.agg(F.min("ts")).first()[0] or 0.0
    number = lambda f: (F.col(f"`{f}`") - F.lit(origin) if f == "ts" else F.col(f"`{f}`")).cast("float").cast("double")
    rows = df.select("row_idx", "target", *[number(f).alias(n) for f, n in names.items()])
    ranked, forest = select.select_features(rows, list(names.values()), "row_idx", keep=keep, trees=trees, depth=depth, shap_per_class=shap_per_class)
    configuration = {"input": folder, "without": list(without), "trees": trees, "depth": depth, "keep": keep, "shap_per_class": shap_per_class}
    sinks.write_stage(forest, f"{out}/forest", {"stage": "forest", **configuration}, proof=Proof(keys=("tree", "draws")))
    return sinks.write_stage(ranked, out, {"stage": "select", **configuration}, proof=Proof(counts={"selected": F.col("selected"), "zero_importance": F.col("importance") == 0}), more=lambda _: {"time_origin": origin, "test_rows_used": 0})


def correlate_stage(spark: SparkSession, folder: str, ranking: str, out: str, variance_threshold: float = 1e-8, redundancy_threshold: float = 0.999) -> dict:
    """Normalised features' correlations by window, filtered by entries learnt on train, rendered into
    shards that are committed one by one."""
    chosen = [r["feature"] for r in _in(spark, ranking).filter("selected").orderBy("rank").collect()]
    back = {flat_name(f): f for f in FEATURES}
    df = _in(spark, folder).select("window_id", "split", *[F.col(f"`{back[n]}`").alias(n) for n in chosen])
    df = encode.normalise(df, encode.fit_extrema(df, chosen, F.col("split") == "train"))
    configuration = {"input": folder, "features": chosen, "variance_threshold": variance_threshold, "redundancy_threshold": redundancy_threshold}
    corr = correlate.pearson_arrow(df, chosen)
    k = len(chosen)
    entries = [f"e_{i}_{j}" for i in range(k) for j in range(i + 1, k)]
    wide = corr.select("window_id", "corr", "active", *[F.col("corr")[i * k + j].alias(f"e_{i}_{j}") for i in range(k) for j in range(i + 1, k)])
    wide = wide.join(df.select("window_id", "split").distinct(), "window_id")
    decisions = correlate.entry_filter(correlate.entry_covariance(wide.filter(F.col("split") == "train"), entries), entries, variance_threshold, redundancy_threshold)
    counts = {d: F.col("decision") == d for d in ("retained", "low_variance", "redundant")}
    sinks.write_stage(decisions, f"{out}/entries", {"stage": "entries", **configuration}, proof=Proof(counts=counts))
    gone = {tuple(map(int, r["entry"].split("_")[1:])) for r in _in(spark, f"{out}/entries").filter("decision <> 'retained'").collect()}
    zero = correlate.filtered_matrix("corr", k, gone)
    varying = F.size(F.filter("active", lambda x: x))
    filtered = wide.select("window_id", "split", zero.alias("corr"), "active", varying.alias("varying_features"))
    matrices = sinks.write_stage(filtered, f"{out}/matrices", {"stage": "matrices", **configuration}, proof=Proof(keys=("window_id", "split"), counts={"low_activity": F.col("varying_features") < 2}))
    images = represent.render(_in(spark, f"{out}/matrices").select("window_id", "corr"), "window_id")
    shards.write_shards(images.select("window_id", "png"), f"{out}/images", matrices["configuration_hash"])
    stored = spark.read.parquet(f"{out}/images/data").select("window_id", "shard", F.sha2("png", 256).alias("png_sha256"))
    return sinks.write_stage(stored, out, {"stage": "images", **configuration}, proof=Proof(counts={"rows_": F.lit(True)}), before={"rows": matrices["rows"]})


def represent_audit_stage(spark: SparkSession, images: str, out: str, feature: str = "uid") -> dict:
    """How often matrices repeat in train and validation, as they are and without one feature."""
    chosen = sinks.read_manifest(spark, f"{images}/matrices")["configuration"]["features"]
    at = chosen.index(feature) if feature in chosen else None
    found = represent.representation_audit(_in(spark, f"{images}/matrices"), len(chosen), at)
    return sinks.write_stage(found, out, {"stage": "represent_audit", "images": images, "feature": feature}, more=lambda _: {"feature_present": at is not None, "test_windows_used": 0})


def index_stage(spark: SparkSession, images: str, split_folder: str, out: str) -> dict:
    """Where each window's image stands and its digest; exactly the windows of the split have one."""
    items = _in(spark, f"{split_folder}/windows").select("window_id", "split", "target")
    indexed = represent.image_index(_in(spark, images), items).withColumnRenamed("png_sha256", "hash")
    cover = hashes.coverage(_in(spark, images), items, "window_id").first().asDict()
    if any(cover.values()):
        raise ValueError(f"images and windows differ: {cover}")
    bad = {"bad_hash": ~is_sha256("hash")}
    manifest = sinks.write_stage(indexed, out, {"stage": "index", "images": images}, proof=Proof("target", keys=("window_id", "split", "target"), never=bad))
    sinks.write_stage(indexed.join(represent.previews(items).select("window_id"), "window_id", "left_semi"), f"{out}/previews", {"stage": "previews", "images": images})
    return manifest


def lookup_stage(spark: SparkSession, index: str, out: str) -> dict:
    """The lookup baseline: metrics over all, seen and unseen validation images."""
    found = hashes.lookup_predict(_in(spark, index))
    by = metrics.class_metrics(metrics.confusion(found, by=["training_hash_found"]), None)
    return sinks.write_stage(by.withColumn("training_hash_found", F.col("training_hash_found").cast("string")), out, {"stage": "lookup", "input": index})


def hash_split_stage(spark: SparkSession, index: str, out: str) -> dict:
    """The leak-free view: validation images that train has seen become training images.

    Proved while it is written: no image was lost or doubled, none of train has entered validation, and
    test is as it was; then that no hash is in both parts.
    """
    items = _in(spark, index)
    clean = hashes.clean_split(items.withColumn("original_split", F.col("split")))
    was, now = F.col("original_split"), F.col("split")
    cells = {f"{p}_{c}": (now == p) & (F.col("target") == k) for p in ("train", "validation", "test") for k, c in enumerate(("benign", "malicious"))}
    never = {"train_to_validation": (was == "train") & (now != "train"), "test_changed": (was == "test") != (now == "test"), "into_validation": (now == "validation") & (was != "validation")}
    proof = Proof("target", keys=("window_id", "hash", "target"), counts={"moved": was != now, **cells}, never=never)
    before = Observed(items, proof=Proof("target", keys=("window_id", "hash", "target")))
    before.frame.write.format("noop").mode("overwrite").save()
    hashes_of = lambda p: items.filter(F.col("split") == p).select("hash")
    known = hashes_of("train").union(hashes_of("validation")).distinct().count()
    said = sinks.read_manifest(spark, index)

    def more(values: dict) -> dict:
        """The index's manifest with what has changed: its counts, and a note."""
        counts = {p: {c: values[f"{p}_{c}"] for c in ("benign", "malicious")} for p in ("train", "validation", "test")}
        return sinks.patched(said, f"{values['moved']} validation images that train has were moved there", class_counts=counts, hashes=known, test_hashes_used=0)

    manifest = sinks.write_stage(clean, out, {"stage": "hash_split", "input": index}, proof=proof, before=before.values(), more=more)
    leaked = [r["hash"] for r in hashes.leaked_hashes(_in(spark, out)).orderBy("hash").limit(10).collect()]
    if leaked:
        raise AssertionError(f"train and validation still share hashes: {leaked}")
    return manifest


def _entries(spark: SparkSession, images: str) -> tuple[DataFrame, list[str]]:
    """(window_id, entries...): what a classifier reads of a matrix, the entries above its diagonal."""
    k = len(sinks.read_manifest(spark, f"{images}/matrices")["configuration"]["features"])
    names = [f"e_{i}_{j}" for i in range(k) for j in range(i + 1, k)]
    return _in(spark, f"{images}/matrices").select("window_id", *[F.col("corr")[i * k + j].cast("double").alias(f"e_{i}_{j}") for i in range(k) for j in range(i + 1, k)]), names


def train_stage(spark: SparkSession, index: str, images: str, out: str, epochs: int = 20, steps: int = 10, patience: int = 5, hidden: int = 16, seed: int = 42, batch: int = 8) -> dict:
    """A classifier on one training window for each distinct image, classes half and half; the state and
    its history, and the metrics of every epoch. Goes on from a state that is there."""
    entries, names = _entries(spark, images)
    items = _in(spark, index)
    epoch = split.hash_balanced_epoch(items, "window_id", 0, seed=seed, batch=batch)
    configuration = {"index": index, "images": images, "seed": seed, "batch": batch}
    sinks.write_stage(epoch, f"{out}/epoch", {"stage": "epoch", **configuration}, proof=Proof("target", keys=("place", "window_id")))
    rows = _in(spark, f"{out}/epoch").select("window_id", "target").join(entries, "window_id")
    validation = items.filter(F.col("split") == "validation").select("window_id", "target").join(entries, "window_id")
    fingerprint = sinks.data_fingerprint(items, ["window_id", "split", "target", "hash"])
    state = train.load(spark, f"{out}/state", names, fingerprint) if sinks.exists(spark, f"{out}/state/manifest.json") else None
    if state is None:
        state = train.fit(rows, validation, names, epochs=epochs, steps=steps, patience=patience, hidden=hidden, seed=seed)
        train.save(spark, state, f"{out}/state", fingerprint)
    sinks.write_stage(train.epoch_metrics(spark, state), f"{out}/epochs", {"stage": "epochs", **configuration})
    scored = train.predict(train.frozen(spark, state), validation, names).select("window_id", "target", "p")
    return sinks.write_stage(scored, out, {"stage": "train", **configuration}, proof=Proof("target"), more=lambda _: {"fingerprint": fingerprint, "test_windows_used": 0})


def evaluate_stage(spark: SparkSession, index: str, images: str, model: str, out: str, confirm: bool = False) -> dict:
    """The frozen classifier on test, once: a folder that has a result, or one that was begun, isn't
    scored again. Predictions, confusion and metrics at 0.5, beside those of the constant classes."""
    if not confirm:
        raise ValueError("test is scored once: confirm it")
    if sinks.exists(spark, out):
        raise FileExistsError(f"{out} has been evaluated, or an evaluation was begun")
    entries, names = _entries(spark, images)
    items = _in(spark, index)
    fingerprint = sinks.data_fingerprint(items, ["window_id", "split", "target", "hash"])
    state = train.load(spark, f"{model}/state", names, fingerprint)
    tested = items.filter(F.col("split") == "test").select("window_id", "target").join(entries, "window_id")
    scored = metrics.decide(train.predict(train.frozen(spark, state), tested, names).select("window_id", "target", "p"), "p").withColumn("correct", F.col("predicted") == F.col("target"))
    configuration = {"index": index, "model": model, "fingerprint": fingerprint}
    expected = items.filter(F.col("split") == "test").count()
    sinks.write_stage(scored.orderBy("window_id"), f"{out}/predictions", {"stage": "predictions", **configuration}, proof=Proof("target", keys=("window_id",)), before={"rows": expected})
    done = _in(spark, f"{out}/predictions")
    sinks.write_stage(metrics.confusion(done), f"{out}/confusion", {"stage": "confusion", **configuration})
    constant = [done.withColumn("predicted", F.lit(c)) for c in (0, 1)]
    baselines = prepare.union_blocks([metrics.class_metrics(metrics.confusion(d), None).withColumn("always", F.lit(c)) for c, d in enumerate(constant)])
    sinks.write_stage(baselines, f"{out}/baselines", {"stage": "baselines", **configuration})
    return sinks.write_stage(metrics.evaluate(done, "p"), out, {"stage": "evaluate", **configuration}, more=lambda _: {"test_windows_used": expected, "threshold": 0.5})


def diagnose_stage(spark: SparkSession, predictions: str, index: str, out: str) -> dict:
    """Threshold curve, enriched errors, conflicts and a summary of validation predictions."""
    p, i = spark.read.parquet(predictions), _in(spark, index)
    v = i.filter(F.col("split") == "validation")
    cover = hashes.coverage(p, v, "window_id").first()
    if cover["missing"] or cover["unexpected"] or cover["repeated"]:
        raise ValueError(f"predictions don't cover the index: {cover.asDict()}")
    groups = hashes.hash_groups(i)
    sinks.write_stage(metrics.threshold_curve(p, "p"), f"{out}/thresholds", {"stage": "thresholds"})
    sinks.write_stage(hashes.error_enrich(metrics.decide(p, "p").select("window_id", "target", "p", "predicted"), v.select("window_id", "hash"), groups, "window_id").orderBy("hash", "window_id"), f"{out}/errors", {"stage": "errors"})
    sinks.write_stage(hashes.conflicts(groups).orderBy(F.desc(F.col("validation_benign") + F.col("validation_malicious")), "hash"), f"{out}/conflicts", {"stage": "conflicts"})
    sinks.write_stage(metrics.score_quantiles(p, "p"), f"{out}/quantiles", {"stage": "quantiles"})
    return sinks.write_stage(metrics.evaluate(p, "p"), out, {"stage": "diagnose", "predictions": predictions})
