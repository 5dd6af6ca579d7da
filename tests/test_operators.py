import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowgrid.functions import scalar
from flowgrid.operators import correlate, encode, forest, hashes, metrics, ordering, prepare, profile, represent, select, split, windows
from flowgrid.sources import flows, sinks


def one(frame):
    return frame.collect()[0].asDict()


# Published confusion cells (tn, fp, fn, tp) and their scores.
GOLDEN = [
    ((25, 5, 22, 47695), {"accuracy": 0.999434519446248, "macro_f1": 0.8245338404534355, "weighted_f1": 0.9994968922497487, "balanced_accuracy": 0.9164361408582546}),
    ((0, 30, 0, 47717), {"macro_f1": 0.4998428727059415}),
    ((22, 2, 13, 125), {"macro_f1": 0.8445794691397506, "balanced_accuracy": 0.911231884057971}),
    ((24, 0, 137, 38037), {"macro_f1": 0.6288309093494697, "balanced_accuracy": 0.9982055849531095}),
    ((0, 24, 0, 138), {"macro_f1": 0.46, "accuracy": 0.8518518518518519}),
]


@pytest.mark.parametrize(("cells", "scores"), GOLDEN)
def test_golden_metrics(spark, cells, scores):
    got = one(metrics.class_metrics(spark.createDataFrame([cells], "tn long, fp long, fn long, tp long")))
    for name, value in scores.items():
        assert got[name] == pytest.approx(value, abs=1e-14)


def test_absent_class_is_null_in_lookup_reports(spark):
    cells = spark.createDataFrame([(0, 0, 0, 38036)], "tn long, fp long, fn long, tp long")
    assert one(metrics.class_metrics(cells, None))["macro_f1"] is None
    assert one(metrics.class_metrics(cells))["macro_f1"] == 0.5


def brute_auc(y, p):
    pos, neg = [a for a, t in zip(p, y, strict=True) if t], [a for a, t in zip(p, y, strict=True) if not t]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def brute_ap(y, p):
    total, out = sum(y), 0.0
    for s in sorted(set(p), reverse=True):
        here = sum(t for a, t in zip(p, y, strict=True) if a == s)
        over = [t for a, t in zip(p, y, strict=True) if a >= s]
        out += here / total * sum(over) / len(over)
    return out


def test_auc_and_precision_with_ties(spark):
    r = np.random.default_rng(3)
    y, p = r.integers(0, 2, 200).tolist(), (r.integers(0, 20, 200) / 20).tolist()
    df = spark.createDataFrame(list(zip(y, p, strict=True)), "target int, p double")
    assert one(metrics.roc_auc(df, "p"))["roc_auc"] == pytest.approx(brute_auc(y, p))
    got = one(metrics.average_precision(df, "p"))
    assert got["ap_malicious"] == pytest.approx(brute_ap(y, p))
    assert got["ap_benign"] == pytest.approx(brute_ap([1 - t for t in y], [-a for a in p]))
    curve = metrics.threshold_curve(df, "p").toPandas()
    for row in curve.itertuples():
        assert row.tn == sum(a <= row.threshold and not t for a, t in zip(p, y, strict=True))
    whole = one(metrics.evaluate(df.withColumn("p", F.col("p") * 0.9 + 0.05), "p"))
    assert whole["tp"] + whole["tn"] + whole["fp"] + whole["fn"] == 200


def test_half_is_benign(spark):
    df = spark.createDataFrame([(0.5,), (0.5000001,)], "p double")
    assert [r[0] for r in df.select(scalar.above("p")).collect()] == [0, 1]


def test_missing_markers(spark):
    cells = ["", "-", " NaN", "NULL", "None", None, "(empty)", "0", "\t- "]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert [r[0] for r in df.select(scalar.is_missing("c")).collect()] == [True] * 6 + [False, False, True]
    got = {r["column"]: r for r in profile.missing_profile(df, ["c"]).collect()}["c"]
    assert (got["missing"], got["empty_sets"]) == (7, 1)


def test_numbers(spark):
    cells = ["1", " 2.5 ", "1e3", "1d", "1_000", "nan", "inf", "", None, "-0.5"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert [r[0] for r in df.select(scalar.to_number("c")).collect()] == [1, 2.5, 1000, None, None, None, None, None, None, -0.5]


def test_ordered_index_is_dense_and_sorted(spark):
    r = np.random.default_rng(1)
    df = spark.createDataFrame(pd.DataFrame({"a": r.integers(0, 50, 999), "b": np.arange(999)})).repartition(7)
    indexed, n = ordering.ordered_index(df, ["a", "b"])
    got = indexed.orderBy("row_idx").toPandas()
    assert n == 999 and got["row_idx"].tolist() == list(range(999))
    assert got[["a", "b"]].values.tolist() == sorted(got[["a", "b"]].values.tolist())
    assert ordering.order_violations(indexed, "row_idx", ["a", "b"]).isEmpty()
    sums = ordering.running_sums(df, ["a", "b"], {"upto": "a"}).orderBy("a", "b").toPandas()
    assert sums["upto"].tolist() == sums["a"].cumsum().tolist()


def test_ordered_index_of_nothing(spark):
    indexed, n = ordering.ordered_index(spark.createDataFrame([], "a int"), ["a"])
    assert n == 0 and indexed.count() == 0


def test_windows_leave_the_tail(spark):
    rows = spark.range(31).select(F.col("id").alias("row_idx"), F.col("id").cast("double").alias("ts"), (F.col("id") % 2).cast("int").alias("target"), (F.col("id") + 1).alias("source_row"))
    m = windows.window_manifest(windows.count_windows(rows, 31)).orderBy("window_id").collect()
    assert len(m) == 2 and [r["target"] for r in m] == [0, 1] and m[1]["last_source_row"] == 30
    assert m[0]["target_purity"] == pytest.approx(8 / 15)


def test_split_sizes(spark):
    items = spark.createDataFrame([(i, int(i >= 100)) for i in range(107)], "window_id long, target int")
    got = split.stratified_split(items).toPandas()
    small = got[got.target == 1]
    assert (small.split == "test").sum() == 2 and sorted(small[small.fold >= 0].fold) == [0, 1, 2, 3, 4]
    assert (got[got.target == 0].split == "test").sum() == 20
    again = split.stratified_split(items.repartition(3)).toPandas()
    assert got.sort_values("window_id").split.tolist() == again.sort_values("window_id").split.tolist()
    with pytest.raises(ValueError, match="fewer"):
        split.stratified_split(items.filter("window_id < 105"))


def test_balanced_epoch(spark):
    items = spark.createDataFrame([(i, int(i < 7)) for i in range(60)], "k long, target int")
    got = split.balanced_epoch(items, "k", 1).toPandas()
    assert (got.groupby(["batch_id", "target"]).size() == 4).all()
    assert set(got.k) == set(range(60))


def test_constant_features_have_no_correlation(spark):
    rows = spark.createDataFrame([(0, 1.0, 2.0 * k, 5.0 - k) for k in range(15)], "window_id int, a double, b double, c double")
    got = one(correlate.window_pearson(rows, ["a", "b", "c"]))
    assert got["corr_a_b"] == 0 and got["corr_b_c"] == pytest.approx(-1) and got["varying_features"] == 2
    wide = one(correlate.pearson_arrow(rows, ["a", "b", "c"]))
    assert np.allclose(np.reshape(wide["corr"], (3, 3)), [[0, 0, 0], [0, 1, -1], [0, -1, 1]], atol=1e-6)


def test_pearson_paths_agree(spark):
    r = np.random.default_rng(5)
    x = pd.DataFrame(r.normal(size=(150, 4)), columns=list("abcd")).assign(window_id=np.arange(150) // 15)
    df = spark.createDataFrame(x)
    sql = correlate.window_pearson(df, list("abcd")).orderBy("window_id").toPandas()
    arrow = correlate.pearson_arrow(df, list("abcd")).orderBy("window_id").toPandas()
    for k in range(10):
        want = np.corrcoef(x[x.window_id == k][list("abcd")].T)
        assert np.allclose(np.reshape(arrow["corr"][k], (4, 4)), want, atol=1e-6)
        assert sql["corr_a_d"][k] == pytest.approx(want[0, 3])
    entries = [f"corr_{a}_{b}" for a, b in correlate.entry_pairs(list("abcd"))]
    cov = {(v["entry_i"], v["entry_j"]): v["covariance"] for v in correlate.entry_covariance(correlate.window_pearson(df, list("abcd")).repartition(3), entries).collect()}
    want = np.cov(sql[entries].T.to_numpy(), bias=True)
    assert all(cov[(entries[i], entries[j])] == pytest.approx(want[i, j]) for i in range(6) for j in range(i, 6))


def test_entry_filter(spark):
    cov = spark.createDataFrame([("a", "a", 4.0), ("a", "b", 2.0), ("b", "b", 1.0), ("c", "c", 1e-9), ("a", "c", 0.0), ("b", "c", 0.0), ("d", "d", 2.0), ("a", "d", 0.1), ("b", "d", 0.1), ("c", "d", 0.0)], "entry_i string, entry_j string, covariance double")
    got = {r["entry"]: (r["decision"], r["redundant_with"]) for r in correlate.entry_filter(cov, list("abcd")).collect()}
    assert got == {"a": ("retained", None), "b": ("redundant", "a"), "c": ("low_variance", None), "d": ("retained", None)}


def test_unseen_and_missing_codes(spark):
    df = spark.createDataFrame([("x", "train"), ("b", "train"), (None, "validation"), ("new", "validation"), ("x", "validation")], "v string, split string")
    got = encode.fit_category(df, "v", F.col("split") == "train").transform(df).toPandas()
    assert got.sort_values(["split", "v"]).v_code.tolist() == [0, 1, -1, 1, -2]
    with pytest.raises(Exception, match="without code"):
        encode.dict_encode(df, "v", encode.vocabulary(df.filter("split = 'train'"), "v")).collect()


def test_fitted_state_ignores_other_rows(spark):
    train = [(float(k), "train") for k in range(9)]
    fits = [encode.fit_medians(spark.createDataFrame(train + extra, "x double, split string"), ["x"], F.col("split") == "train").collect() for extra in ([], [(1e9, "validation")] * 20)]
    assert fits[0] == fits[1]
    empty = spark.createDataFrame([(None, "train")], "x double, split string")
    r = encode.fit_medians(empty, ["x"], F.col("split") == "train").first()
    assert (r["median"], r["all_missing"]) == (0.0, True)


def test_lookup_ties(spark):
    items = spark.createDataFrame([(1, "h", 0, "train"), (2, "h", 1, "train"), (3, "g", 1, "train"), (4, "h", 0, "validation"), (5, "new", 1, "validation")], "id long, hash string, target int, split string")
    got = {r["id"]: (r["predicted"], r["training_hash_found"]) for r in hashes.lookup_predict(items).collect()}
    assert got == {4: (1, True), 5: (1, False)}
    tie = items.filter("id <> 3")
    assert {r["predicted"] for r in hashes.lookup_predict(tie).collect()} == {0}


def test_clean_split_leaves_no_overlap(spark):
    r = np.random.default_rng(2)
    items = spark.createDataFrame(pd.DataFrame({"id": np.arange(300), "hash": r.integers(0, 90, 300).astype(str), "target": r.integers(0, 2, 300), "split": r.choice(["train", "validation", "test"], 300)}))
    clean = hashes.clean_split(items)
    assert clean.count() == 300 and hashes.leaked_hashes(clean).isEmpty()
    assert clean.filter("split = 'test'").count() == items.filter("split = 'test'").count()


def test_png_round_trip():
    m = np.array([[1.0, -0.4], [-0.4, 1.0]])
    pixels = represent.raster(m)
    image = represent.png(pixels)
    assert (represent.pixels_of(image) == pixels).all() and image == represent.png(represent.raster(m.copy()))
    assert represent.model_input(image).shape == (3, 224, 224)


def test_render_once_for_equal_matrices(spark):
    items = spark.createDataFrame([(k, [1.0, 0.5, 0.5, 1.0] if k < 3 else [0.0] * 4) for k in range(5)], "window_id long, corr array<float>")
    got = represent.render(items, "window_id").toPandas()
    assert len(got) == 5 and got.png_sha256.nunique() == 2


def brute_shapley(tree, x):
    """By the definition, over all subsets of features; unknown features follow the cover."""
    n = len(x)

    def value(known, k=0):
        if tree.left[k] < 0:
            return tree.value[k]
        a, b = tree.left[k], tree.right[k]
        if tree.feature[k] in known:
            return value(known, a if x[tree.feature[k]] <= tree.threshold[k] else b)
        return (tree.cover[a] * value(known, a) + tree.cover[b] * value(known, b)) / tree.cover[k]

    phi = np.zeros(n)
    for i in range(n):
        rest = [j for j in range(n) if j != i]
        for mask in range(1 << len(rest)):
            s = {j for b, j in enumerate(rest) if mask >> b & 1}
            phi[i] += math.factorial(len(s)) * math.factorial(n - len(s) - 1) / math.factorial(n) * (value(s | {i}) - value(s))
    return phi


@pytest.fixture(scope="module")
def two_signals(spark):
    r = np.random.default_rng(4)
    x = pd.DataFrame(r.normal(size=(400, 4)), columns=list("abcd")).assign(id=np.arange(400))
    x["target"] = ((x.a > 0) ^ (x.b > 0.5)).astype(int)
    return x, spark.createDataFrame(x)


def test_tree_shap(spark, two_signals):
    x, df = two_signals
    model = forest.fit_forest(df, list("abcd"), "id", trees=5, depth=4).cache()
    rows = x.loc[:6, list("abcd")].to_numpy(float)
    for t in forest.trees_of(model):
        out = np.zeros(rows.shape)
        t.shap(rows, out)
        for row, phi in zip(rows, out, strict=True):
            assert np.allclose(phi, brute_shapley(t, row))
    got = forest.tree_shap(df.limit(20), model, list("abcd"), "id").toPandas()
    assert np.allclose(got.base + got.phi.map(sum), got.probability)
    ranked = select.rank_features(select.importance(forest.tree_shap(df, model, list("abcd"), "id"), list("abcd")), 2).toPandas()
    assert set(ranked[ranked.selected].feature) == {"a", "b"}
    assert np.mean((got.set_index("id").probability > 0.5) == x.set_index("id").target[got.id].astype(bool)) > 0.8


def test_bootstrap_of_each_tree(spark):
    n, trees = 6000, 100
    df = spark.range(n).select(F.col("id"), (F.col("id") % 10 == 0).cast("int").alias("target"), (F.col("id") % 97).cast("double").alias("a"), (F.col("id") % 10).cast("double").alias("b"))
    drawn = forest.bootstrap_draws(df, "id", trees, 0.5, 7).groupBy("tree", "id", "target").count().toPandas()
    sizes = drawn.groupby("tree")["count"].sum()
    assert len(sizes) == trees and abs(sizes - n / 2).max() < 6 * (n / 2) ** 0.5 and sizes.nunique() > 50
    # Poisson draws: as many rows drawn k times as the distribution says, and trees differ.
    for k, p in enumerate(np.exp(-0.5) * 0.5 ** np.arange(4) / [1, 1, 2, 6]):
        seen = trees * n - len(drawn) if k == 0 else (drawn["count"] == k).sum()
        assert abs(seen - trees * n * p) < 6 * (trees * n * p) ** 0.5
    assert len({frozenset(g.id) for _, g in drawn.groupby("tree")}) == trees
    model = forest.fit_forest(df, ["a", "b"], "id", trees=trees, depth=3, draws=n // 2, seed=7).toPandas().set_index("tree")
    assert len(model) == trees
    for tree, group in drawn.groupby("tree"):
        one = model.loc[tree]
        total, ones = group["count"].sum(), group["count"][group.target == 1].sum()
        assert (one.draws, one.rows) == (total, len(group))
        assert (one.weight_0, one.weight_1) == (total / (2 * (total - ones)), total / (2 * ones))  # of this draw, not of all rows
        assert one.value[0] == pytest.approx(0.5) and one.cover[0] == pytest.approx(total)
        assert len(one.left) <= 2 ** 4 - 1
    # The same key draws the same, however rows are dealt.
    again = forest.fit_forest(df.repartition(7).orderBy(F.desc("id")), ["a", "b"], "id", trees=trees, depth=3, draws=n // 2, seed=7).toPandas().set_index("tree")
    assert all(list(model.loc[t].threshold) == list(again.loc[t].threshold) for t in range(trees))


def test_grown_trees_split_where_impurity_falls_most():
    r = np.random.default_rng(5)
    x, y, draws = r.integers(0, 6, (80, 1)).astype(float), r.integers(0, 2, 80), r.integers(1, 4, 80).astype(float)
    tree = forest.grow(x, y, draws, 1, 2, 1, 0)
    w = draws * np.where(y == 1, tree["weight_1"], tree["weight_0"])
    gini = lambda m: 2 * w[m].sum() * (p := (w[m] * y[m]).sum() / w[m].sum()) * (1 - p)
    cuts = [c for c in np.unique(x)[:-1] + 0.5 if min((x[:, 0] <= c).sum(), (x[:, 0] > c).sum()) >= 2]
    best = min(gini(x[:, 0] <= c) + gini(x[:, 0] > c) for c in cuts)
    got = x[:, 0] <= tree["threshold"][0]
    assert gini(got) + gini(~got) == pytest.approx(best)
    assert forest.grow(x, np.zeros(80, int), draws, 5, 2, 1, 0)["left"] == [-1]  # one class: a leaf


def test_labels(spark):
    df = spark.createDataFrame([(" Benign ",), ("MALICIOUS",)], "l string")
    assert [r[0] for r in df.select(prepare.binary_target("l")).collect()] == [0, 1]
    with pytest.raises(Exception, match="unknown label"):
        spark.createDataFrame([("other",)], "l string").select(prepare.binary_target("l")).collect()
    assert profile.find_label_column(["x", "Attack Type"]) == "Attack Type" and profile.find_label_column(["TYPE"]) == "TYPE" and profile.find_label_column(["x"]) is None
    assert profile.find_label_column(["class", "Traffic_Type"]) == "Traffic_Type" and profile.find_label_column(["aTTACK", "tYPE", "Attack_type "]) == "aTTACK"
    assert profile.find_label_column(["LaBEL", "laBel"]) == "laBel" and profile.find_label_column(["type", "attack"]) == "attack" and profile.find_label_column(["class"]) is None
    got = {r["label"]: (r["n"], r["guess"]) for r in profile.label_distribution(spark.createDataFrame([("BENIGN",), ("Benign",), ("",), (None,), ("x",)], "l string"), "l").collect()}
    assert got == {"benign": (2, "benign"), "": (2, "unlabelled"), "x": (1, "malicious")}


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(-1, 1), min_size=1, max_size=30))
def test_band_edges(values):
    bands = [min(20, max(0, math.floor((v + 1) * 10.5))) for v in values]
    assert all(0 <= b <= 20 for b in bands)


def test_classes_of_details(spark):
    rows = [("Malicious", d) for d in ("DDoS", " Okiru ", "Kenjiro", "Hakai", "Hajime", "Muhstik", "Attack", "PartOfAHorizontalPortScan", "C&C", "Okiru-Attack", "C&C-Mirai", "FileDownload", None)]
    df = spark.createDataFrame([*rows, (" benign", "DDoS")], "label string, `detailed-label` string")
    classed = df.withColumn("paper_class", prepare.class_map("label", "`detailed-label`"))
    assert [r["paper_class"] for r in classed.collect()] == ["DDoS", *["Mirai"] * 5, "Web-based", "Recon", "Recon", "", "", "", "", "Benign"]
    assert sum(r["n"] for r in prepare.class_counts(classed).filter("unresolved").collect()) == 4
    assert prepare.require_class(classed, "paper_class", "Mirai").count() == 14
    with pytest.raises(ValueError, match="Mirai"):
        prepare.require_class(classed.filter("paper_class = ''"), "paper_class", "Mirai")
    with pytest.raises(Exception, match="unknown label"):
        spark.createDataFrame([("other", "DDoS")], "l string, d string").select(prepare.class_map("l", "d")).collect()


def test_hash_balanced_epoch(spark):
    rows = [(k, "s%d" % (k % 13 if k % 3 else 100 + k), int(k % 3 == 0), "train") for k in range(200)] + [(900, "v", 1, "validation")]
    rows = [(k, h + str(t), t, s) for k, h, t, s in rows]
    items = spark.createDataFrame(rows, "id long, hash string, target int, split string")
    for epoch in (0, 1):
        got = split.hash_balanced_epoch(items, "id", epoch, batch=6).toPandas().sort_values("place")
        sizes = items.filter("split = 'train'").toPandas().groupby("target").hash.nunique()
        assert got.place.tolist() == list(range(len(got))) and len(got) == 2 * 3 * -(-sizes.max() // 3)
        assert (got.groupby("batch_id").target.agg(["sum", "count"]) == [3, 6]).all().all()  # exact shares in every batch
        large = got[got.target == sizes.idxmax()]
        assert large.hash.value_counts().between(1, 2).all() and large.hash.nunique() == sizes.max()
        small_ = got[got.target == sizes.idxmin()].hash.value_counts()
        assert small_.max() - small_.min() <= 1 and len(small_) == sizes.min()  # whole cycles
        first = {h: min(k for k, g, _, s in rows if g == h and s == "train") for h in got.hash}
        assert (got.hash.map(first) == got.id).all()
    other = split.hash_balanced_epoch(items, "id", 0, batch=6).toPandas().sort_values("place")
    assert other.id.tolist() != got.id.tolist()
    mixed = items.union(spark.createDataFrame([(500, rows[0][1], 1 - rows[0][2], "train")], items.schema))
    with pytest.raises(ValueError, match="both classes"):
        split.hash_balanced_epoch(mixed, "id", 0)


def test_representation_audit(spark):
    r = np.random.default_rng(3)
    kinds = [r.choice([-0.5, 0.0, 1.0], 9).astype(np.float32) for _ in range(4)]
    rows = []
    for k in range(120):
        m = kinds[r.integers(4)].copy()
        m[m == 0] = [0.0, -0.0][k % 2]  # one zero, however it is written
        m[4] = k % 2
        rows.append((k, ["train", "validation", "test"][k % 3], [float(v) for v in m]))
    df = spark.createDataFrame(rows, "window_id long, split string, corr array<float>")
    got = {(x["view"], x["split"]): x.asDict() for x in represent.representation_audit(df, 3, 1).collect()}
    for view in ("full", "neutral"):
        counts = {}
        for _, s, m in rows:
            m = np.array(m).reshape(3, 3)
            if view == "neutral":
                m[1, :] = m[:, 1] = 0
            key = tuple((m + 0.0).ravel())
            counts.setdefault(s, {}).setdefault(key, []).append(1)
        for s in ("train", "validation"):
            sizes = {g: len(n) for g, n in counts[s].items()}
            x = got[view, s]
            assert (x["windows"], x["distinct_hashes"], x["largest_group"]) == (40, len(sizes), max(sizes.values()))
            assert x["matches_train"] == sum(n for g, n in sizes.items() if g in counts["train"])
            assert x["diagonal_one"] + x["diagonal_zero"] == 40
    assert ("full", "test") not in got


def test_membership(spark):
    rows = [(k, ["train", "validation", "test"][min(k % 5, 2)], {0: 1, 1: 0}.get(k % 5, -1), k % 2) for k in range(50)]
    now = spark.createDataFrame(rows, "window_id long, split string, fold int, target int")
    assert all(v == 0 for v in split.reconcile_membership(now, now).first())
    saved = [list(x) for x in rows]
    saved[0][1], saved[5][2], saved[6][3], saved[7][1], saved[10][2] = "test", 0, 1, None, None
    saved = [tuple(x) for x in saved if x[0] != 20] + [rows[3], (99, "train", 2, 1), (None, "train", 2, 1)]
    got = split.reconcile_membership(spark.createDataFrame(saved, now.schema), now).first().asDict()
    assert got == {"only_saved": 2, "only_recomputed": 1, "repeated": 1, "split_differs": 2, "fold_differs": 2, "target_differs": 1, "unknown_split": 1, "fold_against_split": 3}


def test_crossing_rows(spark):
    rows = [(k, k // 5, "train" if k < 10 else "test") for k in range(20)]
    frame = lambda x: spark.createDataFrame(x, "row_idx long, window_id long, split string")
    places = spark.createDataFrame([(k, "train" if k < 2 else "test") for k in range(4)], "window_id long, split string")
    assert tuple(split.crossing_rows(frame(rows), places, 5).first()) == (0, 0, 0)
    broken = [(k, 1 if k == 3 else w, "test" if k == 7 else s) for k, w, s in rows if k != 19]
    assert tuple(split.crossing_rows(frame(broken), places, 5).first()) == (1, 1, 3)


def test_views_and_orders(spark, tmp_path):
    items = spark.createDataFrame([(k, ["train", "test"][k % 2], k % 3 == 0) for k in range(9)], "window_id long, split string, target boolean").withColumn("target", F.col("target").cast("int"))
    moved = sinks.split_view(items, spark.createDataFrame([(1, "train"), (3, "validation")], "window_id long, split string"), "window_id")
    assert {r["window_id"]: r["split"] for r in moved.collect()} == {k: {1: "train", 3: "validation"}.get(k, ["train", "test"][k % 2]) for k in range(9)}
    assert sorted(r["window_id"] for r in split.first_per_class(items, 2, "window_id").collect()) == [0, 1, 2, 3]
    assert {(r["split"], r["target"]): r["window_id"] for r in represent.previews(items).collect()} == {("train", 1): 0, ("test", 0): 1, ("train", 0): 2, ("test", 1): 3}
    assert [r["x"] for r in prepare.sort_flows(spark.createDataFrame([("10", 1, "c"), ("9.5", 3, "b"), ("9.5", 2, "a")], "ts string, source_row int, x string")).collect()] == ["a", "b", "c"]
    history = spark.createDataFrame([(1, 0.5, 0.9), (2, 0.7, 0.8), (3, 0.7, 0.6), (4, 0.7, 0.6)], "epoch int, macro_f1 double, cross_entropy double")
    assert metrics.best_epoch(history).first()["epoch"] == 3
    logits = spark.createDataFrame([(0.0, 0.0), (1.0, 3.0), (700.0, -700.0)], "a double, b double").select(scalar.softmax_positive("a", "b").alias("p")).toPandas().p
    assert np.allclose(logits, [0.5, 1 / (1 + math.exp(-2)), 0.0])
    (tmp_path / "x.json").write_text('{"a": [1,\n 2]}')
    assert flows.read_json(spark, str(tmp_path / "x.json")) == {"a": [1, 2]}
    assert [r[0] for r in spark.createDataFrame([("0" * 64,), ("A" * 64,), ("0" * 63,), (None,)], "h string").select(scalar.is_sha256("h")).collect()] == [True, False, False, False]


def test_filtered_matrix(spark):
    df = spark.createDataFrame([([1.0, 0.5, 0.2, 0.5, 1.0, 0.3, 0.2, 0.3, 1.0],)], "corr array<float>")
    got = df.select(correlate.filtered_matrix("corr", 3, {(0, 2)})).first()[0]
    assert np.allclose(got, [1.0, 0.5, 0.0, 0.5, 1.0, 0.3, 0.0, 0.3, 1.0])


def test_profiles_of_numbers_and_text_agree(spark):
    rows = [(1.5, "1.5"), (None, None), (float("nan"), "nan"), (-2.0, "-2.0"), (3e300, "3e300")]
    df = spark.createDataFrame(rows, "a double, b string")
    for f in (profile.column_profile, profile.missing_profile):
        a, b = (r.asDict() for r in f(df, ["a", "b"]).orderBy("column").collect())
        a.pop("column"), b.pop("column")
        assert a == b
