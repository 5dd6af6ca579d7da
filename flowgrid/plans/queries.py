"""Named queries over the driver's tables: Spark operators, each with its DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgrid.functions.scalar import finite, rounded, to_number
from flowgrid.operators import correlate, encode, hashes, metrics, ordering, prepare, profile, represent, select, split, windows
from flowgrid.plans.frames import DI, EV, EVENT_FEATURES, LI, LINE_FEATURES, LINE_KEYS, OF, doc_items, event_flows, event_split, event_windows, line_flows, line_windows, order_file, order_files, table
from flowgrid.sources import inventory

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


R = lambda x: f"(round({x}, 6) + 0.0)"
_METRICS = ["benign_precision", "benign_recall", "benign_f1", "malicious_precision", "malicious_recall", "malicious_f1", "accuracy", "macro_f1", "weighted_f1", "balanced_accuracy"]


def metric_sql(cells: str, keep: str, absent: str = "0.0") -> str:
    """The metrics of cells tn, fp, fn, tp in SQL; ``absent`` is what a class that isn't there gives."""
    div = lambda a, b: f"coalesce(({a}) / nullif(CAST({b} AS DOUBLE), 0), 0.0)"
    has = lambda s, x: x if absent == "0.0" else f"CASE WHEN ({s}) > 0 THEN {x} END"
    total = lambda x: f"coalesce(({x}) / nullif(CAST(tn + fp + fn + tp AS DOUBLE), 0), {absent})"
    return f"""
    SELECT {keep}, tn, fp, fn, tp, {", ".join(f"{R(m)} AS {m}" for m in _METRICS)} FROM (
      SELECT *, (benign_f1 + malicious_f1) / 2 AS macro_f1, {total("coalesce(benign_f1, 0) * (tn + fp) + coalesce(malicious_f1, 0) * (fn + tp)")} AS weighted_f1,
             (benign_recall + malicious_recall) / 2 AS balanced_accuracy, {total("tn + tp")} AS accuracy FROM (
        SELECT *, {has("tn + fp", div("2 * benign_precision * benign_recall", "benign_precision + benign_recall"))} AS benign_f1,
               {has("fn + tp", div("2 * malicious_precision * malicious_recall", "malicious_precision + malicious_recall"))} AS malicious_f1 FROM (
          SELECT *, {has("tn + fp", div("tn", "tn + fn"))} AS benign_precision, {has("tn + fp", div("tn", "tn + fp"))} AS benign_recall,
                 {has("fn + tp", div("tp", "tp + fp"))} AS malicious_precision, {has("fn + tp", div("tp", "fn + tp"))} AS malicious_recall
          FROM ({cells}))))"""


CELLS = "count(*) FILTER (target = 0 AND predicted = 0) AS tn, count(*) FILTER (target = 0 AND predicted = 1) AS fp, count(*) FILTER (target = 1 AND predicted = 0) AS fn, count(*) FILTER (target = 1 AND predicted = 1) AS tp"


def _metrics_rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, "tn", "fp", "fn", "tp", *[rounded(m).alias(m) for m in _METRICS])


# --- projections, labels, profiles ---------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, lower(l_returnflag) AS flag, l_returnflag AS flag_original FROM lineitem")
def project_drop(spark: SparkSession, sf: str) -> DataFrame:
    kept = table(spark, sf, "lineitem").drop("l_partkey", "l_suppkey", "l_discount", "l_tax", "l_linestatus", "l_shipdate")
    return kept.withColumns({"flag": F.lower("l_returnflag"), "flag_original": F.col("l_returnflag")}).drop("l_returnflag")


@query("SELECT event_id, CAST(event_type = 'error' AS INTEGER) AS target FROM events")
def binary_target(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("event_type") == "error", " Malicious ").otherwise("BENIGN")
    return table(spark, sf, "events").select("event_id", prepare.binary_target(label).alias("target"))


_DETAILS = ["DDoS", "Okiru", "Kenjiro", "Hakai", "Hajime", "Muhstik", "Attack", "PartOfAHorizontalPortScan", "C&C", "Okiru-Attack", "C&C-Mirai", "FileDownload", "-"]


@query(f"""SELECT event_id, CASE WHEN event_type = 'view' THEN 'Benign' ELSE CASE event_id % {len(_DETAILS)} WHEN 0 THEN 'DDoS' WHEN 1 THEN 'Mirai' WHEN 2 THEN 'Mirai' WHEN 3 THEN 'Mirai' WHEN 4 THEN 'Mirai' WHEN 5 THEN 'Mirai' WHEN 6 THEN 'Web-based' WHEN 7 THEN 'Recon' WHEN 8 THEN 'Recon' ELSE '' END END AS paper_class FROM events""")
def class_map(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("event_type") == "view", " Benign").otherwise("MALICIOUS")
    detail = F.element_at(F.array(*map(F.lit, _DETAILS)), (F.col("event_id") % len(_DETAILS) + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", prepare.class_map(label, detail).alias("paper_class"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 20")
def label_counts(spark: SparkSession, sf: str) -> DataFrame:
    return profile.label_counts(table(spark, sf, "events"), "event_type").orderBy(F.desc("n"), "event_type").limit(20)


_TOKENS = {"en": " Normal Traffic", "de": "benign_traffic", "fr": "BenignTraffic", "es": "background"}


@query(f"""WITH t AS (SELECT CASE lang WHEN 'en' THEN 'normal traffic' WHEN 'de' THEN 'benign_traffic' WHEN 'fr' THEN 'benigntraffic' WHEN 'es' THEN 'background' ELSE '' END AS label FROM documents)
SELECT label, count(*) AS n, {R('count(*) / CAST(sum(count(*)) OVER () AS DOUBLE)')} AS fraction, CASE WHEN label = '' THEN 'unlabelled' WHEN label = 'background' THEN 'malicious' ELSE 'benign' END AS guess FROM t GROUP BY label""")
def label_fraction(spark: SparkSession, sf: str) -> DataFrame:
    label = F.lit("")
    for lang, token in _TOKENS.items():
        label = F.when(F.col("lang") == lang, token).otherwise(label)
    return profile.label_distribution(table(spark, sf, "documents").select(label.alias("label")), "label").withColumn("fraction", rounded("fraction"))


_MARKED = "CASE event_id % 7 WHEN 0 THEN '-' WHEN 1 THEN ' NaN ' WHEN 2 THEN '(empty)' WHEN 3 THEN '' ELSE event_type END"


@query(f"""WITH m AS (SELECT {_MARKED} AS event_type, props, 'x' AS fixed FROM events)
SELECT 'event_type' AS "column", count(*) FILTER (lower(trim(event_type)) IN ('', '-', 'nan', 'null', 'none')) AS missing, count(*) FILTER (event_type = '(empty)') AS empty_sets, min(event_type) = max(event_type) AS constant FROM m
UNION ALL SELECT 'props', count(*) FILTER (lower(trim(props)) IN ('', '-', 'nan', 'null', 'none')), count(*) FILTER (props = '(empty)'), min(props) = max(props) FROM m
UNION ALL SELECT 'fixed', 0, 0, true FROM m LIMIT 3""".replace("UNION ALL SELECT 'fixed', 0, 0, true FROM m LIMIT 3", "UNION ALL SELECT 'fixed', 0, 0, true"))
def missing_profile(spark: SparkSession, sf: str) -> DataFrame:
    marked = table(spark, sf, "events").select(F.expr(_MARKED).alias("event_type"), "props", F.lit("x").alias("fixed"))
    return profile.missing_profile(marked, ["event_type", "props", "fixed"])


_PROFILED = ["l_quantity", "l_linenumber", "l_returnflag"]


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) AS rows_seen, CAST(0 AS BIGINT) AS missing, count(TRY_CAST({c} AS DOUBLE)) AS "numeric", count(*) - count(TRY_CAST({c} AS DOUBLE)) AS not_numeric, min(TRY_CAST({c} AS DOUBLE)) AS least, max(TRY_CAST({c} AS DOUBLE)) AS greatest, count(TRY_CAST({c} AS DOUBLE)) / CAST(count(*) AS DOUBLE) AS numeric_fraction, count(TRY_CAST({c} AS DOUBLE)) / CAST(count(*) AS DOUBLE) >= 0.999 AS likely_numeric FROM lineitem""" for c in _PROFILED))
def column_profile(spark: SparkSession, sf: str) -> DataFrame:
    return profile.column_profile(table(spark, sf, "lineitem"), _PROFILED)


@query("SELECT event_id, CASE WHEN regexp_matches(part, '^[0-9]+$') THEN CAST(part AS DOUBLE) END AS x, regexp_matches(part, '^[0-9]+$') AS ok FROM (SELECT event_id, substr(props, 7, 1 + CAST(event_id % 3 AS INTEGER)) AS part FROM events)")
def try_numeric(spark: SparkSession, sf: str) -> DataFrame:
    part = F.substring(F.col("props"), F.lit(7), 1 + (F.col("event_id") % 3).cast("int"))
    return table(spark, sf, "events").select("event_id", to_number(part).alias("x"), finite(to_number(part)).alias("ok"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", min({c}) = max({c}) AS constant FROM n" for c in ("n_nationkey", "n_name", "n_regionkey", "same")).replace("SELECT", "WITH n AS (SELECT *, 7 AS same FROM nation) SELECT", 1))
def constant_columns(spark: SparkSession, sf: str) -> DataFrame:
    return profile.constant_columns(table(spark, sf, "nation").withColumn("same", F.lit(7)), ["n_nationkey", "n_name", "n_regionkey", "same"])


@query(f"WITH {EV} SELECT event_type, {R('min(ts)')} AS ts_min, {R('max(ts)')} AS ts_max, CAST(0 AS BIGINT) AS ts_invalid FROM ev GROUP BY event_type")
def ts_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return profile.bounds(event_flows(spark, sf), "ts", "event_type").withColumns({"ts_min": rounded("ts_min"), "ts_max": rounded("ts_max")})


@query("""WITH s AS (SELECT l_returnflag, l_shipdate, lag(l_shipdate) OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS b FROM lineitem)
SELECT l_returnflag, count(*) FILTER (l_shipdate < b) AS backward_steps, count(*) FILTER (l_shipdate = b) AS equal_steps FROM s GROUP BY l_returnflag""")
def backward_steps(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.order_report(table(spark, sf, "lineitem"), "l_shipdate", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"], "l_returnflag")


@query("SELECT CAST(sum(c - 1) AS BIGINT) AS equal_pairs FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_shipdate)")
def equal_ts_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.equal_pairs(table(spark, sf, "lineitem"), "l_shipdate")


@query(f"WITH {EV} SELECT source_row, row_idx FROM ev")
def global_sort_rank(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.ordered_index(event_flows(spark, sf), ["ts", "source_row"])[0].select("source_row", "row_idx")


@query("SELECT o_orderkey, o_totalprice, o_orderkey % 2 AS source FROM orders")
def union_blocks(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", (F.col("o_orderkey") % 2).alias("source"))
    return prepare.union_blocks([o.filter("source = 0"), o.filter("source = 1")], "source")


@query(f"WITH {EV} SELECT source_row, event_type FROM ev WHERE row_idx < 10000")
def prefix_block(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.ordered_index(event_flows(spark, sf), ["ts", "source_row"])[0].filter("row_idx < 10000").select("source_row", "event_type")


# --- dictionaries and fitted preprocessing -------------------------------------------------------


@query("SELECT p_brand AS value, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM part)")
def vocab(spark: SparkSession, sf: str) -> DataFrame:
    return encode.vocabulary(table(spark, sf, "part"), "p_brand")


@query("SELECT p_partkey, p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS p_brand_code FROM part")
def dict_encode(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_brand")
    return encode.dict_encode(p, "p_brand", encode.vocabulary(p, "p_brand"))


_HOLES = "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS l_quantity"


def _holed(spark: SparkSession, sf: str) -> DataFrame:
    return line_flows(spark, sf).withColumn("l_quantity", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")))


@query(f"""WITH {LI}, h AS (SELECT {_HOLES}, l_extendedprice FROM li WHERE split = 'train')
SELECT 'l_quantity' AS feature, coalesce(quantile_cont(l_quantity, 0.5), 0) AS median, count(*) - count(l_quantity) AS training_missing, count(l_quantity) = 0 AS all_missing FROM h
UNION ALL SELECT 'l_extendedprice', {R('quantile_cont(l_extendedprice, 0.5)')}, count(*) - count(l_extendedprice), false FROM h""")
def fit_medians(spark: SparkSession, sf: str) -> DataFrame:
    return encode.fit_medians(_holed(spark, sf), ["l_quantity", "l_extendedprice"], F.col("split") == "train").withColumn("median", rounded("median"))


@query(f"""WITH {LI}, h AS (SELECT l_orderkey, l_linenumber, split, l_extendedprice, {_HOLES} FROM li)
SELECT l_orderkey, l_linenumber, l_extendedprice, coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM h WHERE split = 'train')) AS l_quantity FROM h""")
def impute(spark: SparkSession, sf: str) -> DataFrame:
    h = _holed(spark, sf)
    return encode.impute(h, encode.fit_medians(h, ["l_quantity"], F.col("split") == "train")).select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")


_DOC_SPLIT = "CASE doc_id % 5 WHEN 0 THEN 'validation' WHEN 1 THEN 'test' ELSE 'train' END"
_SOURCE = "CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 5 < 2 AND doc_id % 7 = 0 THEN 'new' ELSE source END"


@query(f"""WITH d AS (SELECT doc_id, {_DOC_SPLIT} AS split, {_SOURCE} AS source FROM documents),
v AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS code FROM (SELECT DISTINCT source FROM d WHERE split = 'train' AND source IS NOT NULL)),
e AS (SELECT split, CASE WHEN d.source IS NULL THEN -2 ELSE coalesce(v.code, -1) END AS code FROM d LEFT JOIN v USING (source))
SELECT split, count(*) FILTER (code = -1) AS unknown, count(*) FILTER (code = -2) AS missing, count(*) AS rows FROM e GROUP BY split""")
def reencode_unknown(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.expr(_DOC_SPLIT).alias("split"), F.expr(_SOURCE).alias("source"))
    coded = encode.fit_category(d, "source", F.col("split") == "train").transform(d)
    return encode.unknown_counts(coded, "source_code", "split")


@query(f"WITH {LI} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, min({f}) AS least, max({f}) AS greatest FROM li WHERE split = 'train'" for f in LINE_FEATURES))
def train_extrema(spark: SparkSession, sf: str) -> DataFrame:
    return encode.fit_extrema(line_flows(spark, sf), LINE_FEATURES, F.col("split") == "train")


def _narrow_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Extrema of a part of the training rows, so that some values lie outside."""
    return encode.fit_extrema(line_flows(spark, sf), LINE_FEATURES, (F.col("split") == "train") & (F.col("l_linenumber") == 1) & (F.col("l_quantity") < 45))


_FIT = f"fit AS (SELECT {', '.join(f'min({f}) AS a_{f}, max({f}) AS b_{f}' for f in LINE_FEATURES)} FROM li WHERE split = 'train' AND l_linenumber = 1 AND l_quantity < 45), nrm AS (SELECT l_orderkey, l_linenumber, split, {', '.join(f'CASE WHEN b_{f} > a_{f} THEN 2.0 * ({f} - a_{f}) / (b_{f} - a_{f}) - 1.0 ELSE 0.0 END AS {f}' for f in LINE_FEATURES)} FROM li, fit)"


@query(f"WITH {LI}, {_FIT} SELECT l_orderkey, l_linenumber, {', '.join(f'{R(f)} AS {f}' for f in LINE_FEATURES)} FROM nrm")
def minmax_norm(spark: SparkSession, sf: str) -> DataFrame:
    return encode.normalise(line_flows(spark, sf), _narrow_fit(spark, sf)).select("l_orderkey", "l_linenumber", *[rounded(f).alias(f) for f in LINE_FEATURES])


@query(f"WITH {LI}, {_FIT} SELECT split, {', '.join(f'count(*) FILTER (abs({f}) > 1 + 1e-10) AS {f}' for f in LINE_FEATURES)} FROM nrm GROUP BY split")
def out_of_range(spark: SparkSession, sf: str) -> DataFrame:
    return encode.out_of_range(encode.normalise(line_flows(spark, sf), _narrow_fit(spark, sf)), LINE_FEATURES, "split")


# --- windows and splits --------------------------------------------------------------------------


@query(f"WITH {EV} SELECT source_row, window_id FROM win")
def count_windows(spark: SparkSession, sf: str) -> DataFrame:
    return event_windows(spark, sf).select("source_row", "window_id")


_MANIFEST = ["window_id", "start_index", "stop_index_exclusive", "target", "benign_rows", "malicious_rows", "first_source_row", "last_source_row"]


@query(f"WITH {EV} SELECT {', '.join(_MANIFEST)}, {R('start_ts')} AS start_ts, {R('end_ts')} AS end_ts, {R('target_purity')} AS target_purity, round(duration_seconds, 3) AS duration_seconds FROM manifest")
def window_manifest(spark: SparkSession, sf: str) -> DataFrame:
    m = windows.window_manifest(event_windows(spark, sf))
    return m.select(*_MANIFEST, *[rounded(c).alias(c) for c in ("start_ts", "end_ts", "target_purity")], F.round("duration_seconds", 3).alias("duration_seconds"))


@query(f"WITH {EV} SELECT count(*) FILTER (target_purity < 1) AS mixed_windows, count(*) AS windows FROM manifest")
def mixed_windows(spark: SparkSession, sf: str) -> DataFrame:
    return windows.mixed_windows(windows.window_manifest(event_windows(spark, sf)))


@query(f"WITH {EV} SELECT window_id, target, split, fold FROM split")
def strat_split(spark: SparkSession, sf: str) -> DataFrame:
    return event_split(spark, sf).select("window_id", "target", "split", "fold")


@query(f"WITH {EV} SELECT split, count(*) FILTER (target = 0) AS benign, count(*) FILTER (target = 1) AS malicious FROM split GROUP BY split")
def split_counts(spark: SparkSession, sf: str) -> DataFrame:
    return split.counts_by_split(event_split(spark, sf))


@query(f"WITH {EV} SELECT window_id, target FROM placed WHERE pos < 12")
def sample_per_class(spark: SparkSession, sf: str) -> DataFrame:
    return split.sample_per_class(windows.window_manifest(event_windows(spark, sf)), 12, "window_id").select("window_id", "target")


@query(f"""WITH {DI}, b AS (SELECT target, count(*) AS n FROM di GROUP BY target), w AS (SELECT CAST(ceil(max(n) / 4.0) * 4 AS BIGINT) AS w FROM b),
x AS (SELECT doc_id, di.target, unnest(range((w.w + b.n - 1) // b.n)) AS cycle FROM di JOIN b USING (target), w),
o AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY cycle, sha256('42:3:' || cycle || ':' || doc_id), doc_id) - 1 AS pos FROM x)
SELECT pos // 4 AS batch_id, target, doc_id FROM o, w WHERE pos < w.w""")
def balanced_epoch(spark: SparkSession, sf: str) -> DataFrame:
    return split.balanced_epoch(doc_items(spark, sf), "doc_id", 3)


# An epoch over the distinct texts of one class each; a text that has both can't stand for either.
@query(f"""WITH {DI}, pure AS (SELECT hash FROM di WHERE split = 'train' GROUP BY hash HAVING count(DISTINCT target) = 1),
rep AS (SELECT target, hash, min(doc_id) AS doc_id FROM di JOIN pure USING (hash) WHERE split = 'train' GROUP BY target, hash),
b AS (SELECT target, count(*) AS n FROM rep GROUP BY target), w AS (SELECT CAST(ceil(max(n) / 4.0) * 4 AS BIGINT) AS w FROM b),
x AS (SELECT doc_id, hash, rep.target, unnest(range((w.w + b.n - 1) // b.n)) AS cycle FROM rep JOIN b USING (target), w),
o AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY cycle, sha256('42:5:' || cycle || ':' || doc_id), doc_id) - 1 AS pos FROM x),
p AS (SELECT pos // 4 AS batch_id, target, hash, doc_id FROM o, w WHERE pos < w.w),
s AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY sha256('42:5:batch:' || batch_id || ':' || doc_id), doc_id) - 1 AS slot FROM p)
SELECT batch_id * 8 + slot AS place, batch_id, slot, target, hash, doc_id FROM s""")
def hash_balanced_epoch(spark: SparkSession, sf: str) -> DataFrame:
    items = doc_items(spark, sf).filter("split = 'train'")
    pure = items.groupBy("hash").agg(F.count_distinct("target").alias("n")).filter("n = 1").select("hash")
    return split.hash_balanced_epoch(items.join(pure, "hash", "left_semi"), "doc_id", 5)


@query(f"WITH {DI} SELECT doc_id, row_number() OVER (ORDER BY sha256('42:2:' || doc_id), doc_id) - 1 AS place FROM di WHERE split = 'train'")
def epoch_order(spark: SparkSession, sf: str) -> DataFrame:
    return split.epoch_order(doc_items(spark, sf).filter("split = 'train'").select("doc_id"), "doc_id", 2)


# Saved memberships with planted differences of every kind, against those recomputed from the events.
_SAVED = """saved AS (
  SELECT CASE WHEN window_id % 41 = 3 THEN -window_id ELSE window_id END AS window_id, CASE WHEN window_id % 23 = 1 THEN 'train' WHEN window_id % 29 = 2 THEN 'unused' WHEN window_id % 31 = 4 THEN NULL ELSE split END AS split,
         CASE WHEN window_id % 19 = 5 THEN fold + 1 WHEN window_id % 37 = 6 THEN NULL ELSE fold END AS fold, CASE WHEN window_id % 17 = 7 THEN 1 - target ELSE target END AS target
  FROM split WHERE window_id % 43 <> 8 UNION ALL SELECT window_id, split, fold, target FROM split WHERE window_id % 47 = 9)"""


@query(f"""WITH {EV}, {_SAVED}, s AS (SELECT window_id AS k, count(*) AS n_s, min(split) AS split_s, min(fold) AS fold_s, min(target) AS target_s FROM saved GROUP BY 1),
r AS (SELECT window_id AS k, count(*) AS n_r, min(split) AS split_r, min(fold) AS fold_r, min(target) AS target_r FROM split GROUP BY 1), j AS (SELECT * FROM s FULL JOIN r USING (k))
SELECT count(*) FILTER (n_r IS NULL) AS only_saved, count(*) FILTER (n_s IS NULL) AS only_recomputed, count(*) FILTER (coalesce(n_s, 0) > 1 OR coalesce(n_r, 0) > 1) AS repeated,
{", ".join(f"count(*) FILTER (n_s IS NOT NULL AND n_r IS NOT NULL AND {c}_s IS DISTINCT FROM {c}_r) AS {c}_differs" for c in ("split", "fold", "target"))},
count(*) FILTER (n_s IS NOT NULL AND coalesce(split_s, '') NOT IN ('train', 'validation', 'test')) AS unknown_split,
count(*) FILTER (split_s IN ('train', 'validation', 'test') AND NOT coalesce(CASE split_s WHEN 'test' THEN fold_s = -1 WHEN 'validation' THEN fold_s = 0 ELSE fold_s BETWEEN 1 AND 4 END, false)) AS fold_against_split FROM j""")
def membership_differences(spark: SparkSession, sf: str) -> DataFrame:
    now = event_split(spark, sf).select("window_id", "split", "fold", "target")
    k = F.col("window_id")
    saved = now.filter(k % 43 != 8).select(
        F.when(k % 41 == 3, -k).otherwise(k).alias("window_id"),
        F.when(k % 23 == 1, "train").when(k % 29 == 2, "unused").when(k % 31 == 4, F.lit(None)).otherwise(F.col("split")).alias("split"),
        F.when(k % 19 == 5, F.col("fold") + 1).when(k % 37 == 6, F.lit(None)).otherwise(F.col("fold")).alias("fold"),
        F.when(k % 17 == 7, 1 - F.col("target")).otherwise(F.col("target")).alias("target"),
    )
    return split.reconcile_membership(saved.unionByName(now.filter(k % 47 == 9)), now)


@query(f"WITH {DI} SELECT target, {R('(SELECT count(*) FROM di) / (2.0 * count(*))')} AS weight FROM di GROUP BY target")
def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    return split.class_weights(doc_items(spark, sf)).withColumn("weight", rounded("weight"))


# --- correlations --------------------------------------------------------------------------------


def _pearson_sql(features: list[str], source: str) -> str:
    pairs = correlate.entry_pairs(features)
    moments = ", ".join([f"stddev_pop({f}) AS s_{f}" for f in features] + [f"covar_pop({a}, {b}) AS k_{a}_{b}" for a, b in pairs])
    corr = ", ".join(f"CASE WHEN s_{a} > 1e-12 AND s_{b} > 1e-12 THEN greatest(-1.0, least(1.0, k_{a}_{b} / (s_{a} * s_{b}))) ELSE 0.0 END AS corr_{a}_{b}" for a, b in pairs)
    active = ", ".join(f"s_{f} > 1e-12 AS active_{f}" for f in features)
    return f"mom AS (SELECT window_id, {moments} FROM {source} GROUP BY window_id), cor AS (SELECT window_id, {corr}, {active}, {' + '.join(f'CAST(s_{f} > 1e-12 AS INTEGER)' for f in features)} AS varying_features FROM mom)"


_EV_ENTRIES = [f"corr_{a}_{b}" for a, b in correlate.entry_pairs(EVENT_FEATURES)]
_LI_ENTRIES = [f"corr_{a}_{b}" for a, b in correlate.entry_pairs(LINE_FEATURES)]


@query(f"WITH {EV}, {_pearson_sql(EVENT_FEATURES, 'win')} SELECT window_id, varying_features, {', '.join(f'{R(e)} AS {e}' for e in _EV_ENTRIES)} FROM cor")
def window_pearson(spark: SparkSession, sf: str) -> DataFrame:
    p = correlate.window_pearson(event_windows(spark, sf), EVENT_FEATURES)
    return p.select("window_id", "varying_features", *[rounded(e).alias(e) for e in _EV_ENTRIES])


@query(f"WITH {LI}, {_pearson_sql(LINE_FEATURES, 'lwin')} SELECT {', '.join(f'count(*) FILTER (active_{f}) AS {f}' for f in LINE_FEATURES)}, count(*) FILTER (varying_features < 2) AS low_activity, count(*) AS windows FROM cor")
def activity(spark: SparkSession, sf: str) -> DataFrame:
    p = correlate.window_pearson(line_windows(spark, sf), LINE_FEATURES)
    return p.agg(*[F.count_if(f"active_{f}").alias(f) for f in LINE_FEATURES], F.count_if(F.col("varying_features") < 2).alias("low_activity"), F.count("*").alias("windows"))


def _line_correlations(spark: SparkSession, sf: str) -> DataFrame:
    """Training windows' entries, stored as single precision."""
    p = correlate.window_pearson(line_windows(spark, sf), LINE_FEATURES).filter(F.col("window_id") % 5 > 1)
    return p.select("window_id", *[F.round(e, 9).alias(e) for e in _LI_ENTRIES])


@query(f"WITH {LI}, {_pearson_sql(LINE_FEATURES, 'lwin')}, tr AS (SELECT {', '.join(f'round({e}, 9) AS {e}' for e in _LI_ENTRIES)} FROM cor WHERE window_id % 5 > 1) " + " UNION ALL ".join(f"SELECT '{a}' AS entry_i, '{b}' AS entry_j, {R(f'covar_pop({a}, {b})')} AS covariance FROM tr" for i, a in enumerate(_LI_ENTRIES) for b in _LI_ENTRIES[i:]))
def entry_covariance(spark: SparkSession, sf: str) -> DataFrame:
    return correlate.entry_covariance(_line_correlations(spark, sf), _LI_ENTRIES).withColumn("covariance", rounded("covariance"))


# Entries one after another by falling variance: the recursion carries those that were kept.
_ALL_COV = " UNION ALL ".join(f"SELECT '{a}' AS i, '{b}' AS j, {k} AS idx, covar_pop({a}, {b}) AS c FROM tr" for k, a in enumerate(_LI_ENTRIES) for b in _LI_ENTRIES)


@query(f"""WITH RECURSIVE {LI}, {_pearson_sql(LINE_FEATURES, 'lwin')}, tr AS (SELECT {', '.join(f'round({e}, 9) AS {e}' for e in _LI_ENTRIES)} FROM cor WHERE window_id % 5 > 1), cov AS ({_ALL_COV}),
ranked AS (SELECT i AS entry, c AS variance, row_number() OVER (ORDER BY c DESC, idx) AS r FROM cov WHERE i = j),
m AS (SELECT map_from_entries(list((x.i || '|' || x.j, least(1.0, abs(x.c / sqrt(a.c * b.c)))))) AS m FROM cov x JOIN cov a ON a.i = x.i AND a.j = x.i JOIN cov b ON b.i = x.j AND b.j = x.j WHERE a.c > 0 AND b.c > 0),
walk AS (
  SELECT CAST(0 AS BIGINT) AS r, CAST([] AS VARCHAR[]) AS kept, CAST(NULL AS VARCHAR) AS entry, CAST(NULL AS DOUBLE) AS variance, CAST(NULL AS VARCHAR) AS decision, CAST(NULL AS VARCHAR) AS redundant_with
  UNION ALL
  SELECT r, CASE WHEN variance > 1e-8 AND partner IS NULL THEN list_append(kept, entry) ELSE kept END, entry, variance, CASE WHEN variance <= 1e-8 THEN 'low_variance' WHEN partner IS NULL THEN 'retained' ELSE 'redundant' END, CASE WHEN variance > 1e-8 THEN partner END
  FROM (SELECT o.r AS r, w.kept AS kept, o.entry AS entry, o.variance AS variance, list_filter(w.kept, lambda k: m.m[o.entry || '|' || k] >= 0.999)[1] AS partner FROM walk w JOIN ranked o ON o.r = w.r + 1 CROSS JOIN m)
)
SELECT entry, {R('variance')} AS variance, decision, redundant_with FROM walk WHERE r > 0""")
def entry_filter(spark: SparkSession, sf: str) -> DataFrame:
    return correlate.entry_filter(correlate.entry_covariance(_line_correlations(spark, sf), _LI_ENTRIES), _LI_ENTRIES).withColumn("variance", rounded("variance"))


_BANDS = "concat_ws(',', " + ", ".join(f"CAST(least(20, greatest(0, CAST(floor((round({e}, 9) + 1.0) * 10.5) AS INTEGER))) AS VARCHAR)" for e in _EV_ENTRIES) + ")"
_HASHED = f"WITH {EV}, {_pearson_sql(EVENT_FEATURES, 'win')}, hs AS (SELECT window_id, s.split, s.target, sha256({_BANDS}) AS hash FROM cor JOIN split s USING (window_id))"


def _band_items(spark: SparkSession, sf: str) -> DataFrame:
    p = correlate.window_pearson(event_windows(spark, sf), EVENT_FEATURES).select("window_id", represent.band_hash(_EV_ENTRIES).alias("hash"))
    return p.join(event_split(spark, sf).select("window_id", "split", "target"), "window_id")


@query(f"{_HASHED} SELECT window_id, split, target, hash FROM hs")
def band_hash(spark: SparkSession, sf: str) -> DataFrame:
    return _band_items(spark, sf).select("window_id", "split", "target", "hash")


@query(f"{_HASHED} SELECT split, count(*) AS distinct_hashes, CAST(sum(n) AS BIGINT) AS items, max(n) AS largest, {R('count(*) / CAST(sum(n) AS DOUBLE)')} AS distinct_ratio FROM (SELECT split, hash, count(*) AS n FROM hs GROUP BY split, hash) GROUP BY split")
def hash_repetition(spark: SparkSession, sf: str) -> DataFrame:
    return represent.hash_repetition(_band_items(spark, sf)).withColumn("distinct_ratio", rounded("distinct_ratio"))


@query()
def contour_png(spark: SparkSession, sf: str) -> DataFrame:
    corr = correlate.pearson_arrow(event_windows(spark, sf), EVENT_FEATURES)
    names, images = represent.render_distinct(corr, "window_id")
    return names.join(images.select("digest", "png_sha256", F.octet_length("png").alias("bytes")), "digest").drop("digest")  # names alone meet


@query(f"""WITH {LI}, w AS (SELECT CASE window_id % 5 WHEN 0 THEN 'validation' WHEN 1 THEN 'test' ELSE 'train' END AS split, window_id, {', '.join(f'min({f}) AS a_{f}, max({f}) AS b_{f}, stddev_pop({f}) AS s_{f}' for f in LINE_FEATURES)} FROM lwin GROUP BY window_id) """
       + " UNION ALL ".join(f"SELECT split, '{f}' AS feature, count(*) AS windows, count(*) FILTER (s_{f} > 1e-12) AS varying_windows, {R(f'count(*) FILTER (s_{f} > 1e-12) / CAST(count(*) AS DOUBLE)')} AS varying_fraction, min(a_{f}) AS least, max(b_{f}) AS greatest FROM w GROUP BY split" for f in LINE_FEATURES))
def feature_audit(spark: SparkSession, sf: str) -> DataFrame:
    w = line_windows(spark, sf).groupBy("window_id").agg(*[F.struct(F.min(f).alias("a"), F.max(f).alias("b"), F.stddev_pop(f).alias("s")).alias(f) for f in LINE_FEATURES])
    k = F.col("window_id") % 5
    long = w.select(F.when(k == 0, "validation").when(k == 1, "test").otherwise("train").alias("split"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("m")) for f in LINE_FEATURES])).alias("x")).select("split", "x.feature", "x.m.*")
    varying = F.count_if(F.col("s") > correlate.TOLERANCE)
    return long.groupBy("split", "feature").agg(F.count("*").alias("windows"), varying.alias("varying_windows"), rounded(varying / F.count("*")).alias("varying_fraction"), F.min("a").alias("least"), F.max("b").alias("greatest"))


# --- hashes --------------------------------------------------------------------------------------


@query(f"WITH {DI} SELECT * FROM hg")
def hash_groups(spark: SparkSession, sf: str) -> DataFrame:
    return hashes.hash_groups(doc_items(spark, sf))


_HG3 = "g3 AS (SELECT hash, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS validation, count(*) FILTER (split = 'test') AS test, CAST(bit_or(1 << target) AS INTEGER) AS class_mask FROM di GROUP BY hash)"


@query(f"WITH {DI}, {_HG3} SELECT * FROM g3")
def hash_groups3(spark: SparkSession, sf: str) -> DataFrame:
    return hashes.hash_groups3(doc_items(spark, sf))


@query(f"WITH {DI}, {_HG3} SELECT count(*) AS distinct_hashes, count(*) FILTER (class_mask = 3) AS mixed_label_hashes, max(train + validation + test) AS largest_group, CAST(coalesce(sum(CASE WHEN train + validation + test > 1 THEN train + validation + test END), 0) AS BIGINT) AS duplicated_items, CAST(coalesce(sum(CASE WHEN train > 0 THEN test END), 0) AS BIGINT) AS test_in_train FROM g3")
def hash_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return hashes.distinct_summary(hashes.hash_groups3(doc_items(spark, sf)))


_IN_TRAIN = "hash IN (SELECT hash FROM di WHERE split = 'train')"


@query(f"WITH {DI} SELECT doc_id, hash, target FROM di WHERE split = 'validation' AND {_IN_TRAIN}")
def seen_semi(spark: SparkSession, sf: str) -> DataFrame:
    return hashes.seen_in_train(doc_items(spark, sf)).select("doc_id", "hash", "target")


@query(f"WITH {DI} SELECT doc_id, hash, target FROM di WHERE split = 'validation' AND NOT {_IN_TRAIN}")
def novel_anti(spark: SparkSession, sf: str) -> DataFrame:
    return hashes.novel_in_validation(doc_items(spark, sf)).select("doc_id", "hash", "target")


@query(f"WITH {DI} SELECT doc_id, CASE WHEN split = 'validation' AND {_IN_TRAIN} THEN 'train' ELSE split END AS split FROM di")
def clean_split(spark: SparkSession, sf: str) -> DataFrame:
    return hashes.clean_split(doc_items(spark, sf)).select("doc_id", "split")


@query(f"""WITH {DI}, o AS (SELECT train_benign + train_malicious > 0 AS seen, * FROM hg), s AS (SELECT CAST(coalesce(sum(validation_benign) FILTER (seen), 0) AS BIGINT) AS seen_benign, CAST(coalesce(sum(validation_malicious) FILTER (seen), 0) AS BIGINT) AS seen_malicious, CAST(coalesce(sum(validation_benign) FILTER (NOT seen), 0) AS BIGINT) AS unseen_benign, CAST(coalesce(sum(validation_malicious) FILTER (NOT seen), 0) AS BIGINT) AS unseen_malicious, count(*) FILTER (seen AND validation_benign + validation_malicious > 0) AS shared_hashes FROM o)
SELECT *, {R('(seen_benign + seen_malicious) / CAST(seen_benign + seen_malicious + unseen_benign + unseen_malicious AS DOUBLE)')} AS seen_fraction FROM s""")
def overlap_stats(spark: SparkSession, sf: str) -> DataFrame:
    return hashes.overlap_stats(doc_items(spark, sf)).withColumn("seen_fraction", rounded("seen_fraction"))


@query("""WITH k AS (SELECT concat(d.lang, '-', d.n_chars // 500) AS hash, d.doc_id % 5 AS part, l.quality = 0 AS bad FROM documents d JOIN labels l USING (doc_id) WHERE d.doc_id % 5 <> 1),
g AS (SELECT hash, count(*) FILTER (part > 1 AND NOT bad) AS train_benign, count(*) FILTER (part > 1 AND bad) AS train_malicious, count(*) FILTER (part = 0 AND NOT bad) AS validation_benign, count(*) FILTER (part = 0 AND bad) AS validation_malicious FROM k GROUP BY hash)
SELECT *, least(validation_benign, validation_malicious) AS minimum_errors FROM g WHERE train_benign + validation_benign > 0 AND train_malicious + validation_malicious > 0""")
def conflicts(spark: SparkSession, sf: str) -> DataFrame:
    coarse = F.concat_ws("-", "lang", F.floor(F.col("n_chars") / 500).cast("string"))
    return hashes.conflicts(hashes.hash_groups(doc_items(spark, sf).withColumn("hash", coarse)))


@query(f"WITH {DI} SELECT * FROM looked")
def lookup_predict(spark: SparkSession, sf: str) -> DataFrame:
    return hashes.lookup_predict(doc_items(spark, sf).drop("predicted")).select("doc_id", "hash", "target", "training_hash_found", "predicted")


@query(f"WITH {DI} " + metric_sql(f"SELECT training_hash_found, {CELLS} FROM looked GROUP BY training_hash_found", "training_hash_found", "NULL"))
def lookup_metrics(spark: SparkSession, sf: str) -> DataFrame:
    found = hashes.lookup_predict(doc_items(spark, sf).drop("predicted"))
    return _metrics_rounded(metrics.class_metrics(metrics.confusion(found, by=["training_hash_found"]), None), "training_hash_found")


@query(f"WITH {DI} " + metric_sql(f"SELECT 'majority' AS baseline, {CELLS} FROM (SELECT target, majority AS predicted FROM di, maj WHERE split = 'validation')", "baseline"))
def majority_baseline(spark: SparkSession, sf: str) -> DataFrame:
    items = doc_items(spark, sf)
    constant = items.filter("split = 'validation'").drop("predicted").crossJoin(F.broadcast(hashes.majority_label(hashes.hash_groups(items)).withColumnRenamed("majority", "predicted")))
    return _metrics_rounded(metrics.class_metrics(metrics.confusion(constant)).withColumn("baseline", F.lit("majority")), "baseline")


@query(f"WITH {DI} SELECT target, hash, min(doc_id) AS representative, count(*) AS group_size FROM di WHERE split = 'train' GROUP BY target, hash")
def representatives(spark: SparkSession, sf: str) -> DataFrame:
    return hashes.representatives(doc_items(spark, sf), "doc_id")


@query(f"WITH {DI} SELECT i.doc_id, i.target, i.predicted, n_chars, i.hash, train_benign, train_malicious, validation_benign, validation_malicious FROM di i JOIN hg USING (hash) WHERE split = 'validation' AND i.predicted <> i.target")
def error_enrich(spark: SparkSession, sf: str) -> DataFrame:
    items = doc_items(spark, sf)
    v = items.filter("split = 'validation'")
    return hashes.error_enrich(v.select("doc_id", "target", "predicted"), v.select("doc_id", "hash", "n_chars"), hashes.hash_groups(items), "doc_id")


@query(f"WITH {DI} SELECT count(*) FILTER (p.doc_id IS NULL) AS missing, count(*) FILTER (i.doc_id IS NULL) AS unexpected, CAST(0 AS BIGINT) AS repeated FROM (SELECT doc_id FROM di) p FULL JOIN (SELECT doc_id FROM documents) i USING (doc_id)")
def coverage_check(spark: SparkSession, sf: str) -> DataFrame:
    return hashes.coverage(doc_items(spark, sf), table(spark, sf, "documents"), "doc_id")


# --- metrics -------------------------------------------------------------------------------------


@query(f"WITH {DI} SELECT split, {CELLS} FROM di GROUP BY split")
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion(doc_items(spark, sf), by=["split"])


@query(f"WITH {DI} " + metric_sql(f"SELECT split, {CELLS} FROM di GROUP BY split", "split"))
def class_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics_rounded(metrics.class_metrics(metrics.confusion(doc_items(spark, sf), by=["split"])), "split")


_BY_SCORE = "bs AS (SELECT p AS score, count(*) FILTER (target = 1) AS pos, count(*) FILTER (target = 0) AS neg FROM di GROUP BY p), cs AS (SELECT *, sum(pos) OVER (ORDER BY score) AS pos_upto, sum(neg) OVER (ORDER BY score) AS neg_upto, sum(pos) OVER () AS tp, sum(neg) OVER () AS tn FROM bs)"


@query(f"WITH {DI}, {_BY_SCORE} SELECT {R('sum(pos * (neg_upto - neg / 2.0)) / (CAST(max(tp) AS DOUBLE) * max(tn))')} AS roc_auc FROM cs")
def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.roc_auc(doc_items(spark, sf), "p").withColumn("roc_auc", rounded("roc_auc"))


@query(f"WITH {DI}, {_BY_SCORE} SELECT {R('sum(pos * CAST(tp - pos_upto + pos AS DOUBLE) / (tp - pos_upto + pos + tn - neg_upto + neg)) / max(tp)')} AS ap_malicious, {R('sum(neg * CAST(neg_upto AS DOUBLE) / (neg_upto + pos_upto)) / max(tn)')} AS ap_benign FROM cs")
def avg_precision(spark: SparkSession, sf: str) -> DataFrame:
    a = metrics.average_precision(doc_items(spark, sf), "p")
    return a.select(rounded("ap_malicious").alias("ap_malicious"), rounded("ap_benign").alias("ap_benign"))


_CURVE = "al AS (SELECT score AS threshold, CAST(sum(pos) AS BIGINT) AS pos, CAST(sum(neg) AS BIGINT) AS neg FROM (SELECT score, pos, neg FROM bs UNION ALL SELECT unnest([0.0, 0.5, 1.0]), 0, 0) GROUP BY score), up AS (SELECT threshold, CAST(sum(neg) OVER (ORDER BY threshold) AS BIGINT) AS tn, CAST(sum(pos) OVER (ORDER BY threshold) AS BIGINT) AS fn, CAST(sum(pos) OVER () AS BIGINT) AS p, CAST(sum(neg) OVER () AS BIGINT) AS n FROM al)"
_CURVE_CELLS = "SELECT threshold, tn, n - tn AS fp, fn, p - fn AS tp FROM up"


@query(f"WITH {DI}, {_BY_SCORE}, {_CURVE} " + metric_sql(_CURVE_CELLS, "threshold"))
def threshold_curve(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics_rounded(metrics.threshold_curve(doc_items(spark, sf), "p"), "threshold")


@query(f"WITH {DI}, {_BY_SCORE}, {_CURVE}, m AS ({metric_sql(_CURVE_CELLS, 'threshold')}) SELECT threshold, macro_f1 FROM m ORDER BY macro_f1 DESC, abs(threshold - 0.5), threshold LIMIT 1")
def best_threshold(spark: SparkSession, sf: str) -> DataFrame:
    curve = _metrics_rounded(metrics.threshold_curve(doc_items(spark, sf), "p"), "threshold")
    return metrics.best_threshold(curve).select("threshold", "macro_f1")


@query(f"WITH {DI} SELECT target, count(DISTINCT p) AS distinct_scores, " + ", ".join(f"{R(f'quantile_cont(p, {q})')} AS q{round(100 * q):03d}" for q in (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)) + " FROM di GROUP BY target")
def score_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    q = metrics.score_quantiles(doc_items(spark, sf), "p")
    return q.select("target", "distinct_scores", *[rounded(c).alias(c) for c in q.columns if c.startswith("q")])


@query(f"WITH {DI} SELECT {R('avg(-ln(CASE WHEN target = 1 THEN p ELSE 1.0 - p END))')} AS cross_entropy FROM di")
def cross_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.cross_entropy(doc_items(spark, sf), "p").withColumn("cross_entropy", rounded("cross_entropy"))


# Matrices of the windows' correlations to a tenth, as they are and without the feature ``user_id``.
_FULL = [f"coalesce(corr_{EVENT_FEATURES[min(i, j)]}_{EVENT_FEATURES[max(i, j)]}, 0)" if i != j else f"CAST(active_{EVENT_FEATURES[i]} AS INTEGER)" for i in range(4) for j in range(4)]
_TENTHS = lambda entries: "sha256(" + " || ',' || ".join(f"CAST(CAST(round(CAST({e} AS FLOAT) * 10::DOUBLE) AS BIGINT) AS VARCHAR)" for e in entries) + ")"


@query(f"""WITH {EV}, {_pearson_sql(EVENT_FEATURES, "win")}, m AS (SELECT split, active_user_id AS own, unnest([{{'view': 'full', 'hash': {_TENTHS(_FULL)}}}, {{'view': 'neutral', 'hash': {_TENTHS([e if i // 4 != 1 and i % 4 != 1 else "0" for i, e in enumerate(_FULL)])}}}]) AS v
FROM cor JOIN split USING (window_id) WHERE split <> 'test'), g AS (SELECT v.view AS view, v.hash AS hash, split, count(*) AS n, count(*) FILTER (own) AS one, count(*) FILTER (NOT own) AS zero FROM m GROUP BY 1, 2, 3),
t AS (SELECT *, coalesce(sum(n) FILTER (split = 'train') OVER (PARTITION BY view, hash), 0) AS train_n FROM g)
SELECT view, split, CAST(sum(n) AS BIGINT) AS windows, count(*) AS distinct_hashes, {R("count(*) / CAST(sum(n) AS DOUBLE)")} AS distinct_ratio, max(n) AS largest_group, CAST(sum(CASE WHEN train_n > 0 THEN n ELSE 0 END) AS BIGINT) AS matches_train,
CAST(sum(one) AS BIGINT) AS diagonal_one, CAST(sum(zero) AS BIGINT) AS diagonal_zero FROM t GROUP BY view, split""")
def representation_audit(spark: SparkSession, sf: str) -> DataFrame:
    matrices = correlate.pearson_arrow(event_windows(spark, sf), EVENT_FEATURES).join(event_split(spark, sf).select("window_id", "split"), "window_id")
    found = represent.representation_audit(matrices, 4, 1, digits=1)
    return found.withColumn("distinct_ratio", rounded("distinct_ratio"))


# --- inventories and selection -------------------------------------------------------------------


@query(f"""WITH {OF}, w AS (SELECT file, string_agg(line, chr(10) ORDER BY pos) || chr(10) AS body FROM lines GROUP BY file), n AS (SELECT file, count(*) AS rows, count(DISTINCT status) AS statuses FROM cells GROUP BY file)
SELECT file, octet_length(encode(body)) AS bytes, sha256(body) AS sha256, rows, CASE WHEN file % 2 = 0 THEN 'ts|key|note|tunnel_parents   label   detailed-label' ELSE 'note|Label|key' END AS columns, CAST(CASE WHEN file % 2 = 0 THEN 4 ELSE 3 END AS INTEGER) AS column_count,
CASE WHEN file % 2 = 1 THEN 'Label' END AS label_column, CASE WHEN file % 2 = 1 THEN statuses ELSE 0 END AS distinct_labels FROM w JOIN n USING (file)""")
def file_inventory(spark: SparkSession, sf: str) -> DataFrame:
    files, _ = inventory.file_inventory(spark, order_files(spark, sf), glob="*.txt")
    return files.withColumns({"file": order_file(), "columns": F.array_join("columns", "|")})


@query(f"""WITH {OF}, t AS (SELECT file, pos, ts, TRY_CAST(ts AS DOUBLE) AS t FROM cells WHERE file % 2 = 0), s AS (SELECT file, count(*) FILTER (t < before) AS steps FROM (SELECT *, lag(t) OVER (PARTITION BY file ORDER BY pos) AS before FROM t WHERE t IS NOT NULL) GROUP BY file)
SELECT c.file AS file, 'complete_file' AS status, count(*) AS rows, CASE WHEN c.file % 2 = 0 THEN 6 ELSE 3 END AS parsed_columns, min_by(t.ts, (t.t, t.pos)) FILTER (t.t IS NOT NULL) AS ts_min, max_by(t.ts, (t.t, -t.pos)) FILTER (t.t IS NOT NULL) AS ts_max,
count(*) FILTER (t.pos IS NOT NULL AND t.t IS NULL) AS ts_invalid, max(coalesce(s.steps, 0)) AS backward_steps FROM cells c LEFT JOIN t USING (file, pos) LEFT JOIN s ON s.file = c.file GROUP BY c.file""")
def audit_files(spark: SparkSession, sf: str) -> DataFrame:
    files = inventory.audit_files(spark, order_files(spark, sf), glob="*.txt", recursive=True).files
    return files.select(order_file().alias("file"), "status", "rows", "parsed_columns", "ts_min", "ts_max", "ts_invalid", "backward_steps")


@query(f"""WITH {OF} SELECT file, CAST(x.p AS INTEGER) AS position, x.c AS "column", count(*) AS rows, count(*) FILTER (lower(trim(x.v)) IN ('', '-', 'nan', 'null', 'none')) AS missing, count(*) FILTER (x.v = '(empty)') AS empty_sets, min(x.v) = max(x.v) AS constant FROM named GROUP BY ALL""")
def audit_columns(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.audit_files(spark, order_files(spark, sf), glob="*.txt", recursive=True).columns.withColumn("file", order_file())


@query(f"""WITH {OF} SELECT file, x.c AS "column", x.v AS label, count(*) AS n FROM named WHERE contains(lower(x.c), 'label') GROUP BY ALL""")
def audit_labels(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.audit_files(spark, order_files(spark, sf), glob="*.txt", recursive=True).labels.withColumn("file", order_file())


@query(f"""WITH {OF}, h AS (SELECT file, CASE WHEN file % 2 = 0 THEN 'ts|key|note|tunnel_parents   label   detailed-label' ELSE 'note|Label|key' END AS columns, count(*) AS n FROM cells GROUP BY file)
SELECT columns, CAST(CASE WHEN columns[1:2] = 'ts' THEN 4 ELSE 3 END AS INTEGER) AS column_count, count(*) AS files, CAST(sum(n) AS BIGINT) AS rows, min(file) AS example_file FROM h GROUP BY columns""")
def schema_inventory(spark: SparkSession, sf: str) -> DataFrame:
    files, _ = inventory.file_inventory(spark, order_files(spark, sf), glob="*.txt")
    return profile.schema_inventory(files.withColumn("file", order_file()))


_COUNTED = "count(*) AS rows_seen, count(*) FILTER (lower(trim(v)) IN ('', '-', 'nan', 'null', 'none')) AS missing, count(TRY_CAST(trim(v) AS DOUBLE)) AS \"numeric\", count(*) FILTER (lower(trim(v)) NOT IN ('', '-', 'nan', 'null', 'none') AND TRY_CAST(trim(v) AS DOUBLE) IS NULL) AS not_numeric, CAST(0 AS BIGINT) AS non_finite, min(TRY_CAST(trim(v) AS DOUBLE)) AS least, max(TRY_CAST(trim(v) AS DOUBLE)) AS greatest"


@query(f"""WITH {OF}, raw AS (SELECT file, unnest(CASE WHEN file % 2 = 0 THEN [{{'p': 0, 'c': 'ts', 'v': ts}}, {{'p': 1, 'c': 'key', 'v': key}}, {{'p': 2, 'c': 'note', 'v': note}}, {{'p': 3, 'c': 'tunnel_parents   label   detailed-label', 'v': '- ' || status || ' ' || third}}]
ELSE [{{'p': 0, 'c': 'note', 'v': note}}, {{'p': 1, 'c': 'Label', 'v': status}}, {{'p': 2, 'c': 'key', 'v': key}}] END) AS x FROM cells), g AS (
SELECT CASE WHEN file % 2 = 0 THEN 'ts|key|note|tunnel_parents   label   detailed-label' ELSE 'note|Label|key' END AS schema, CAST(x.p AS INTEGER) AS position, x.c AS "column", x.v AS v FROM raw), n AS (SELECT schema, position, "column", {_COUNTED} FROM g GROUP BY ALL)
SELECT *, {R('coalesce("numeric" / CAST(nullif("numeric" + not_numeric, 0) AS DOUBLE), 0.0)')} AS numeric_fraction, coalesce("numeric" / CAST(nullif("numeric" + not_numeric, 0) AS DOUBLE), 0.0) >= 0.999 AS likely_numeric FROM n""")
def external_columns(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.column_profiles(spark, order_files(spark, sf), glob="*.txt").withColumn("numeric_fraction", rounded("numeric_fraction"))


@query()
def rf_shap_rank(spark: SparkSession, sf: str) -> DataFrame:
    features = [*LINE_FEATURES, "l_linenumber"]
    rows, _ = ordering.ordered_index(line_flows(spark, sf).filter("split = 'train'"), LINE_KEYS, "row")
    return select.select_features(rows, features, "row", keep=min(15, len(features)))[0].select("rank", "feature", "feature_index", "importance", "selected")
