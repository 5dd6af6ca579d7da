"""The driver's tables in the roles of the flow pipeline, for Spark and, as CTEs, for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgrid.operators.ordering import ordered_index
from flowgrid.operators.split import stratified_split
from flowgrid.operators.windows import count_windows, window_manifest
from flowgrid.sources.scratch import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


EVENT_FEATURES = ["value", "user_id", "k", "kind"]


def event_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as flows: seconds, features, target (errors) and source row."""
    e = table(spark, sf_dir, "events")
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    return e.select(
        F.col("event_id").alias("source_row"),
        (micros / 1e6).alias("ts"),
        F.col("user_id").cast("double").alias("user_id"),
        "event_type",
        "value",
        F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("k"),
        F.length("event_type").cast("double").alias("kind"),
        (F.col("event_type") == "error").cast("int").alias("target"),
    )


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_windows(*ordered_index(event_flows(spark, sf_dir), ["ts", "source_row"]))


def event_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of events with split and fold."""
    return stratified_split(window_manifest(event_windows(spark, sf_dir)))


EV = """
ev AS (
  SELECT event_id AS source_row, CAST(epoch_us(ts) AS DOUBLE) / 1e6 AS ts, CAST(user_id AS DOUBLE) AS user_id, event_type, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k, CAST(length(event_type) AS DOUBLE) AS kind,
         CAST(event_type = 'error' AS INTEGER) AS target, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_idx
  FROM events
), win AS (
  SELECT *, row_idx // 15 AS window_id FROM ev WHERE row_idx < (SELECT count(*) // 15 * 15 FROM ev)
), man AS (
  SELECT window_id, min(row_idx) AS start_index, max(row_idx) + 1 AS stop_index_exclusive, max_by(target, row_idx) AS target,
         count(*) FILTER (target = 0) AS benign_rows, count(*) FILTER (target = 1) AS malicious_rows,
         min_by(ts, row_idx) AS start_ts, max_by(ts, row_idx) AS end_ts,
         min_by(source_row, row_idx) AS first_source_row, max_by(source_row, row_idx) AS last_source_row
  FROM win GROUP BY window_id
), manifest AS (
  SELECT *, CASE WHEN target = 1 THEN malicious_rows ELSE benign_rows END / CAST(benign_rows + malicious_rows AS DOUBLE) AS target_purity,
         end_ts - start_ts AS duration_seconds FROM man
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY target ORDER BY sha256('42:' || window_id), window_id) - 1 AS pos,
         count(*) OVER (PARTITION BY target) AS n FROM manifest
), cut AS (
  SELECT *, least(greatest(1, CAST(ceil(round(n * 0.2, 9)) AS BIGINT)), n - 5) AS tests FROM placed
), folded AS (
  SELECT *, CAST(CASE WHEN pos < tests THEN -1 ELSE (pos - tests) % 5 END AS INTEGER) AS fold FROM cut
), split AS (
  SELECT *, CASE fold WHEN -1 THEN 'test' WHEN 0 THEN 'validation' ELSE 'train' END AS split FROM folded
)"""

LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def line_part() -> Column:
    """Train, validation or test by order key."""
    k = F.col("l_orderkey") % 5
    return F.when(k == 0, "validation").when(k == 1, "test").otherwise("train")


def line_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumns({"split": line_part(), "target": (F.col("l_returnflag") == "R").cast("int")})


def line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_flows(spark, sf_dir).select(*LINE_KEYS, "target")
    return count_windows(*ordered_index(rows, LINE_KEYS))


LI = """
li AS (
  SELECT *, CASE l_orderkey % 5 WHEN 0 THEN 'validation' WHEN 1 THEN 'test' ELSE 'train' END AS split,
         CAST(l_returnflag = 'R' AS INTEGER) AS target,
         row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS row_idx
  FROM lineitem
), lwin AS (
  SELECT *, row_idx // 15 AS window_id FROM li WHERE row_idx < (SELECT count(*) // 15 * 15 FROM li)
)"""


def doc_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as images: the text's digest, split, target (poor quality) and a score."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), "lang", "source", "n_chars")
    k = F.col("doc_id") % 5
    return (
        d.join(table(spark, sf_dir, "labels"), "doc_id")
        .withColumn("split", F.when(k == 0, "validation").when(k == 1, "test").otherwise("train"))
        .withColumn("target", (F.col("quality") == 0).cast("int"))
        .withColumn("p", (F.col("n_chars") + 1) / (F.col("n_chars") + 2001.0))
        .withColumn("predicted", (F.col("p") > 0.5).cast("int"))
        .drop("quality", "toxic")
    )


DI = """
di AS (
  SELECT d.doc_id, sha256(d.text) AS hash, d.lang, d.source, d.n_chars,
         CASE d.doc_id % 5 WHEN 0 THEN 'validation' WHEN 1 THEN 'test' ELSE 'train' END AS split,
         CAST(l.quality = 0 AS INTEGER) AS target, (d.n_chars + 1) / (d.n_chars + 2001.0::DOUBLE) AS p,
         CAST((d.n_chars + 1) / (d.n_chars + 2001.0::DOUBLE) > 0.5 AS INTEGER) AS predicted
  FROM documents d JOIN labels l USING (doc_id)
), hg AS (
  SELECT hash, count(*) FILTER (split = 'train' AND target = 0) AS train_benign, count(*) FILTER (split = 'train' AND target = 1) AS train_malicious,
         count(*) FILTER (split = 'validation' AND target = 0) AS validation_benign, count(*) FILTER (split = 'validation' AND target = 1) AS validation_malicious
  FROM di WHERE split <> 'test' GROUP BY hash
), maj AS (
  SELECT CAST(sum(train_malicious) > sum(train_benign) AS INTEGER) AS majority FROM hg
), looked AS (
  SELECT v.doc_id, v.hash, v.target, h.hash IS NOT NULL AS training_hash_found,
         CASE WHEN h.hash IS NULL OR h.train_benign = h.train_malicious THEN majority ELSE CAST(h.train_malicious > h.train_benign AS INTEGER) END AS predicted
  FROM (SELECT * FROM di WHERE split = 'validation') v LEFT JOIN (SELECT * FROM hg WHERE train_benign + train_malicious > 0) h USING (hash), maj
)"""


#: Files that orders are dealt to, by customer.
ORDER_FILES = 64

_EVEN = ["ts", "key", "note", "tunnel_parents   label   detailed-label"]
_ODD = ["note", "Label", "key"]
# A record's cells, the same text in Spark and in SQL: odd times, missing markers, empty sets, cells
# with quotes, delimiters and line breaks.
_TS = "CASE WHEN o_custkey % 13 = 0 THEN 'x' WHEN o_custkey % 7 = 0 THEN ' 5 ' ELSE CAST(o_custkey % 100 AS STRING) END"
_NOTE = "CASE o_orderkey % 5 WHEN 0 THEN '-' WHEN 1 THEN '(empty)' WHEN 2 THEN o_orderpriority WHEN 3 THEN concat('\"a \"\"', o_orderstatus, '\"\",', chr(10), 'z\"') ELSE '' END"
_LINE = f"CASE WHEN o_custkey % {ORDER_FILES} % 2 = 0 THEN concat({_TS}, ',', o_orderkey, ',', {_NOTE}, ',- ', o_orderstatus, ' ', o_orderkey % 3) ELSE concat({_NOTE}, ',', o_orderstatus, ',', o_orderkey) END"


def order_files(spark: SparkSession, sf_dir: str) -> str:
    """Orders as delimited files of two schemas, in the order of their keys; the path of their folder."""
    path = scratch_path(spark, "orders")
    orders = table(spark, sf_dir, "orders")
    bucket = (F.col("o_custkey") % ORDER_FILES).alias("bucket")
    rows = orders.select(bucket, F.col("o_orderkey").alias("at"), F.expr(_LINE).alias("value"))
    heads = orders.select(bucket).distinct().select("bucket", F.lit(-1).cast("long").alias("at"), F.when(F.col("bucket") % 2 == 0, ",".join(_EVEN)).otherwise(",".join(_ODD)).alias("value"))
    rows.unionByName(heads).repartition(ORDER_FILES, "bucket").sortWithinPartitions("bucket", "at").select("bucket", "value").write.partitionBy("bucket").option("compression", "none").text(path)
    return path


def order_file(path: Column | str = "file") -> Column:
    """The number of a file of order_files() by its path."""
    return F.regexp_extract(path, "bucket=([0-9]+)", 1).cast("int")


OF = f"""
lines AS (
  SELECT CAST(o_custkey % {ORDER_FILES} AS INTEGER) AS file, o_orderkey AS pos, {_LINE.replace("STRING", "VARCHAR")} AS line FROM orders
  UNION ALL SELECT DISTINCT CAST(o_custkey % {ORDER_FILES} AS INTEGER), -1, CASE WHEN o_custkey % {ORDER_FILES} % 2 = 0 THEN '{",".join(_EVEN)}' ELSE '{",".join(_ODD)}' END FROM orders
), cells AS (
  SELECT CAST(o_custkey % {ORDER_FILES} AS INTEGER) AS file, o_orderkey AS pos, trim({_TS.replace("STRING", "VARCHAR")}) AS ts, o_orderstatus AS status, CAST(o_orderkey AS VARCHAR) AS key, CAST(o_orderkey % 3 AS VARCHAR) AS third,
         CASE o_orderkey % 5 WHEN 0 THEN '-' WHEN 1 THEN '(empty)' WHEN 2 THEN o_orderpriority WHEN 3 THEN concat('a "', o_orderstatus, '",', chr(10), 'z') ELSE '' END AS note FROM orders
), named AS (
  SELECT file, pos, unnest(CASE WHEN file % 2 = 0 THEN [{{'p': 0, 'c': 'ts', 'v': ts}}, {{'p': 1, 'c': 'key', 'v': key}}, {{'p': 2, 'c': 'note', 'v': note}}, {{'p': 3, 'c': 'tunnel_parents', 'v': '-'}}, {{'p': 4, 'c': 'label', 'v': status}}, {{'p': 5, 'c': 'detailed-label', 'v': third}}]
    ELSE [{{'p': 0, 'c': 'note', 'v': note}}, {{'p': 1, 'c': 'Label', 'v': status}}, {{'p': 2, 'c': 'key', 'v': key}}] END) AS x FROM cells
)"""
