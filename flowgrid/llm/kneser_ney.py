"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

The model is over characters, so its tables grow with a language's letter sequences and not with its
words. Counts of all n-grams of the corpus are sharded by n-gram; joins of counts, continuation
counts and context statistics give each n-gram that occurs anywhere its probability. Documents are
scored against that table, and languages' own quantiles of trusted text set the thresholds.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowgrid.llm.bpe import slices
from flowgrid.llm.common import materialise
from flowgrid.llm.shingles import mix

ORDER = 5
#: Trusted ids, and rows of the score table, up to which a side is broadcast; beyond, it's joined.
BROADCAST_IDS = 1_000_000
BROADCAST_ROWS = 4_000_000
#: One in so many trusted documents is kept from training, to set its language's threshold: the
#: quantile of their perplexities times the margin.
HOLD_OUT = 5
QUANTILE = 0.99
MARGIN = 1.5
#: Width of the bins of log-perplexity in which quantiles are counted.
BIN = 0.002

_START, _END = "\x02", "\x03"
_FACTORS = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(16)], np.uint64)


def normal(text: str) -> str:
    """Lower case, white space as single spaces, without this module's marks."""
    return " ".join(text.lower().replace(_START, " ").replace(_END, " ").replace("\x00", " ").split())


def _code_points(texts: list[str], order: int) -> np.ndarray:
    """Code points of the texts, each after its start marks and before an end mark; digits alike."""
    joined = np.frombuffer("".join([_START * (order - 1) + normal(t) + _END for t in texts]).encode("utf-32-le"), np.uint32).copy()
    joined[(joined >= 48) & (joined <= 57)] = 48
    return joined


def _grams(points: np.ndarray, order: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of every n-gram that ends inside a document."""
    n = len(points) - order + 1
    starts = np.flatnonzero(points[order - 1 :] != 2)
    total = np.full(n, seed, np.uint64)
    for k in range(order):
        total += (points[k : n + k].astype(np.uint64) + np.uint64(1)) * _FACTORS[k]
    return starts, mix(total[starts])


def _seed(lang: str) -> int:
    """A number of the language that hashes of its n-grams start from."""
    return int(mix(np.array([int.from_bytes(lang.encode()[:64], "little") & (2**64 - 1), len(lang)], np.uint64)).sum())


_GRAM = T.StructType([T.StructField("lang", T.StringType()), T.StructField("g", T.StringType()), T.StructField("c", T.LongType())])


def count_grams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, g, c): every n-gram of the column ``text`` with its count in rows that are ``trusted``.

    Each task sums up before anything is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                h, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                c = np.bincount(at, np.concatenate([p[1] for p in parts]), len(h)).astype(np.int64)
                first = np.empty(len(h), np.int64)
                first[at] = np.arange(len(at))
                g = np.concatenate([p[2] for p in parts])[first]
                for k in range(0, len(h), 100_000):
                    some = pa.array(g[k : k + 100_000].tolist(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), some, pa.array(c[k : k + 100_000])], names=_GRAM.names)
            held.clear()

        for batch in batches:
            for small in slices(batch):
                groups: dict[tuple[str, bool], list[str]] = {}
                for lang, trusted, t in zip(small.column(0).to_pylist(), small.column(1).to_pylist(), small.column(2).to_pylist(), strict=True):
                    groups.setdefault((lang, trusted), []).append(t)
                for (lang, trusted), texts in groups.items():
                    points = _code_points(texts, order)
                    starts, hashes = _grams(points, order, _seed(lang))
                    codes, h = pd.factorize(hashes)
                    first = np.empty(len(h), np.int64)
                    first[codes[::-1]] = np.arange(len(codes))[::-1]
                    shown = points[starts[first][:, None] + np.arange(order)]
                    g = np.ascontiguousarray(shown).view(f"<U{order}").ravel()
                    held.setdefault(lang, []).append((h, np.bincount(codes, minlength=len(h)) if trusted else np.zeros(len(h)), g))
                    size += len(h)
                if size > 3_000_000:
                    yield from out()
                    size = 0
        yield from out()

    given = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")), F.coalesce(F.col("trusted"), F.lit(False)), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return given.mapInArrow(run, _GRAM).groupBy("lang", "g").agg(F.sum("c").alias("c"))


def _discounts(counts: DataFrame) -> DataFrame:
    """Each language's three discounts from its counts of counts, within sane bounds."""
    n = counts.groupBy("lang").agg(*[F.count_if(F.col("c") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    d = lambda k: F.greatest(F.lit(0.05 * k), F.least(F.lit(0.95 * k), F.coalesce(k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}")), F.lit(0.5 * k))))
    return n.select("lang", *[d(k).alias(f"d{k}") for k in (1, 2, 3)])


def score_table(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, g, logp): the natural log-probability of the last character of every n-gram in
    ``grams`` after the others. Languages without trusted text give no rows."""
    counts = {order: grams.filter("c > 0")}
    asked = {order: grams.select("lang", "g").join(counts[order].select("lang").distinct(), "lang", "left_semi")}
    for n in range(order - 1, 0, -1):
        # Continuation counts: how many characters stand before an n-gram.
        counts[n] = materialise(counts[n + 1].groupBy("lang", F.substring("g", 2, n).alias("g")).agg(F.count("*").alias("c")), "counts")
        asked[n] = asked[n + 1].select("lang", F.substring("g", 2, n).alias("g")).distinct()
    lower = None
    for n in range(1, order + 1):
        used = counts[n].join(_discounts(counts[n]), "lang").withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        context = F.substring("g", 1, n - 1) if n > 1 else F.lit("")
        contexts = used.groupBy("lang", context.alias("h")).agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("gamma"), F.count("*").alias("kinds"))
        p = asked[n].join(used.select("lang", "g", (F.col("c") - F.col("d")).alias("left")), ["lang", "g"], "left").withColumn("h", context).join(contexts, ["lang", "h"], "left")
        if lower is None:
            base = 1.0 / (F.col("kinds") + 1)
        else:
            p = p.withColumn("s", F.substring("g", 2, n - 1)).join(lower.withColumnsRenamed({"g": "s", "p": "below"}), ["lang", "s"])
            base = F.col("below")
        p = p.select("lang", "g", (F.coalesce(F.col("left") / F.col("total"), F.lit(0.0)) + F.coalesce("gamma", F.lit(1.0)) * base).alias("p"))
        lower = materialise(p, "levels")
    return lower.select("lang", "g", F.log("p").alias("logp"))


def _hashed(table: DataFrame, order: int) -> DataFrame:
    """(k, v): the hash of each n-gram with its language, as _grams() has it, and its value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            points = np.array(batch.column(1).to_pylist() or [""], f"<U{order}").view(np.uint32).reshape(-1, order)[: len(langs)]
            total = np.zeros(len(langs), np.uint64)
            for lang in set(langs):
                total[langs == lang] = _seed(lang)
            for k in range(order):
                total += (points[:, k].astype(np.uint64) + np.uint64(1)) * _FACTORS[k]
            yield pa.RecordBatch.from_arrays([pa.array(mix(total).view(np.int64)), batch.column(2).cast(pa.float32())], names=["k", "v"])

    return table.select("lang", "g", "logp").mapInArrow(run, "k long, v float")


class _Table:
    """A hash table of 64-bit keys in two arrays, searched for many keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        size = 1 << max(4, int(2 * len(keys)).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys, self.values = np.zeros(size, np.uint64), np.full(size, np.nan, np.float32)
        slots, left = keys & self.mask, np.arange(len(keys))
        while len(left):
            free = self.keys[slots[left]] == 0
            self.keys[slots[left[free]]] = keys[left[free]]
            won = self.keys[slots[left]] == keys[left]
            self.values[slots[left[won]]] = values[left[won]]
            left = left[~won]
            slots[left] = (slots[left] + np.uint64(1)) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        slots = keys & self.mask
        out = self.values[slots]
        left = np.flatnonzero(self.keys[slots] != keys)
        while len(left):
            slots[left] = (slots[left] + np.uint64(1)) & self.mask
            held = self.keys[slots[left]]
            out[left] = self.values[slots[left]]
            left = left[(held != keys[left]) & (held != 0)]
        return out


_TABLES: dict[str, _Table] = {}


def _table(name: str, sent: Broadcast) -> _Table:
    """This worker's table of a broadcast; one is held at a time."""
    if name not in _TABLES:
        _TABLES.clear()
        _TABLES[name] = _Table(*sent.value)
    return _TABLES[name]


_SCORED = T.StructType([T.StructField("_uid", T.LongType()), T.StructField("total", T.DoubleType()), T.StructField("n", T.LongType())])


def _score_by_table(given: DataFrame, sent: Broadcast, order: int) -> DataFrame:
    schema = T.StructType([*given.schema.fields[:-1], *_SCORED.fields[1:]])
    width, name = len(schema) - 2, uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(name, sent)
        for batch in batches:
            for small in slices(batch):
                langs, texts = small.column(1).to_pylist(), small.column(width).to_pylist()
                totals, counts = np.full(len(texts), np.nan), np.zeros(len(texts), np.int64)
                for lang in set(langs):
                    rows = [k for k, x in enumerate(langs) if x == lang]
                    points = _code_points([texts[k] for k in rows], order)
                    starts, hashes = _grams(points, order, _seed(lang))
                    row = np.cumsum(points == 3)
                    row = (row - (points == 3))[starts + order - 1]
                    found = table.find(hashes | np.uint64(1)).astype(np.float64)
                    totals[rows] = np.bincount(row, found, len(rows))
                    counts[rows] = np.bincount(row, minlength=len(rows))
                yield pa.RecordBatch.from_arrays([*[small.column(k) for k in range(width)], pa.array(totals, from_pandas=True), pa.array(counts)], names=schema.names)

    return given.mapInArrow(run, schema)


def _score_by_join(given: DataFrame, table: DataFrame, order: int) -> DataFrame:
    """The same sums without a broadcast: documents' n-gram counts joined to the table's shards."""
    schema = T.StructType([T.StructField("_uid", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("g", T.StringType()), T.StructField("n", T.LongType())])
    given = materialise(given, "given")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for small in slices(batch, 64):
                for uid, lang, t in zip(small.column("_uid").to_pylist(), small.column("lang").to_pylist(), small.column("text").to_pylist(), strict=True):
                    points = _code_points([t], order)
                    shown = points[np.arange(len(points) - order + 1)[:, None] + np.arange(order)]
                    g, n = np.unique(np.ascontiguousarray(shown).view(f"<U{order}").ravel(), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([uid] * len(g), pa.int64()), pa.array([lang] * len(g), pa.string()), pa.array(g.tolist(), pa.string()), pa.array(n, pa.int64())], names=schema.names)

    each = given.select("_uid", "lang", "text").mapInArrow(run, schema)
    sums = each.join(table, ["lang", "g"], "left").groupBy("_uid").agg(F.sum(F.col("n") * F.col("logp")).alias("total"), F.sum("n").alias("n"))
    return given.drop("text").join(sums, "_uid", "left")


def quality_classifier(
    docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", order: int = ORDER, quantile: float = QUANTILE, margin: float = MARGIN, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Perplexity of every whole text under its language's model of trusted text.

    ``trusted`` has the ids (column ``doc_id``) of documents of known quality. Most of them train
    the model; those held out, which it hasn't seen, set the thresholds. Returns doc_id, lang,
    n_grams, perplexity (a character), threshold and kept. A text is kept up to its language's
    threshold: the quantile of held-out perplexities times the margin.
    A null or empty text has no perplexity and isn't kept. Texts of a language without trusted ones
    have none either, and are kept; so are those of a language whose few trusted ones all train the
    model or are all held out, since it then has no threshold or no model. A null language is one of its own. Repeated rows are scored
    each. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ids = materialise(trusted.select(F.col("doc_id").alias("_id")).filter(F.col("_id").isNotNull()).distinct().withColumn("_held", F.pmod(F.xxhash64("_id"), F.lit(HOLD_OUT)) == 0), "trusted")
    few = ids.count() <= BROADCAST_IDS
    given = docs.select(F.monotonically_increasing_id().alias("_uid"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    marked = given.join(F.broadcast(ids) if few else ids.hint("shuffle_hash"), F.col("doc_id") == F.col("_id"), "left").select("_uid", "lang", "doc_id", F.coalesce("_held", F.lit(False)).alias("held"), F.coalesce(~F.col("_held"), F.lit(False)).alias("trusted"), "text")
    table = score_table(materialise(count_grams(marked, order), "grams"), order)
    if table.count() <= broadcast_rows:
        # Twelve bytes a row, gathered as Arrow batches.
        rows = _hashed(table, order).toArrow()
        keys, values = rows["k"].to_numpy().view(np.uint64) | np.uint64(1), rows["v"].to_numpy()  # 0 marks a free slot
        scored = _score_by_table(marked, spark.sparkContext.broadcast((keys, values)), order)
    else:
        scored = _score_by_join(marked, table, order)
    scored = scored.select("doc_id", "lang", "held", F.when(F.col("n") > 1, F.col("n")).otherwise(0).alias("n_grams"), F.when(F.col("n") > 1, -F.col("total") / F.col("n")).alias("_log"))
    scored = materialise(scored, "scored")
    bins = scored.filter(F.col("held") & F.col("_log").isNotNull()).groupBy("lang", F.ceil(F.col("_log") / BIN).alias("bin")).agg(F.count("*").alias("c"))
    # The bins of a language are few, so one task can sum them in order.
    upto, whole = Window.partitionBy("lang").orderBy("bin"), Window.partitionBy("lang")
    thresholds = bins.select("lang", "bin", F.sum("c").over(upto).alias("upto"), F.sum("c").over(whole).alias("whole")).filter(F.col("upto") >= quantile * F.col("whole")).groupBy("lang").agg((F.exp(F.min("bin") * BIN) * margin).alias("threshold"))
    perplexity = F.exp("_log")
    kept = F.when(F.col("n_grams") == 0, False).otherwise(F.coalesce(perplexity <= F.col("threshold"), F.lit(True)))
    return scored.join(thresholds, "lang", "left").select("doc_id", "lang", "n_grams", perplexity.alias("perplexity"), "threshold", kept.alias("kept"))
