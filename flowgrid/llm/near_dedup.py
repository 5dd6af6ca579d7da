"""Near-duplicate documents by ProbMinHash, banding and verification.

Weighted word shingles arrive at a signature's registers as Poisson processes whose rates are their
weights; a shingle stops as soon as its next arrival can't be the first at any register. Signatures'
bands become buckets. Exact copies are one node throughout. Each bucket's members are verified
against its leader: the one of them that shares the most buckets with others, so the text from which
a group of near copies stems. Where a bucket still holds several classes, its members get a sketch,
one bit for each of many more registers; those of different classes whose sketches agree as they do
at the threshold are verified, first against a few pivots, then against all. Only
pairs that may be similar leave such a join, each in the first band that both share.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowgrid.llm.bpe import slices
from flowgrid.llm.common import discard, materialise, only_with
from flowgrid.llm.components import connected_components
from flowgrid.llm.shingles import WORDS, mix, similarity, weighted_shingles

#: At a similarity of 0.8, 32 bands of 6 registers miss one pair in 17,000.
BANDS = 32
ROWS = 6
THRESHOLD = 0.8
#: Bits of a band's key. With 32 keys a document, a document's bucket holds 0.001 strangers by chance at
#: 10 ** 10 documents.
KEY_BITS = 48
#: Mean pivots of a bucket of more than ``LARGE`` texts, in the round before classes that still share
#: a bucket meet in full. Smaller buckets need none; the result is the same.
PIVOTS = 4
LARGE = 64
#: Registers of a sketch, and the standard deviations by which a pair's sketches may differ more than
#: is expected at the threshold: a pair at just 0.8 is missed with a probability of 1e-9.
SKETCH = 2048
DEVIATIONS = 6


def prob_min_hash(shingles: np.ndarray, weights: np.ndarray, registers: int = BANDS * ROWS) -> np.ndarray:
    """For each register the shingle that arrived first. Registers of two signatures agree with the
    probability Jaccard similarity of the weighted sets."""
    first = np.full(registers, np.inf)
    owner = np.zeros(registers, np.uint64)
    h, w, at = shingles, weights.astype(np.float64), np.zeros(len(shingles))
    turn = 0
    while len(h):
        # Several arrivals at once while few shingles are left.
        k = max(1, min(64, 4 * registers // len(h)))
        turns = np.arange(turn + 1, turn + k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        turn += k
        draws = mix(h[:, None] + turns)
        times = -np.log(((draws >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53) / w[:, None]
        if k > 1:
            np.cumsum(times, axis=1, out=times)
        times += at[:, None]
        flat_t, flat_r = times.ravel(), (mix(draws) % np.uint64(registers)).view(np.int64).ravel()
        np.minimum.at(first, flat_r, flat_t)
        earliest = np.flatnonzero(flat_t == first[flat_r])
        owner[flat_r[earliest]] = h[earliest // k]
        at = times[:, -1]
        left = at < first.max()
        h, w, at = h[left], w[left], at[left]
    return owner


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One key of KEY_BITS for each band of a signature."""
    parts = signature.reshape(bands, -1)
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(parts.shape[1]):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, k])
    return (keys >> np.uint64(64 - KEY_BITS)).view(np.int64)


def sketch(shingles: np.ndarray, weights: np.ndarray, bits: int = SKETCH) -> np.ndarray:
    """One bit for each register, 64 in a number: bits of two sketches differ with half the
    probability that registers do."""
    owner = prob_min_hash(shingles, weights, bits)
    odd = mix(owner ^ (np.arange(1, bits + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))) & np.uint64(1)
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def most_differing(threshold: float, bits: int = SKETCH) -> int:
    """Bits in which the sketches of a pair at ``threshold`` differ at most, but for one pair in a billion."""
    p = (1 - threshold) / 2
    return int(bits * p + DEVIATIONS * (bits * p * (1 - p)) ** 0.5)


def _node(h: np.ndarray, w: np.ndarray) -> bytes | None:
    """The name of a text: a digest of its weighted shingles, none if it has no words."""
    return hashlib.blake2b(h.tobytes() + w.tobytes(), digest_size=16).digest() if len(h) else None


def signatures(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, node, bands): node is a digest of the text's weighted shingles, null without words."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for small in slices(batch):
                nodes, bands = [], []
                for t in small.column(1):
                    h, w = weighted_shingles(t.as_py() or "")
                    if len(h):
                        nodes.append(hashlib.blake2b(h.tobytes() + w.tobytes(), digest_size=16).digest())
                        bands.append(band_keys(prob_min_hash(h, w)))
                    else:
                        nodes.append(None)
                        bands.append(None)
                yield pa.RecordBatch.from_arrays([small.column(0), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=schema.names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


@lru_cache(maxsize=64)
def _parsed(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    return weighted_shingles(zlib.decompress(packed).decode())


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The rows (a, b) of ``pairs`` whose texts are similar: as sets of shingles or as weighted ones."""
    # Later rounds ask for few of the texts, and leaders are few: only those are shuffled.
    sides = [only_with(texts.select(F.col("node").alias(k), F.col("text").alias(f"t{k}")), k, pairs) for k in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "ta", "tb")
    schema = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for small in slices(batch):
                same = [max(similarity(_parsed(x.as_py()), _parsed(y.as_py()))) >= threshold for x, y in zip(small.column(2), small.column(3), strict=True)]
                yield pa.RecordBatch.from_arrays([small.column(0), small.column(1)], names=["a", "b"]).filter(pa.array(same, pa.bool_()))

    return both.mapInArrow(run, schema)


def _mixed(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Members, with their class and bucket's size and main class, of the buckets with several classes."""
    labelled = members.join(classes.select("node", "component"), "node", "left").withColumn("of", F.coalesce("component", "node")).drop("component")
    counts = labelled.groupBy("key", "of").agg(F.count("*").alias("c"))
    mixed = counts.groupBy("key").agg(F.count("*").alias("classes"), F.sum("c").alias("size"), F.max_by("of", F.struct("c", "of")).alias("main")).filter("classes > 1").drop("classes")
    mixed = materialise(mixed, "mixed", reduced=True)
    out = materialise(labelled.join(mixed, "key"), "mixed", reduced=True)
    discard(mixed)
    return out


def _close_pairs(left: DataFrame, right: DataFrame, sketches: DataFrame, threshold: float, each_once: bool) -> DataFrame:
    """Pairs (a, b) of different classes in one bucket whose sketches differ no more than those of
    similar texts, each in the first band that they share. ``each_once``: both sides may hold both."""
    sides = [x.join(sketches, "node").select("key", *[F.col(c).alias(f"{c}_{n}") for c in ("node", "of", "main", "bands", "weighted", "plain")]) for x, n in ((left, "p"), (right, "m"))]
    differ = "aggregate(zip_with({0}, {1}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    most = most_differing(threshold)
    weights = "plain_p is null and plain_m is null"
    near = f"{differ.format('weighted_p', 'weighted_m')} <= {most} or (not ({weights}) and {differ.format('coalesce(plain_p, weighted_p)', 'coalesce(plain_m, weighted_m)')} <= {most})"
    first = "array_position(zip_with(bands_p, bands_m, (x, y) -> x = y), true) = array_position(bands_p, key)"
    once = "(of_m = main_m or node_p < node_m)" if each_once else "true"
    met = sides[0].join(sides[1], "key").filter(f"of_p != of_m and {once} and ({near}) and {first}")
    return met.select(F.least("node_p", "node_m").alias("a"), F.greatest("node_p", "node_m").alias("b"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id): one row per row of ``docs``; class_id is the least doc_id of its class.

    Shingles are of five words; shorter texts are one shingle of all their words. Texts without
    words, null ones too, are each a class of their own. A null doc_id gets the class of its text,
    null if no row of the class has an id. An empty table gives no rows.
    """
    signed = materialise(signatures(docs, doc_id, text), "signatures")
    rows = signed.select("doc_id", "node")
    buckets = signed.filter(F.col("node").isNotNull()).select("node", F.explode("bands").alias("key"))
    # Copies of a text and lone texts go here: from the third line on, buckets hold different texts.
    several = buckets.groupBy("key").agg(F.min(F.xxhash64("node")).alias("lo"), F.max(F.xxhash64("node")).alias("hi")).filter("lo != hi").select("key")
    several = materialise(several, "several", reduced=True)
    members = materialise(buckets.join(several, "key").distinct(), "buckets")
    discard(several)
    sizes = materialise(members.groupBy("key").agg(F.count("*").alias("size")), "sizes", reduced=True)
    central = members.join(sizes, "key").groupBy("node").agg(F.sum("size").alias("central"))
    leaders = members.join(central, "node").groupBy("key").agg(F.max(F.struct("central", "node")).alias("x")).select("key", F.col("x.node").alias("leader"))
    leaders = materialise(leaders, "leaders", reduced=True)
    stars = members.join(leaders, "key").filter(F.col("leader") != F.col("node"))
    stars = materialise(stars.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "stars", reduced=True)
    # One row with its text for each node that is in a pair.
    wanted = materialise(members.select("node").distinct(), "wanted", reduced=True)
    discard(sizes, leaders)
    one = materialise(rows.filter(F.col("node").isNotNull()).join(wanted, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "one", reduced=True)
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    texts = materialise(_texts_of(one, given), "texts")
    sketches = texts.drop("text")
    discard(wanted, one)
    links = materialise(_verified(stars, texts, threshold), "links")
    discard(stars)
    classes = connected_components(links)

    labelled = _mixed(members, classes)
    chance = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) / float(1 << 30)
    for pivots in (True, False):
        right = labelled.filter(F.col("size") > LARGE) if pivots else labelled
        left = right.filter(chance * F.col("size") < PIVOTS) if pivots else right.filter("of != main")
        if left.isEmpty():
            continue
        met = materialise(_close_pairs(left, right, sketches, threshold, not pivots).distinct(), "met")
        more = materialise(_verified(met, texts, threshold), "links")
        discard(met)
        if not more.isEmpty():
            stale, links = [links, classes, more], materialise(links.unionByName(more).distinct(), "links", reduced=True)
            classes = connected_components(links)
            if pivots:
                stale.append(labelled)
                labelled = _mixed(members, classes)
            discard(*stale)
    discard(members, texts, labelled, links)

    named = rows.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("least"))
    named = named.join(classes.select("node", "component"), "node", "left").select("node", "least", F.coalesce("component", "node").alias("of"))
    ids = named.groupBy("of").agg(F.min("least").alias("class_id"))
    named = materialise(named.join(ids, "of").select("node", "class_id"), "named", reduced=True)
    discard(classes)
    return rows.join(named, "node", "left").select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def _texts_of(one: DataFrame, given: DataFrame) -> DataFrame:
    """(node, text, bands, weighted, plain) for nodes named by a doc_id; of rows that share an id, the
    one with the node. Texts are compressed, since they move several times. With each band's key, and
    sketches of the weighted shingles and, where weights differ, of their set."""
    plain = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("text", T.StringType())])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for small in slices(batch, 256):
                yield pa.RecordBatch.from_arrays([pa.array([_node(*weighted_shingles(t.as_py() or "")) for t in small.column(0)], pa.binary()), small.column(0)], names=plain.names)

    nameless = given.filter("doc_id is null").select("text").mapInArrow(named, plain).join(one.filter("doc_id is null").select("node"), "node")
    joined = only_with(given, "doc_id", one).join(one, "doc_id").select("node", "text").unionByName(nameless)
    lists = {"bands": (T.LongType(), pa.int64()), "weighted": (T.LongType(), pa.int64()), "plain": (T.LongType(), pa.int64())}
    schema = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("text", T.BinaryType()), *[T.StructField(c, T.ArrayType(t)) for c, (t, _) in lists.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for small in slices(batch, 256):
                right, packed, facts = [], [], []
                for node, t in zip(small.column(0), small.column(1), strict=True):
                    h, w = weighted_shingles(t.as_py() or "")
                    right.append(_node(h, w) == node.as_py())
                    if right[-1]:
                        packed.append(zlib.compress(t.as_py().encode(), 1))
                        plain = None if w.max() == 1 else sketch(h, np.ones(len(w), np.int64))
                        facts.append((band_keys(prob_min_hash(h, w)), sketch(h, w), plain))
                nodes = small.column(0).filter(pa.array(right, pa.bool_()))
                yield pa.RecordBatch.from_arrays([nodes, pa.array(packed, pa.binary()), *[pa.array([f[k] for f in facts], pa.list_(t)) for k, (_, t) in enumerate(lists.values())]], names=schema.names)

    return joined.mapInArrow(run, schema).dropDuplicates(["node"])


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, with its columns, without the documents that aren't the first of their class.

    The document with the class's least id stays; rows that repeat its id stay with it, and so do
    rows without an id.
    """
    gone = near_duplicates(docs, doc_id, text, threshold).filter(F.col("doc_id") != F.col("class_id")).select("doc_id").distinct()
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return whole.join(gone, F.col("row").getField(doc_id).cast("long") == F.col("doc_id"), "left_anti").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
