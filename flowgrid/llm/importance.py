"""Target-distribution importance resampling over hashed word n-grams.

Each task counts the n-gram buckets of its documents with DuckDB: SQL splits and unnests the words,
windows over them make the n-grams, and a registered function gives their zlib CRC. Bucket counts
are spilled to Parquet; Spark merges them into the totals of corpus and target, scores every
document and draws by the Gumbel-perturbed scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from re import compile as pattern
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgrid.llm.common import materialise
from flowgrid.operators.ordering import ordered_index

BUCKETS = 10_000
SEED = 42
#: A document takes part in the draw from so many words on; so many in a hundred of those are drawn.
LEAST_WORDS = 20
PERCENT = 5
#: Characters of text that one SQL statement works on; longer texts are cut between words.
PIECE = 1 << 20

# A word of a text whose A-Z are lower case, one of a text as it stands, and what is none.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_WORD = pattern(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
GAP = pattern(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

#: Bucket counts of the pieces in a table (row, body, tail). Runs of words start in the body and may
#: end in the tail, the next piece's first words.
COUNTS = f"""
WITH split AS (
  SELECT row, regexp_extract_all(translate(body, {FOLD}), '{WORD}') AS own, regexp_extract_all(translate(tail, {FOLD}), '{WORD}') AS next
  FROM pieces
), words AS (
  SELECT row, len(own) AS n, unnest(list_concat(own, next)) AS w, unnest(range(len(own) + len(next))) AS i FROM split
), runs AS (
  SELECT row, n, i, w AS one, w || ' ' || lead(w) OVER after AS two, w || ' ' || lead(w) OVER after || ' ' || lead(w, 2) OVER after AS three
  FROM words WINDOW after AS (PARTITION BY row ORDER BY i)
), grams AS (
  SELECT row, unnest([one, two, three]) AS gram FROM runs WHERE i < n
), counted AS (
  SELECT row, CAST(zlib_crc32(gram) % {{buckets}} AS INTEGER) AS bucket, CAST(count(*) AS INTEGER) AS n FROM grams WHERE gram IS NOT NULL GROUP BY row, bucket
), listed AS (
  SELECT row, CAST(sum(n) AS BIGINT) AS n_features, list(bucket ORDER BY bucket) AS buckets, list(n ORDER BY bucket) AS counts FROM counted GROUP BY row
)
SELECT CAST(len(own) AS BIGINT) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(buckets, []) AS buckets, coalesce(counts, []) AS counts
FROM split LEFT JOIN listed USING (row) ORDER BY row
"""

_COUNTED = pa.schema([("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])


def _crc(grams: pa.Array) -> pa.Array:
    """zlib's CRC-32 of each string's UTF-8 bytes."""
    if isinstance(grams, pa.ChunkedArray):
        grams = grams.combine_chunks()
    grams = grams.cast(pa.binary())
    if grams.null_count:
        grams = grams.fill_null(b"")
    return pa.array(np.fromiter(map(crc32, grams.to_numpy(zero_copy_only=False)), np.uint32, len(grams)))


@lru_cache(maxsize=1)
def _database():
    """A worker's DuckDB in memory, on one thread, with the CRC function."""
    import duckdb

    database = duckdb.connect(config={"threads": 1, "memory_limit": "800MB", "temp_directory": ""})
    database.create_function("zlib_crc32", _crc, ["VARCHAR"], "UINTEGER", type="arrow")
    return database


def _pieces(text: str, size: int) -> Iterator[tuple[str, str]]:
    """``text`` cut between words into bodies of about ``size`` characters, each with the two words
    that follow it."""
    at = 0
    while len(text) - at > size and (gap := GAP.search(text, at + size)):
        yield text[at : gap.start()], " ".join(m[0] for m in islice(ANY_WORD.finditer(text, gap.end()), 2))
        at = gap.end()
    yield text[at:], ""


def _count(pieces: list[tuple[str, str]], buckets: int) -> pa.Table:
    """One row a piece."""
    database = _database()
    bodies, tails = zip(*pieces, strict=True)
    database.register("pieces", pa.table({"row": pa.array(range(len(pieces)), pa.int32()), "body": pa.array(bodies, pa.string()), "tail": pa.array(tails, pa.string())}))
    try:
        return database.sql(COUNTS.format(buckets=buckets)).to_arrow_table().cast(_COUNTED)
    finally:
        database.unregister("pieces")


def _merged(parts: pa.Table, buckets: int) -> pa.Table:
    """One row of several pieces of a text: counts of a bucket are added."""
    of = parts.column("buckets").combine_chunks().values.to_numpy()
    total = np.bincount(of, parts.column("counts").combine_chunks().values.to_numpy(), buckets).astype(np.int64)
    found = np.flatnonzero(total)
    sums = [sum(parts.column(k).to_pylist()) for k in range(2)]
    return pa.table([[sums[0]], [sums[1]], [found.tolist()], [total[found].tolist()]], schema=_COUNTED)


def _counted(texts: list[str], buckets: int, size: int) -> Iterator[pa.Table]:
    """One row a text, in order: short texts together, each long one by itself and piece by piece."""
    held: list[tuple[str, str]] = []
    held_size = 0
    for text in texts:
        if held and held_size + len(text) > size:
            yield _count(held, buckets)
            held, held_size = [], 0
        if len(text) <= size:
            held.append((text, ""))
            held_size += len(text)
        else:
            yield _merged(pa.concat_tables([_count([p], buckets) for p in _pieces(text, size)]), buckets)
    if held:
        yield _count(held, buckets)


def bucket_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS, piece: int = PIECE) -> DataFrame:
    """(doc_id, n_words, n_features, buckets, counts): how many of each text's runs of one to three
    words fall into which bucket, buckets ascending. Null texts have no words."""
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for table in _counted([t.as_py() for t in batch.column(1)], buckets, piece):
                ids = batch.column(0).slice(at, table.num_rows)
                at += table.num_rows
                yield from table.add_column(0, pa.field("doc_id", pa.int64()), ids).combine_chunks().to_batches()

    return given.mapInArrow(run, "doc_id long, n_words long, n_features long, buckets array<int>, counts array<int>")


def bucket_totals(counted: DataFrame) -> DataFrame:
    """(bucket, n) over all documents: partial sums a task, a row a bucket."""
    return counted.select(F.explode(F.arrays_zip("buckets", "counts")).alias("x")).groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum(F.col("x.counts").cast("long")).alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row with array ``gains``: for each bucket the logarithm, times 1000, of how much more likely
    the target is to hold it than the corpus, each bucket counted once more than it occurs."""
    every = corpus.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    both = every.join(bucket_totals(corpus).withColumnRenamed("n", "s"), "bucket", "left").join(bucket_totals(target).withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    one = both.agg(F.array_sort(F.collect_list(F.struct("bucket", "s", "t"))).alias("b"), F.sum("s").alias("ss"), F.sum("t").alias("tt"))

    def gain(x: Column) -> Column:
        up = (x["t"] + 1).cast("double") * (F.col("ss") + buckets).cast("double")
        down = (x["s"] + 1).cast("double") * (F.col("tt") + buckets).cast("double")
        return F.floor(1000 * F.ln(up / down))

    return one.select(F.transform("b", gain).alias("gains"))


def importance_resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, piece: int = PIECE) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``.

    weight is the sum of a document's gains, score that with Gumbel noise from the digest of seed and
    id, so that the highest scores are a draw without replacement in proportion to the weights. Of
    documents with ``least_words`` words or more, ``percent`` in a hundred are drawn and ranked from
    1, ties to smaller ids. Null and empty texts have no features and weight 0; a null id counts as
    an empty one; repeated rows are each a document; a target without words prefers rare buckets.
    Empty ``docs`` give no rows.
    """
    counted = materialise(bucket_counts(docs, doc_id, text, buckets, piece), "buckets")
    aimed = bucket_counts(target.select(F.lit(0).alias("_target"), F.col(target_text).alias("_text")), "_target", "_text", buckets, piece)
    # One row of as many numbers as there are buckets, whatever the size of the tables.
    gains = materialise(bucket_gains(counted, aimed, buckets), "gains", reduced=True)
    of = F.zip_with("buckets", "counts", lambda b, n: F.get(F.col("gains"), b) * n)
    weighed = counted.crossJoin(F.broadcast(gains)).select("doc_id", "n_words", "n_features", F.aggregate(of, F.lit(0).cast("long"), lambda s, x: s + x).alias("weight"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296)))
    scored = materialise(weighed.withColumn("score", F.col("weight") + noise), "scores")
    ranked, n = ordered_index(scored.filter(F.col("n_words") >= least_words), [F.desc("score"), F.asc("doc_id")], "place")
    drawn = F.when(F.col("place") < percent * n // 100, F.col("place") + 1)
    columns = ["doc_id", "n_features", "weight", "score"]
    rest = scored.filter(F.col("n_words") < least_words)
    return ranked.select(*columns, drawn.cast("long").alias("rank")).unionByName(rest.select(*columns, F.lit(None).cast("long").alias("rank")))
