"""Ranked lexical search over inverted treaps.

Documents are indexed in shards. In a shard every term of the queries has a treap over its postings:
a binary tree in the order of doc_id, and a heap by impact, what the term adds to the document's
score. A query goes down its terms' treaps at once. The roots' impacts bound what any document of
their common range can score; a range whose sum can't enter the k best is left, any other is scored
at the document of its greatest root and split there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowgrid.llm.bpe import slices
from flowgrid.llm.common import materialise
from flowgrid.llm.shingles import mix, word_hashes

BEST = 50
#: Documents and postings of a shard: they bound what a task holds.
SHARD_DOCS = 8192
SHARD_POSTINGS = 1 << 22
#: Terms of the queries that meet the shards in one pass.
BLOCK_TERMS = 1 << 20
#: Numbers of a traversal that are held at a time.
FRONTIER = 1 << 21
#: Bits of the filter by which documents keep the terms that queries may hold: 1 MB.
FILTER_BITS = 1 << 23
#: Parts in which a query's lists are merged first.
MERGE_PARTS = 64

# Terms are [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+, in UTF-8 as in code points.
_GAP = np.ones(256, bool)
_GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32


def term_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct terms of a whole text, as 64-bit hashes in ascending order, and their occurrences."""
    found, counts = np.unique(word_hashes(text, _GAP, _FOLD).view(np.int64), return_counts=True)
    return found, counts


def _slot(terms: np.ndarray) -> np.ndarray:
    return terms.view(np.uint64) >> np.uint64(64 - FILTER_BITS.bit_length() + 1)


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, term), each once; items that share an id are one."""
    given = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text")).filter(F.col("item_id").isNotNull() & F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in ((b.column(0), b.column(1)) for b in slices(batch)):
                found = [term_counts(t.as_py())[0] for t in texts]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids.to_numpy(zero_copy_only=False), list(map(len, found)))), pa.array(np.concatenate(found))], names=["item_id", "term"])

    return given.mapInArrow(run, "item_id long, term long").distinct()


def _filter_of(terms: DataFrame) -> np.ndarray:
    """Which slots the terms of ``terms`` are in: as many bits as FILTER_BITS at any number of terms."""
    shift = 64 - FILTER_BITS.bit_length() + 1
    words = terms.select(F.shiftrightunsigned("term", shift).alias("s")).selectExpr("shiftright(s, 6) as id", "shiftleft(1L, cast(s & 63 as int)) as bit").groupBy("id").agg(F.bit_or("bit").alias("w")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[words.column("id").to_numpy()] = words.column("w").to_numpy()
    return np.unpackbits(bits.view(np.uint8), bitorder="little").view(bool)


def postings(docs: DataFrame, doc_id: str, text: str, wanted: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, tfs): a row a document with its number of terms, repeats counted, and those
    whose slot is ``wanted``, with their occurrences."""
    packed = np.packbits(wanted)
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(packed).view(bool)
        for batch in batches:
            for small in slices(batch):
                n, terms, tfs = [], [], []
                for t in small.column(1):
                    found, counts = term_counts(t.as_py() or "")
                    n.append(int(counts.sum()))
                    kept = np.flatnonzero(held[_slot(found)])
                    terms.append(found[kept])
                    tfs.append(counts[kept])
                yield pa.RecordBatch.from_arrays([small.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int64())), pa.array(tfs, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tfs"])

    return given.mapInArrow(run, "doc_id long, n long, terms array<long>, tfs array<long>")


class Treaps:
    """A treap for each term of a shard. Node ``none``, after all others, stands for no node."""

    def __init__(self, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_terms: int, n_docs: int) -> None:
        """Postings ascend by term, then document; both are numbers from 0."""
        self.none = n = len(docs)
        self.n_docs = n_docs
        self.impact, self.doc = np.append(impacts, 0), np.append(docs, 0)
        #: Of each posting its term and document; they ascend.
        self.place = terms * n_docs + docs
        # Equal impacts are in the order of a hash, so that copies of a document make no chain.
        chance = mix(np.arange(n, dtype=np.uint64)) >> np.uint64(44)
        value = (impacts << 20 | chance.view(np.int64)).tolist()
        left, right, roots = [n] * (n + 1), [n] * (n + 1), [n] * n_terms
        ends = np.searchsorted(terms, np.arange(n_terms + 1))
        for t, (lo, hi) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            stack: list[int] = []
            for k in range(lo, hi):
                below, v = n, value[k]
                while stack and value[stack[-1]] < v:
                    below = stack.pop()
                left[k] = below
                if stack:
                    right[stack[-1]] = k
                stack.append(k)
            if stack:
                roots[t] = stack[0]
        self.left, self.right, self.roots = np.array(left), np.array(right), np.array(roots)

    def within(self, nodes: np.ndarray, after: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The greatest node below each of ``nodes`` whose document is between two, exclusive: down
        the tree by the documents' order until one is."""
        nodes = nodes.copy()
        open_ = np.flatnonzero(nodes != self.none)
        while len(open_):
            here = nodes[open_]
            doc = self.doc[here]
            early, late = doc <= after[open_], doc >= before[open_]
            out = np.flatnonzero(early | late)
            open_, here = open_[out], here[out]
            nodes[open_] = here = np.where(early[out], self.right[here], self.left[here])
            open_ = open_[here != self.none]
        return nodes

    def added(self, terms: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """What terms add to the scores of documents, 0 where they aren't in them."""
        wanted = terms * self.n_docs + docs
        at = np.minimum(np.searchsorted(self.place, wanted), self.none - 1)
        return np.where(self.place[at] == wanted, self.impact[at], 0)

    def search(self, terms: np.ndarray, best: Best) -> None:
        """Puts the documents that may be among a query's best there."""
        terms = terms[self.roots[terms] != self.none]
        if not len(terms):
            return
        # Ranges of documents (after, before), and in each row the terms' greatest nodes there.
        stack = [(self.roots[terms][None, :], np.array([-1]), np.array([self.n_docs]))]
        while stack:
            nodes, after, before = stack.pop()
            impacts = self.impact[nodes]
            reach = np.flatnonzero(impacts.sum(1) >= best.least)
            if not len(reach):
                continue
            nodes, impacts, after, before = nodes[reach], impacts[reach], after[reach], before[reach]
            at = self.doc[nodes[np.arange(len(nodes)), impacts.argmax(1)]]
            row, column = np.nonzero(impacts)
            best.offer(np.bincount(row, self.added(terms[column], at[row]), len(nodes)).astype(np.int64), at)
            nodes, after, before = np.concatenate((nodes, nodes)), np.concatenate((after, at)), np.concatenate((at, before))
            some = np.flatnonzero(before - after > 1)
            width = max(1, FRONTIER // len(terms))
            for part in (some[k : k + width] for k in range(0, len(some), width)):
                lo, hi = after[part], before[part]
                below = self.within(nodes[part].ravel(), np.repeat(lo, len(terms)), np.repeat(hi, len(terms)))
                stack.append((below.reshape(len(part), -1), lo, hi))


@dataclass
class Best:
    """A query's best documents so far; ``ids`` are those of the shard at hand."""

    k: int
    scores: np.ndarray
    docs: np.ndarray
    #: Lower scores don't count.
    least: int = 1
    ids: np.ndarray | None = None

    def offer(self, scores: np.ndarray, docs: np.ndarray) -> None:
        found = np.flatnonzero(scores >= self.least)
        if not len(found):
            return
        scores = np.concatenate((self.scores, scores[found]))
        docs = np.concatenate((self.docs, self.ids[docs[found]]))
        order = np.lexsort((docs, -scores))[: self.k]
        self.scores, self.docs = scores[order], docs[order]
        if len(order) == self.k:
            self.least = int(self.scores[-1])


@dataclass
class Block:
    """Queries as a task gets them: their terms in ascending order with weights, and each query's."""

    terms: np.ndarray
    weights: np.ndarray
    item_ids: list[int]
    of_item: list[np.ndarray]


def _block(rows: pa.Table) -> Block:
    """Of rows (item_id, term, w)."""
    item, term, w = (rows.column(c).to_numpy() for c in ("item_id", "term", "w"))
    terms, first, number = np.unique(term, return_index=True, return_inverse=True)
    order = np.argsort(item, kind="stable")
    ids, starts = np.unique(item[order], return_index=True)
    return Block(terms, w[first], ids.tolist(), np.split(number[order], starts[1:]))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    held, docs, size = [], 0, 0
    for batch in batches:
        for small in slices(batch, SHARD_DOCS // 8):
            more = len(small.column(2).flatten())
            if held and (docs + small.num_rows > SHARD_DOCS or size + more > SHARD_POSTINGS):
                yield held
                held, docs, size = [], 0, 0
            held.append(small)
            docs, size = docs + small.num_rows, size + more
    if held:
        yield held


def _treaps(shard: list[pa.RecordBatch], block: Block, n_docs: int, n_terms: int) -> tuple[np.ndarray, Treaps]:
    """The shard's ids in order and the treaps of the block's terms."""
    ids, n = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in shard]) for k in (0, 1))
    held = np.concatenate([np.diff(b.column(2).offsets.to_numpy()) for b in shard])
    terms, tfs = (np.concatenate([b.column(k).flatten().to_numpy() for b in shard]) for k in (2, 3))
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    doc = np.repeat(np.arange(len(ids)), held)
    number = np.searchsorted(block.terms, terms)
    known = np.flatnonzero(block.terms[np.minimum(number, len(block.terms) - 1)] == terms)
    number, doc, tf = number[known], doc[known], tfs[known]
    m = 100 - 50 + 50 * n * n_docs // n_terms
    impact = block.weights[number] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
    doc = place[doc]
    sort = np.lexsort((doc, number))
    return ids[order], Treaps(number[sort], doc[sort], impact[sort], len(block.terms), len(ids))


def ranked_search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = BEST, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0, ranked from
    1, ties to smaller ids.

    Terms are compared by 64-bit hashes: two different ones of a corpus of a billion terms are taken
    for each other with a probability below 3 %, one of a thousand query terms and any other with
    6e-8. Null texts have no terms and aren't counted as documents. Documents without an id count in
    the statistics but aren't returned; rows that share an id are each a document. Items that share
    an id are one item; those without id or terms give no rows. Empty tables give no rows.
    """
    spark = docs.sparkSession
    asked = materialise(item_terms(items, item_id, item_text), "asked")
    indexed = materialise(postings(docs, doc_id, text, _filter_of(asked)), "postings")
    total = indexed.agg(F.count_if(F.col("n") > 0).alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_terms")).first()
    n_docs, n_terms = total["n_docs"], max(1, total["n_terms"])
    df = indexed.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.ln(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double")))
    weighed = materialise(asked.join(df, "term").withColumn("w", weight).filter("w > 0"), "weighed", reduced=True)
    blocks = max(1, -(-weighed.count() // block_terms))
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for b in range(blocks):
        block = _block(weighed.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).select("item_id", "term", "w").toArrow())
        if block.item_ids:
            found = found.unionByName(materialise(_search(indexed, block, n_docs, n_terms, k), "best"))
    order = (F.desc("score"), F.asc("doc_id"))
    parts = found.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(MERGE_PARTS)))
    first = F.row_number().over(Window.partitionBy("item_id", "_part").orderBy(*order))
    last = F.row_number().over(Window.partitionBy("item_id").orderBy(*order))
    merged = parts.withColumn("rank", first).filter(F.col("rank") <= k).withColumn("rank", last).filter(F.col("rank") <= k)
    return merged.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _search(indexed: DataFrame, block: Block, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item_id, doc_id, score): each task's k best documents for each query of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k, np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in block.item_ids]
        for shard in _shards(batches):
            ids, treaps = _treaps(shard, block, n_docs, n_terms)
            for mine, terms in zip(best, block.of_item, strict=True):
                mine.ids = ids
                treaps.search(terms, mine)
        for item, mine in zip(block.item_ids, best, strict=True):
            if len(mine.docs):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine.docs), item)), pa.array(mine.docs), pa.array(mine.scores)], names=["item_id", "doc_id", "score"])

    return indexed.filter(F.col("doc_id").isNotNull() & (F.size("terms") > 0)).mapInArrow(run, "item_id long, doc_id long, score long")
