"""Exact top-k search by MaxScore over sharded inverted lists.

Vectors become integer term weights; a term is a component. In each shard of candidates every query
splits its terms by their score bounds: the essential ones are traversed for all candidates, the
others are probed only for candidates that can still enter the top k. Shards' lists are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1024
#: Vectors of a shard, and queries of a block: they bound what a task holds.
SHARD_ROWS = 8192
BLOCK_QUERIES = 1024


class Shard:
    """Inverted lists of one shard: a row of weights for each term, and their least and greatest."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray) -> None:
        # Rows of great length first: they set a high threshold early.
        order = np.lexsort((ids, -np.einsum("ij,ij->i", weights, weights)))
        self.ids = ids[order]
        self.lists = np.ascontiguousarray(weights[order].T)
        self.low, self.high = self.lists.min(1), self.lists.max(1)

    def search(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best candidates but the query's own row, ties to smaller ids."""
        ends = np.stack([q * self.low, q * self.high])
        least, reach = ends.min(0), ends.max(0) - ends.min(0)
        terms = np.argsort(-reach, kind="stable")
        # left[i]: what the terms from the i-th on add at most.
        left = np.concatenate([np.cumsum((least + reach)[terms][::-1])[::-1], [0.0]])
        valid = self.ids != query_id
        head = np.flatnonzero(valid[: 8 * k + 1])
        threshold = -np.inf
        if len(head) >= k:
            threshold = np.partition(q @ self.lists[:, head], len(head) - k)[len(head) - k]
        # Essential: without them no candidate reaches the threshold.
        essential = max(1, int(np.argmax(left < threshold)) if (left < threshold).any() else len(terms))
        first = terms[:essential]
        scores = q[first] @ self.lists[first]
        rows = np.flatnonzero(valid & (scores + left[essential] >= threshold))
        scores = scores[rows]
        for at in range(essential, len(terms), 8):
            if len(rows) > 4 * k:
                # Partial scores and the least that is left give a better threshold.
                sure = scores + self._least_from(q, terms[at:])
                threshold = max(threshold, np.partition(sure, len(rows) - k)[len(rows) - k])
                still = scores + left[at] >= threshold
                rows, scores = rows[still], scores[still]
            probe = terms[at : at + 8]
            scores = scores + q[probe] @ self.lists[np.ix_(probe, rows)]
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows[best]], scores[best]

    def _least_from(self, q: np.ndarray, terms: np.ndarray) -> float:
        return float(np.minimum(q[terms] * self.low[terms], q[terms] * self.high[terms]).sum())


def integer_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id long, w array<double> of integers); vectors that are null or hold null or non-finite
    components are left out."""
    x = F.col("_e")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    given = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("_e"))
    return given.filter(F.col("vec_id").isNotNull() & x.isNotNull()).filter(whole).select("vec_id", F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("double")).alias("w"))


def _packed(rows: DataFrame, group: str, prefix: str) -> DataFrame:
    """One row a group: its ids and weights as bytes, at most as many rows as the group's bound."""
    names = [f"{prefix}_ids", f"{prefix}_w", f"{prefix}_dims"]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        dims = max(map(len, rows["w"]), default=0)
        w = np.zeros((len(rows), dims))
        for k, v in enumerate(rows["w"]):
            w[k, : len(v)] = v
        return pd.DataFrame({group: [key[0]], names[0]: [rows["vec_id"].to_numpy(np.int64).tobytes()], names[1]: [w.astype(np.float32).tobytes() if np.abs(w).max(initial=0) < 2**24 else w.tobytes()], names[2]: [dims]})

    return rows.groupBy(group).applyInPandas(run, f"{group} long, {names[0]} binary, {names[1]} binary, {names[2]} int")


def _unpack(ids: bytes, w: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    found = np.frombuffer(ids, np.int64)
    kind = np.float32 if len(w) == 4 * len(found) * dims else np.float64
    return found, np.frombuffer(w, kind).reshape(len(found), dims).astype(np.float64)


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """The k candidates of greatest inner product for each query, but its own row.

    Both inputs are as integer_vectors() returns them. Returns query_id, rank from 1, vec_id and
    score; ties go to smaller ids. Every block of queries meets every shard once. Shorter vectors
    count as zero in the components they lack. Repeated ids are repeated candidates; queries of one
    id are answered once. Empty inputs give no rows. Sums are exact below 2**53.
    """
    spark = vectors.sparkSession
    n = vectors.count()
    shards = max(1, -(-n // shard_rows))
    # Several rows of one id go to one shard; a whole-vector hash deals them apart.
    deal = lambda parts: F.pmod(F.xxhash64("vec_id", "w"), F.lit(parts)).cast("long")
    lists = _packed(vectors.withColumn("shard", deal(shards)), "shard", "c")
    asked = queries.groupBy("vec_id").agg(F.min("w").alias("w"))
    blocks = max(1, -(-asked.count() // block_queries))
    blocked = _packed(asked.withColumn("block", deal(blocks)), "block", "q")
    pairs = lists.join(blocked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))).repartition(shards, "shard"), "shard")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples():
                ids, w = _unpack(r.c_ids, r.c_w, r.c_dims)
                q_ids, q_w = _unpack(r.q_ids, r.q_w, r.q_dims)
                dims = max(r.c_dims, r.q_dims)
                w, q_w = (np.pad(x, ((0, 0), (0, dims - x.shape[1]))) for x in (w, q_w))
                shard, out = Shard(ids, w), []
                for query_id, q in zip(q_ids.tolist(), q_w, strict=True):
                    best, scores = shard.search(query_id, q, k)
                    out.append(pd.DataFrame({"query_id": query_id, "vec_id": best, "score": scores.astype(np.int64)}))
                yield pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    found = pairs.select("c_ids", "c_w", "c_dims", "q_ids", "q_w", "q_dims").mapInPandas(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
