"""Exact top-k search by inner product with MaxScore, over shards of integer vectors.

Every vector component becomes floor(scale * x). Dimensions are the query terms; the
posting of a term in a shard holds the vectors with a non-zero weight there, kept as a
full row where most vectors have one. For one query and one shard:

1. a term's bound is the most it can add to any score of the shard; terms are sorted by
   falling bound and the first few give a provisional k-th score;
2. terms are split: the non-essential tail's bounds add up to less than that score, so
   a vector without any essential term can't enter the top k;
3. essential postings are traversed and summed; the other terms are probed, a few at a
   time, only for vectors whose sum plus the remaining bounds is still competitive;
4. shards' lists are merged per query.

Different vectors are shuffled once more, to their shards; queries go to all shards and stream
past the shard that a task holds, a batch at a time. A shard grows with the square root of the
number of vectors, up to ``SHARD_CELLS`` components but ``SHARD_ROWS`` vectors at least, so that
fewer copies of the queries are needed; ``seen`` and ``probes`` tell what the bounds save.

Defined results: vectors that are null or hold null or non-finite components take no part;
an empty vector scores 0 with all others; a shorter vector has weight 0 in the missing
dimensions; repeated rows of an id count once, several different vectors of one id count
with their best score; a query's own id is no candidate; a null id is no query, but one
candidate, after all others in ties (the largest long, which stands for it inside, is taken
for null); ties go to smaller ids; an empty table gives an empty result; other columns are
not read. Scores are exact while |scores| < 2^63.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 256
K = 5
#: Least rows and most components (rows by dimensions) of a shard.
SHARD_ROWS = 8192
SHARD_CELLS = 4_000_000
#: The id that stands for null: it loses ties.
NULL_ID = (1 << 63) - 1
#: A posting that holds more than this share of a shard is kept as a full row.
FULL_SHARE = 0.25
SEED_TERMS = 8
PROBE_TERMS = 8


def quantized(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, vec array<long>) of the usable vectors; repeated rows once."""
    component = lambda x: F.floor(x.cast("double") * F.lit(float(scale)))
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    usable = F.col(vector).isNotNull() & F.forall(F.col(vector), finite)
    known = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))
    return df.where(usable).select(known.alias("id"), F.transform(vector, component).alias("vec")).distinct()


class Shard:
    """Postings of one shard, and MaxScore over them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        largest = float(np.abs(vectors).max(initial=0))
        # sums of products stay exact in doubles below 2^53, and BLAS is then usable
        self.exact_float = vectors.shape[1] * largest * max(largest, 1.0) < 2.0**52
        self.largest = largest
        self.vectors = self.vectors.astype("float64" if self.exact_float else "int64")
        self.rows = np.ascontiguousarray(self.vectors.T)
        self.low, self.high = self.rows.min(axis=1, initial=0), self.rows.max(axis=1, initial=0)
        share = (self.rows != 0).mean(axis=1)
        self.full = share > FULL_SHARE
        self.sparse = {d: np.flatnonzero(self.rows[d]) for d in np.flatnonzero(~self.full)}
        #: of all vectors asked about, those in essential postings; of all probes of other terms, those made
        self.asked = self.seen = self.probes = self.all_probes = 0

    @classmethod
    def of(cls, pairs: list[tuple[int, np.ndarray]]) -> "Shard":
        vectors = [v for _, v in pairs]
        return cls(np.array([i for i, _ in pairs], dtype="int64"), _matrix(vectors, max(map(len, vectors))))

    def answers(self, asked: list[tuple[int, np.ndarray]], k: int) -> list[tuple[int, int, int]]:
        """(query id, id, score) of the k best vectors for each of some queries (id, vector)."""
        width = self.vectors.shape[1]
        wanted = _matrix([v[:width] for _, v in asked], width)
        if self.exact_float and width * self.largest * float(np.abs(wanted).max(initial=0)) >= 2.0**52:
            self.exact_float = False
            self.vectors, self.rows = self.vectors.astype("int64"), self.rows.astype("int64")
            self.low, self.high = self.low.astype("int64"), self.high.astype("int64")
        out = []
        for (own, _), query in zip(asked, wanted, strict=True):
            ids, scores = self.top(query, own, k)
            out += [(own, i, s) for i, s in zip(ids.tolist(), scores.tolist(), strict=True)]
        return out

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best vectors other than ``own``, best first."""
        n = len(self.ids)
        query = query.astype(self.vectors.dtype)
        other = self.ids != own
        bound = np.maximum(np.maximum(query * self.low, query * self.high), 0)
        order = np.argsort(-bound, kind="stable")
        tail = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0]])  # tail[j]: most that terms j... add
        seeds = order[:SEED_TERMS]
        partial = query[seeds] @ self.rows[seeds]
        floor = self._kth(query, np.argpartition(-partial, min(4 * k, n - 1))[: 4 * k], other, k)
        split = len(order)
        if floor is not None:
            while split and tail[split - 1] < floor:
                split -= 1
        essential = order[:split]
        if floor is None or floor <= 0 or self.full[essential].any():
            seen = np.arange(n)
        else:
            marks = np.zeros(n, dtype=bool)
            for d in essential:
                marks[self.sparse[d]] = True
            seen = np.flatnonzero(marks)
        total = query[essential] @ self.rows[essential] if len(seen) == n else self.vectors[np.ix_(seen, essential)] @ query[essential]
        keep = other[seen]
        seen, total = seen[keep], total[keep]
        self.asked, self.seen, self.all_probes = self.asked + n, self.seen + len(seen), self.all_probes + n * (len(order) - split)
        for at in range(split, len(order) + 1, PROBE_TERMS):
            if len(seen) > k:
                best = np.argpartition(-total, min(4 * k, len(seen) - 1))[: 4 * k]
                known = [f for f in (floor, self._kth(query, seen[best], other, k)) if f is not None]
                floor = max(known, default=None)
                if floor is not None:
                    keep = total + tail[min(at, len(order))] >= floor
                    seen, total = seen[keep], total[keep]
            terms = order[at : at + PROBE_TERMS]
            self.probes += len(seen) * len(terms)
            total = total + self.vectors[np.ix_(seen, terms)] @ query[terms]
        best = np.lexsort((self.ids[seen], -total))
        chosen = self._distinct(seen[best], k)
        scores = self.vectors[chosen].astype("int64") @ query.astype("int64")
        return self.ids[chosen], scores

    def _kth(self, query: np.ndarray, at: np.ndarray, other: np.ndarray, k: int):
        """The k-th best exact score, over different ids, of some rows; None if there are fewer."""
        at = at[other[at]]
        scores = self.vectors[at] @ query
        best: dict = {}
        for i, s in zip(self.ids[at].tolist(), scores.tolist(), strict=True):
            best[i] = max(s, best.get(i, s))
        return sorted(best.values(), reverse=True)[k - 1] if len(best) >= k else None

    def _distinct(self, rows: np.ndarray, k: int) -> np.ndarray:
        """The first row of each of the first k ids."""
        _, first = np.unique(self.ids[rows], return_index=True)
        return rows[np.sort(first)[:k]]


def _matrix(vectors: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype="int64")
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, shard_cells: int = SHARD_CELLS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of ``vectors`` for each of ``queries`` (id, vec)."""
    rows, width = vectors.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    size = max(shard_rows, min(int(rows**0.5) * 16, shard_cells // max(1, width or 1)))
    shards = max(1, -(-rows // size))
    placed = vectors.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"))
    asking = queries.where(F.col("id") != NULL_ID).select("id", "vec", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"))
    dealt = placed.unionByName(asking).repartition(shards, "shard").sortWithinPartitions("shard", "asks")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Shards of a partition one after the other: first the vectors, then the queries."""
        number, held, shard = None, [], None
        for batch in batches:
            for at, part in batch.groupby("shard", sort=False):
                if at != number:
                    number, held, shard = at, [], None
                asks = part["asks"].to_numpy()
                pairs = list(zip(part["id"].tolist(), part["vec"], strict=True))
                held += [p for p, a in zip(pairs, asks, strict=True) if not a]
                if asks.any() and held:
                    shard = shard or Shard.of(held)
                    found = shard.answers([p for p, a in zip(pairs, asks, strict=True) if a], k)
                    yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"], dtype="int64")

    found = dealt.mapInPandas(scan, "query_id long, vec_id long, score long")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    merged = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(merged)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.nullif("vec_id", F.lit(NULL_ID)).alias("vec_id"), "score")
