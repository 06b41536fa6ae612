"""Approximate nearest neighbours with a hash-prefix forest (LSH forest, Bawa et al., 2005): each tree is a sorted
array of long hash strings; a query descends to its longest prefix matches and then all trees ascend together,
one bit at a time, until there are enough candidates, which are scored exactly."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm.common import table

BITS = 24


class Forest:
    """Trees over the rows of one block.

    Largest inner product is turned into smallest angle by one more coordinate, sqrt(M^2 - |x|^2) with M the
    largest norm of the block; queries have 0 there.  Each bit of a hash string is the side of a random plane.
    """

    def __init__(self, rows: np.ndarray, trees: int, seed: int) -> None:
        n, dim = rows.shape
        norms = np.einsum("ij,ij->i", rows, rows)
        lift = np.sqrt(np.maximum(norms.max(initial=0.0) - norms, 0.0))
        self.planes = np.random.default_rng([seed, dim]).standard_normal((trees, dim + 1, BITS))
        self.weights = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        lifted = np.hstack([rows, lift[:, None]])
        strings = [self._hash(lifted, t) for t in range(trees)]
        self.order = [np.argsort(s, kind="stable").astype(np.int32) for s in strings]
        self.sorted = [s[o] for s, o in zip(strings, self.order, strict=True)]
        self.n, self.trees = n, trees

    def _hash(self, lifted: np.ndarray, tree: int) -> np.ndarray:
        return ((lifted @ self.planes[tree]) > 0) @ self.weights

    def candidates(self, queries: np.ndarray, enough: int) -> list[np.ndarray]:
        """Rows that share the longest prefixes with each query.  A level is taken whole in all trees, so that
        rows with equal hash strings, such as copies, are found together."""
        lifted = np.hstack([queries, np.zeros((len(queries), 1))])
        strings = [self._hash(lifted, t) for t in range(self.trees)]
        found: list[np.ndarray | None] = [None] * len(queries)
        live = np.arange(len(queries))
        for bits in range(BITS, -1, -1):  # at 0 bits every row is a candidate
            shift = BITS - bits
            low, high = [], []
            for t in range(self.trees):
                prefix = strings[t][live] >> shift
                low.append(np.searchsorted(self.sorted[t], prefix << shift, "left"))
                high.append(np.searchsorted(self.sorted[t], (prefix + 1) << shift, "left"))
            low_, high_ = np.array(low), np.array(high)
            likely = (high_ - low_).sum(0) >= min(enough, self.n)
            rest = []
            for k, q in enumerate(live):
                if likely[k] or bits == 0:
                    hit = np.zeros(self.n, dtype=bool)
                    for t in range(self.trees):
                        hit[self.order[t][low_[t, k] : high_[t, k]]] = True
                    if bits == 0 or int(hit.sum()) >= min(enough, self.n):
                        found[q] = np.flatnonzero(hit)
                        continue
                rest.append(q)
            live = np.array(rest, dtype=np.int64)
            if not len(live):
                break
        return found


def _vectors(column: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in column])


RESULT = "query_id long, vec_id long, score double"


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, trees: int = 64, share: float = 0.45, block_rows: int = 4096, query_rows: int = 4096, seed: int = 7, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """query_id, rank from 1, vec_id and score of the k nearest found of each query among all rows but its own.

    Rows and queries are dealt into blocks by a hash of their id; each task joins one block of either, builds the
    forest of its rows and scores at least `share` of them for each query, in double precision.  The k best of
    each block meet in one more aggregation.  Rows of different length are never compared.  Ties go to the
    smaller id.  Null, zero or empty vectors and those with null or non-finite components take no part.  Rows
    that repeat an id count once for each row.  A table with no vectors or no queries gives no rows.
    """

    def sound(df: DataFrame) -> DataFrame:
        v = F.col(vec).cast("array<double>")
        finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        rows = df.where(F.col(key).isNotNull() & F.col(vec).isNotNull()).select(F.col(key).cast("long").alias("id"), v.alias("v"))
        finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        return rows.where(finite & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))

    base, asked = sound(vectors), sound(queries)
    row_blocks = max(1, -(-base.count() // block_rows))
    query_blocks = max(1, -(-asked.count() // query_rows))
    own = F.pmod(F.xxhash64("id"), F.lit(row_blocks)).cast("int")
    of_query = F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = base.select("id", "v", "dim", own.alias("rb"), every(query_blocks).alias("qb"))
    right = asked.select("id", "v", "dim", of_query.alias("qb"), every(row_blocks).alias("rb"))

    def join(rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(wanted):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids, x = rows["id"].to_numpy(), _vectors(rows["v"])
        at = np.argsort(ids, kind="stable")
        ids, x = ids[at], x[at]
        forest = Forest(x, trees, seed)
        asked_ids, q = wanted["id"].to_numpy(), _vectors(wanted["v"])
        out = []
        for i, cand in enumerate(forest.candidates(q, int(np.ceil(share * len(ids))) + k)):
            cand = cand[ids[cand] != asked_ids[i]]
            if len(cand) > k:  # a product of the whole block may round differently from row to row; equal rows must tie
                rough = x[cand] @ q[i]
                least = np.partition(rough, len(rough) - k)[len(rough) - k]
                cand = cand[rough >= least - 1e-9 * max(1.0, abs(least))]
            scores = (x[cand] * q[i]).sum(axis=1)
            best = np.lexsort((ids[cand], -scores))[:k]
            out.append(pd.DataFrame({"query_id": asked_ids[i], "vec_id": ids[cand][best], "score": scores[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    keys = ["rb", "qb", "dim"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(join, RESULT)
    entry = F.struct((-F.col("score")).alias("minus"), F.col("vec_id"), F.col("score"))
    best = found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(entry)), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("p", "e")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), F.col("e.score").alias("score"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
