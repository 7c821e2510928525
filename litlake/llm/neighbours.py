"""Approximate nearest neighbours by stable projections, a kd-tree and a chi-square stop.

Gaussian projections are stable: for points at distance r, the squared projected
distance divided by r squared has a chi-square distribution with as many degrees
of freedom as there are projections. Candidates are dealt in blocks; a block's
projected points stand in a kd-tree, and a query visits its cells from near to
far, scoring the points of each on the original vectors. It stops when a point
nearer than the worst of its best would, with probability 1 - MISS, have been
projected nearer than the next cell.

Largest inner product becomes least distance by one more coordinate, which brings
every candidate to the greatest norm of its block and is 0 for queries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from litlake.llm.common import column, written

PROJECTIONS = 8
LEAF = 256
#: Probability with which a neighbour of a query's list may be missed, in its block.
MISS = 0.1
#: Candidates of a block and queries of a block; one task holds one of each.
BLOCK = 20_000
QUERY_BLOCK = 4_000
SEED = 11


def chi_square_tail(x: np.ndarray, freedom: int) -> np.ndarray:
    """Probability that a chi-square variable of an even number of degrees exceeds ``x``."""
    half = x / 2
    term = np.ones_like(half)
    total = np.ones_like(half)
    for i in range(1, freedom // 2):
        term = term * half / i
        total = total + term
    return np.exp(-half) * total


def stop_ratio(miss: float, freedom: int) -> float:
    """The squared ratio of distances beyond which the chance of a miss is ``miss`` at most."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_tail(np.array(mid), freedom) > miss else (low, mid)
    return high


class KdTree:
    """Cells of at most LEAF points, cut at the median of their widest coordinate."""

    def __init__(self, points: np.ndarray):
        cells = []
        stack = [np.arange(len(points))]
        while stack:
            own = stack.pop()
            spread = np.ptp(points[own], axis=0)
            if len(own) <= LEAF or not spread.max():
                cells.append(own)
                continue
            order = own[np.argsort(points[own, spread.argmax()], kind="stable")]
            stack += [order[: len(order) // 2], order[len(order) // 2 :]]
        self.order = np.concatenate(cells)
        self.ends = np.cumsum([len(c) for c in cells])
        self.starts = self.ends - [len(c) for c in cells]
        self.low = np.array([points[c].min(0) for c in cells])
        self.high = np.array([points[c].max(0) for c in cells])

    def distances(self, point: np.ndarray) -> np.ndarray:
        """Squared distance of ``point`` to each cell's box."""
        outside = np.maximum(self.low - point, 0) + np.maximum(point - self.high, 0)
        return (outside * outside).sum(1)


def search_block(
    ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, miss: float
) -> list[tuple[int, int, float]]:
    """The ``k`` best candidates found for each query: query id, id, inner product."""
    norms = (vectors * vectors).sum(1)
    most = norms.max()
    lifted = np.hstack([vectors, np.sqrt(np.maximum(most - norms, 0))[:, None]])
    plane = np.random.default_rng(SEED).standard_normal((lifted.shape[1], PROJECTIONS))
    tree = KdTree(lifted @ plane)
    near = queries @ plane[:-1]
    # Rows in the order of their cells: a cell is then a slice.
    ids, vectors = ids[tree.order], vectors[tree.order]
    size = (queries * queries).sum(1)
    ratio = stop_ratio(miss, PROJECTIONS)
    slack = 8 * vectors.shape[1] * np.finfo(float).eps * np.sqrt(most * size)
    out = []
    for q in range(len(queries)):
        far = tree.distances(near[q])
        order = np.argsort(far, kind="stable")
        best_id, best = np.zeros(0, np.int64), np.zeros(0)
        done, take = 0, 4
        while done < len(order):
            if len(best) >= k:
                worst = most + size[q] - 2 * best[k - 1]
                if far[order[done]] > ratio * max(worst, 0):
                    break
            cells = [slice(tree.starts[c], tree.ends[c]) for c in order[done : done + take]]
            done, take = done + take, min(2 * take, 16)
            own, some = np.concatenate([ids[c] for c in cells]), np.concatenate([vectors[c] for c in cells])
            kept = own != query_ids[q]
            if len(best) >= k:
                # The fast product's last bits depend on a row's place; it only rules out.
                kept &= some @ queries[q] >= best[k - 1] - slack[q]
            # Summed row by row in one order: equal vectors have equal scores.
            score = (some[kept] * queries[q]).sum(1)
            best_id, best = np.r_[best_id, own[kept]], np.r_[best, score]
            if len(best) >= k:
                pick = np.lexsort((best_id, -best))[:k]
                best_id, best = best_id[pick], best[pick]
        order = np.lexsort((best_id, -best))
        out += [(int(query_ids[q]), int(best_id[i]), float(best[i])) for i in order]
    return out


def usable(vector: Column) -> Column:
    """Whether a vector is neither null, empty nor zero, and all its components are finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~odd & F.exists(vector, lambda x: x != 0)


def nearest(
    vectors: DataFrame,
    k: int = 20,
    every: int = 20,
    miss: float = MISS,
    block: int = BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """Nearest rows of the rows whose vec_id is divisible by ``every``: query_id, rank, vec_id, score.

    Vectors with a null id, and vectors null, empty, zero or with null or
    non-finite components take no part. Vectors of different lengths never meet.
    Rows that share the query's id are its own row. Equal scores order by vec_id.
    Of equal vectors only the k + 1 smallest ids can be in a list of k, so no more
    are indexed. Fewer candidates give all of them; an empty table an empty result.
    """
    rows = vectors.select(
        column(vectors, "vec_id", "long"), column(vectors, "embedding", "array<double>")
    ).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    plain = F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))
    rows = rows.withColumn("embedding", plain).withColumn("width", F.size("embedding"))
    alike = W.partitionBy("embedding").orderBy("vec_id")
    base = rows.distinct().withColumn("copy", F.row_number().over(alike)).where(F.col("copy") <= k + 1)
    base = written(base.drop("copy"), "base")
    queries = written(rows.where(F.pmod("vec_id", F.lit(every)) == 0).distinct(), "queries")
    n_base, n_queries = base.count(), queries.count()
    blocks, query_blocks = -(-n_base // block) or 1, -(-n_queries // query_block) or 1
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    dealt = base.select(
        own(blocks).alias("b"),
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"),
        "width",
        "vec_id",
        "embedding",
        F.lit(False).alias("asks"),
    ).unionByName(
        queries.select(
            F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"),
            own(query_blocks).alias("q"),
            "width",
            "vec_id",
            "embedding",
            F.lit(True).alias("asks"),
        )
    )

    def search(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy()
        ids = group.column("vec_id").to_numpy()
        width = group.column("width")[0].as_py()
        flat = group.column("embedding").combine_chunks().flatten().to_numpy().reshape(-1, width)
        order = np.argsort(ids, kind="stable")
        asks, ids, flat = asks[order], ids[order], flat[order]
        found = []
        if asks.any() and not asks.all():
            found = search_block(ids[~asks], flat[~asks], ids[asks], flat[asks], k, miss)
        q, v, s = zip(*found, strict=True) if found else ((), (), ())
        return pa.table(
            {"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())}
        )

    found = dealt.groupBy("b", "q", "width").applyInArrow(
        search, "query_id long, vec_id long, score double"
    )
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
