"""Exact top-k by inner product as a Voronoi kNN join.

Vectors fall to the nearest of a few pivots. Each group is summarised by its size, its largest distance from the pivot
and its least such distances; only these summaries reach the driver. For a query q and a group around p,
q.x = q.p + q.(x - p), so |q| times those distances bounds every score in the group from above and the k best of it from below.
Of a query whose id has m rows, the (k + m)-th best lower bound over all groups is a score that k candidates are sure to
reach, own rows left out; a query goes only to groups whose upper bound is not below it. Groups are solved in cells of bounded size, so a hot group is spread.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

PIVOTS, CELL = 32, 4096
#: Rows of one query id that the bounds allow for; queries of more see every group.
OWN = 64
#: Rows of a score matrix computed at once, and what a double sums exactly.
QUERY_ROWS, EXACT = 256, 2**52


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Binary rows of little-endian longs, padded with zeros to one width."""
    rows = [np.frombuffer(b, "<i8") for b in column.to_pylist()]
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products. In doubles where every partial sum is exact, else in longs."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most < EXACT:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def best(q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, x_ids: np.ndarray, x: np.ndarray, k: int):
    """(query row, vec_id, score) of each query's k best in a cell, its own id left out, scores below least too."""
    order = np.argsort(x_ids, kind="stable")
    x_ids, x = x_ids[order], x[order]
    out = []
    for at in range(0, len(q), QUERY_ROWS):
        s = scores(q[at : at + QUERY_ROWS], x)
        ids = q_ids[at : at + QUERY_ROWS]
        ok = (x_ids[None, :] != ids[:, None]) & (s >= least[at : at + QUERY_ROWS, None])
        s = np.where(ok, s, np.iinfo(np.int64).min)
        if s.shape[1] > k:
            edge = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            ok &= s >= edge[:, None]
        r, c = np.nonzero(ok)
        v = s[r, c]
        by = np.lexsort((c, -v, r))
        r, c, v = r[by], c[by], v[by]
        first = np.searchsorted(r, np.arange(len(ids)))
        top = np.arange(len(r)) - first[r] < k
        out.append((r[top] + at, x_ids[c[top]], v[top]))
    return [np.concatenate(p) if out else np.zeros(0, np.int64) for p in zip(*out)] if out else [np.zeros(0, np.int64)] * 3


def _assign(pivots: np.ndarray, width: int, far: bool):
    """Adds the nearest pivot and the distance to it. far: distances to all pivots matter not."""

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("_v"), width).astype(np.float64)
            d2 = (x * x).sum(1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(1)
            g = d2.argmin(1)
            d = np.sqrt(((x - pivots[g]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_v"), pa.array(g.astype(np.int32)), pa.array(d)], ["_id", "_v", "_g", "_d"])

    return run


def _route(pivots: np.ndarray, width: int, sizes: np.ndarray, radius: np.ndarray, near: list[np.ndarray], k: int, own: int):
    """Adds the groups that a query must see and the score that its k-th best is sure to reach."""
    ks = [np.arange(min(k + own, int(n))) for n in sizes]
    owner = np.concatenate([np.full(len(r), g) for g, r in enumerate(ks)]) if ks else np.zeros(0, int)
    reach = np.concatenate([near[g][: len(r)] for g, r in enumerate(ks)]) if ks else np.zeros(0)

    def run(batches):
        for batch in batches:
            q = _matrix(batch.column("_v"), width).astype(np.float64)
            norm = np.sqrt((q * q).sum(1)) * (1 + 1e-9)
            to = q @ pivots.T
            slack = 1e-6 * (1 + np.abs(to))
            upper = to + norm[:, None] * radius[None, :] + slack
            lower = to[:, owner] - norm[:, None] * reach[None, :] - slack[:, owner]
            # k + m rows, as the m rows of the query's id may be among them
            m = batch.column("_m").to_numpy()
            sure = np.full(len(q), -np.inf)
            for n in np.unique(m[(m <= own) & (k + m <= lower.shape[1])]):
                at = lower.shape[1] - k - n
                sure[m == n] = np.partition(lower[m == n], at, axis=1)[:, at]
            groups = [np.nonzero((u >= s) & (sizes > 0))[0].tolist() for u, s in zip(upper, sure)]
            least = np.maximum(np.floor(sure), -(2.0**62)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_v"), pa.array(least), pa.array(groups, pa.list_(pa.int32()))], ["_id", "_v", "_least", "_groups"])

    return run


def scaled(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(_id, _v): each component x as floor(scale * x), packed as little-endian longs; rows whose vector is null or
    holds null or non-finite components, or whose id is null, are left out."""
    bad = F.exists("_x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = embeddings.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<double>").alias("_x")).where("_id is not null and _x is not null").where(~bad)

    def pack(batches):
        for batch in batches:
            v = [np.floor(scale * np.array(x, np.float64)).astype("<i8").tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(v, pa.binary())], ["_id", "_v"])

    return rows.mapInArrow(pack, "_id long, _v binary")


def top_k(embeddings: DataFrame, is_query=None, k: int = 20, pivots: int = PIVOTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k best candidates, all if fewer; ties to the smaller id.

    is_query: a condition on the id column; by default ids divisible by 20. Every usable row but those with the query's
    own id is a candidate; repeated candidate rows each count; a query id that repeats is asked once, with its least
    vector. Vectors of different lengths compare as if padded with zeros. Scores must fit in a long.
    An empty table, or one vector, gives no rows.
    """
    spark = embeddings.sparkSession
    data = written(scaled(embeddings, id_col, vector_col), "vectors")
    # the pivots: a bounded sample, alike on every run
    sample = [np.frombuffer(r["_v"], "<i8") for r in data.orderBy(F.xxhash64("_id"), "_id", "_v").limit(pivots).collect()]
    result = "query_id long, rank int, vec_id long, score long"
    if not sample:
        return spark.createDataFrame([], result)
    width = data.agg(F.max(F.octet_length("_v"))).first()[0] // 8
    p = np.zeros((len(sample), max(1, width)))
    for i, r in enumerate(sample):
        p[i, : len(r)] = r
    width = p.shape[1]
    grouped = written(data.mapInArrow(_assign(p, width, False), "_id long, _v binary, _g int, _d double"), "vectors")
    order = W.partitionBy("_g").orderBy("_d")
    summary = {r["_g"]: r for r in grouped.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.max("_d").alias("far")).collect()}
    is_query = (F.col("_id") % 20 == 0) if is_query is None else is_query(F.col("_id"))
    asked = written(grouped.where(is_query).groupBy("_id").agg(F.min("_v").alias("_v"), F.count(F.lit(1)).alias("_m")), "vectors")
    own = min(OWN, asked.agg(F.max("_m")).first()[0] or 1)
    # the k + own least distances of each group; the limit is pushed below the exchange
    close: dict[int, list[float]] = {}
    for r in grouped.select("_g", "_d", F.row_number().over(order).alias("_r")).where(F.col("_r") <= k + own).collect():
        close.setdefault(r["_g"], []).append(r["_d"])
    sizes = np.array([summary[g]["n"] if g in summary else 0 for g in range(len(p))])
    radius = np.array([summary[g]["far"] if g in summary else 0.0 for g in range(len(p))])
    near = [np.sort(np.array(close.get(g, []))) for g in range(len(p))]
    cells = F.element_at(F.array(*[F.lit(max(1, -(-int(n) // CELL))) for n in sizes]), F.col("_g") + 1)
    routed = asked.mapInArrow(_route(p, width, sizes, radius, near, k, own), "_id long, _v binary, _least long, _groups array<int>")
    asks = routed.select("_id", "_v", "_least", F.explode("_groups").alias("_g")).withColumn("_c", F.explode(F.sequence(F.lit(0), cells - 1)))
    held = grouped.select("_id", "_v", "_g", F.pmod(F.xxhash64("_id", F.col("_v")), cells).cast("int").alias("_c"))

    def solve(key, left, right):
        q_ids, x_ids = left.column("_id").to_numpy(), right.column("_id").to_numpy()
        if not len(q_ids) or not len(x_ids):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        row, ids, s = best(q_ids, _matrix(left.column("_v"), width), left.column("_least").to_numpy(), x_ids, _matrix(right.column("_v"), width), k)
        return pa.table({"query_id": pa.array(q_ids[row]), "vec_id": pa.array(ids), "score": pa.array(s)})

    local = asks.groupBy("_g", "_c").cogroup(held.groupBy("_g", "_c")).applyInArrow(solve, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
