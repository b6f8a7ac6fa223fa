"""Exact top-k by inner product over a pivot-distance index.

Inner products become distances: with ``M`` the largest norm, a row ``x`` is
the point ``(x, sqrt(M^2 - |x|^2))`` and a query ``q`` the point ``(q, 0)``, so
``d(q, x)^2 = |q|^2 + M^2 - 2 q.x`` and the largest products are the nearest
points.

Index: every row is keyed by its nearest pivot and its distance to it. Rows
sorted by that key are cut into annuli, runs of at most ``ANNULUS`` rows of one
pivot with a range of distances. A range partitioning on the key deals a hot
pivot out over many tasks.

Search: queries are gathered in blocks too. An annulus ``[lo, hi]`` around
pivot ``p`` can hold nothing nearer to a query than
``max(0, d(q, p) - hi, lo - d(q, p))``. Each query block meets the annuli in
the order of that bound, a few at first and ever more; after each round its
k-th products give the radius beyond which no annulus can improve a result,
and the search stops when none is left within it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sqlstrata.llm.common import shuffle_parts, written

PIVOTS = 32
ANNULUS = 4096
#: Queries that share their work on an annulus.
QUERY_BLOCK = 1024
#: Annuli per query block in the first round, and the growth of later rounds.
FIRST, GROWTH = 4, 8
_EPS = 1e-9


def _floor_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(v) > 0)
    rows = vectors.filter(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"),
                       F.transform(v, lambda x: F.floor(x * scale).cast("double")).alias("v"))


def _lists(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _by_pivot(rows: DataFrame, pivots: np.ndarray, top: float) -> DataFrame:
    """Nearest pivot and distance to it of every row (as a point of the index)."""
    norms = (pivots * pivots).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            x = _lists(b.column(1))
            lift = np.sqrt(np.maximum(0, top - (x * x).sum(axis=1)))
            x = np.column_stack([x, lift])
            d = np.sqrt(np.maximum(0, (x * x).sum(axis=1)[:, None] + norms - 2 * x @ pivots.T))
            near = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near.astype(np.int32)),
                                              pa.array(d[np.arange(len(d)), near])], names=["vec_id", "v", "pivot", "dist"])

    return rows.mapInArrow(run, "vec_id long, v array<double>, pivot int, dist double")


def _blocks(rows: DataFrame, limit: int, one_pivot: bool, queries: bool, pivots: np.ndarray) -> DataFrame:
    """Runs of the sorted rows as one row each. For queries
    also the range of distances from the block's points to every pivot."""
    norms = (pivots * pivots).sum(axis=1)
    names = ["block", "pivot", "lo", "hi", "far_lo", "far_hi", "norm", "ids", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def flush(t: pa.Table) -> pa.RecordBatch:
            nonlocal n
            t = t.combine_chunks()
            x = t.column("v").chunk(0).flatten().to_numpy().reshape(t.num_rows, -1)
            dist = t.column("dist").to_numpy()
            far = np.zeros((2, 0))
            if queries:
                d = np.sqrt(np.maximum(0, (x * x).sum(axis=1)[:, None] + norms - 2 * x @ pivots[:, :-1].T))
                far = np.stack([d.min(axis=0), d.max(axis=0)])
            row = pa.RecordBatch.from_arrays([
                pa.array([part << 32 | n], pa.int64()), pa.array([t.column("pivot")[0].as_py()], pa.int32()),
                pa.array([dist.min()]), pa.array([dist.max()]), pa.array([far[0].tolist()], pa.list_(pa.float64())),
                pa.array([far[1].tolist()], pa.list_(pa.float64())), pa.array([float((x * x).sum(axis=1).max())]),
                pa.array([t.column("vec_id").to_numpy().tobytes()], pa.binary()),
                pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())], names=names)
            n += 1
            return row

        size = 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                pivot = b.column(2)
                if one_pivot and held and held[0].column(2)[0].as_py() != pivot[at].as_py():
                    yield flush(pa.Table.from_batches(held))
                    held, size = [], 0
                to = min(b.num_rows, at + limit - size)
                if one_pivot:
                    p = pivot.to_numpy()[at:to]
                    to = at + int(np.searchsorted(p, p[0], side="right"))
                held.append(b.slice(at, to - at))
                size += to - at
                at = to
                if size == limit:
                    yield flush(pa.Table.from_batches(held))
                    held, size = [], 0
        if held:
            yield flush(pa.Table.from_batches(held))

    parts = shuffle_parts(rows.sparkSession)
    dealt = rows.repartitionByRange(parts, "pivot", "dist", "vec_id").sortWithinPartitions("pivot", "dist", "vec_id")
    return dealt.mapInArrow(run, "block long, pivot int, lo double, hi double, far_lo array<double>, far_hi array<double>, "
                                 "norm double, ids binary, data binary")


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                q_ids, q, r_ids, r, least = (b.column(c)[i].as_py() for c in range(5))
                q_ids, r_ids = np.frombuffer(q_ids, np.int64), np.frombuffer(r_ids, np.int64)
                q, r = (np.frombuffer(x, np.float64).reshape(len(n), -1) for x, n in ((q, q_ids), (r, r_ids)))
                if q.shape[1] != r.shape[1]:
                    continue
                if np.abs(q).max() * np.abs(r).max() * q.shape[1] < 2 ** 53:
                    s = q @ r.T  # every partial sum is exact
                else:
                    s = (q.astype(np.int64)[:, None, :] * r.astype(np.int64)[None]).sum(axis=2).astype(np.float64)
                own = q_ids[:, None] == r_ids[None]
                s[own] = -np.inf
                keep = s.shape[1] - min(k, s.shape[1])
                edge = np.partition(s, keep, axis=1)[:, keep]
                qi, ri = np.nonzero((s >= edge[:, None]) & (s >= least) & ~own)
                sc = s[qi, ri]
                order = np.lexsort((r_ids[ri], -sc, qi))
                qi, ri, sc = qi[order], ri[order], sc[order]
                first = np.searchsorted(qi, qi)  # place in its query's list
                pick = np.arange(len(qi)) - first < k
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[qi[pick]]), pa.array(r_ids[ri[pick]]),
                                                  pa.array(sc[pick].astype(np.int64))], names=["query_id", "vec_id", "score"])
    return run


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: float = 1024.0, id_col: str = "vec_id",
          vec_col: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row whose id is divisible
    by ``every`` the ``k`` other rows of largest inner product of the vectors
    ``floor(scale * x)``, ties to the smaller id.

    A vector that is null, empty or holds null or non-finite components, and a
    row with a null id, takes no part. Vectors of different lengths do not
    meet. Rows that repeat an id are one row if equal; else they are distinct
    candidates, none of which answers its own id. Fewer than ``k`` candidates
    give fewer rows, an empty table none. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = written(_floor_vectors(vectors, id_col, vec_col, scale).dropDuplicates(["vec_id", "v"])
                   .withColumn("dim", F.size("v")), "floors")
    found = None
    for dim in sorted(r["dim"] for r in rows.select("dim").distinct().collect()):  # one length, as a rule
        part = _one_length(spark, rows.filter(F.col("dim") == dim).drop("dim"), k, every, pivots)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _one_length(spark: SparkSession, rows: DataFrame, k: int, every: int, pivots: int) -> DataFrame:
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    top = rows.agg(F.max(norm)).first()[0] * (1 + 1e-12)
    # a fixed number of rows, by hash
    sample = np.array([r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()])
    point = np.column_stack([sample, np.sqrt(np.maximum(0, top - (sample * sample).sum(axis=1)))])
    keyed = written(_by_pivot(rows, point, top), "keyed")
    index = written(_blocks(keyed, ANNULUS, True, False, point).drop("far_lo", "far_hi", "norm"), "annuli")
    asked = written(_blocks(keyed.filter(F.col("vec_id") % every == 0), QUERY_BLOCK, False, True, point).select(
        F.col("block").alias("q_block"), "far_lo", "far_hi", "norm", F.col("ids").alias("q_ids"), F.col("data").alias("q_data")), "queries")
    reach = asked.select("q_block", "norm", F.posexplode(F.arrays_zip("far_lo", "far_hi")).alias("pivot", "far"))
    bound = F.greatest(F.lit(0.0), F.col("far.far_lo") - F.col("hi"), F.col("lo") - F.col("far.far_hi"))
    pairs = index.select("block", "pivot", "lo", "hi").join(reach, "pivot").select("q_block", "block", "norm", bound.alias("bound"))
    order = F.row_number().over(Window.partitionBy("q_block").orderBy("bound", "block"))
    pairs = written(pairs.withColumn("turn", order), "turns")
    # query ids of a block, to join results back to their block
    members = asked.select("q_block", "q_ids").mapInArrow(_unpack_ids, "q_block long, query_id long")
    members = written(members, "members")
    best, lo, hi = None, 0, FIRST
    while True:
        now = pairs.filter((F.col("turn") > lo) & (F.col("turn") <= hi))
        later = pairs.filter(F.col("turn") > lo)
        if best is not None:
            kth = best.filter(F.col("rank") == k).select("query_id", "score")
            worst = members.join(kth, "query_id", "left").groupBy("q_block").agg(
                F.when(F.count("score") == F.count("*"), F.min("score")).alias("least"))
            worst = written(worst, "worst")
            # nearer than the worst of the block's k-th results, with room for rounding
            limit = F.sqrt(F.greatest(F.lit(0.0), F.col("norm") + F.lit(top) - 2 * F.col("least"))) * (1 + _EPS) + _EPS
            near = F.col("least").isNull() | (F.col("bound") <= limit)
            later = later.join(worst, "q_block").filter(near)
            now = now.join(worst, "q_block").filter(near)
        else:
            now = now.withColumn("least", F.lit(None).cast("long"))
        if later.isEmpty():
            break
        work = (now.join(asked.select("q_block", "q_ids", "q_data"), "q_block")
                .join(index.select("block", "ids", "data"), "block")
                .select("q_ids", "q_data", "ids", "data", F.coalesce(F.col("least").cast("double"), F.lit(float("-inf"))).alias("least")))
        work = work.repartition(shuffle_parts(spark))
        got = work.mapInArrow(_search(k), "query_id long, vec_id long, score long")
        if best is not None:
            got = got.unionByName(best.drop("rank"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        best = written(got.withColumn("rank", rank).filter(F.col("rank") <= k), "best")
        lo, hi = hi, hi * GROWTH
    if best is None:
        return spark.createDataFrame([], "query_id long, vec_id long, score long")
    return best.drop("rank")


def _unpack_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for block, ids in zip(b.column(0), b.column(1)):
            v = np.frombuffer(ids.as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), block.as_py())), pa.array(v)], names=["q_block", "query_id"])


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
