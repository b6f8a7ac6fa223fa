"""Near-duplicate vectors: random-hyperplane sign hashing in several tables,
exact cosine verification, distributed connected components.

Exact copies (same label, same components) are one class and meet as one row
with a count. Class representatives are hashed by the signs of random
projections; rows that share a label and the signature of a table form a
bucket, and all pairs of a bucket are compared by cosine in double precision.
A pair that meets in several tables counts in the first one only. Buckets are
cut into blocks, so a task holds two blocks at most however large a bucket is;
a block pair returns links per row and a spanning forest of its links, not its
pairs.

The number of tables follows from the bits of a signature and the wanted
recall at the threshold: a pair at angle a agrees on a sign with probability
``1 - a / pi``. The bits grow with the logarithm of the largest label.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlstrata.llm.common import connected_components, matrix, shuffle_parts, whole_runs, written

THRESHOLD = 0.93
#: Probability that a pair just at the threshold meets in some table.
RECALL = 0.985
SEED = 7_919
#: Rows of a bucket that are compared with each other at once.
BLOCK = 512


def n_tables(bits: int, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(1 - recall) / math.log(1 - agree))


def planes(dim: int, tables: int, bits: int, seed: int = SEED) -> np.ndarray:
    return np.random.RandomState((seed * 31 + dim) % (1 << 32)).standard_normal((dim, tables * bits))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                    threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per input row: ``vec_id, n_links, component_id, kept``.

    Vectors link when their labels are equal and not null, their lengths are
    equal and their cosine is at least ``threshold``. A vector that is null,
    empty, zero or holds null or non-finite components, and a row with a null
    id, links with nothing (a null id has no component and is not kept). Rows
    that repeat a vector are copies, which link with each other, also under
    one id. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"),
                          F.col(label_col).cast("string").alias("label"))
    fine = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                      & F.exists("v", lambda x: x != 0), F.lit(False))
    fine = fine & F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    rows = rows.withColumn("fine", fine)
    h = [F.when(F.col("fine"), F.xxhash64("label", "v", F.lit(s))) for s in (1, 2)]
    rows = rows.select("vec_id", F.when(F.col("fine"), F.col("v")).alias("v"), "label", h[0].alias("h1"), h[1].alias("h2"))
    rows = written(rows, "vectors")
    classes = rows.filter("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = written(classes, "classes")
    reps = (rows.join(classes, ["h1", "h2"]).filter("vec_id = rep").select("rep", "h1", "n", "label", "v")
            .dropDuplicates(["rep", "h1"]))
    reps = written(reps, "reps")
    most = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    bits = max(8, min(30, math.ceil(math.log2(max(2, most)))))
    tables = n_tables(bits, threshold, recall)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        weight = 1 << np.arange(bits, dtype=np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                v = b.column(4)
                size = pc.list_value_length(v).to_numpy()
                out = np.zeros((b.num_rows, tables), np.int64)
                for d in np.unique(size).tolist():  # one length, as a rule
                    if d not in kept:
                        kept[d] = planes(d, tables, bits)
                    pick = np.flatnonzero(size == d)
                    x = matrix(v.take(pa.array(pick)))
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    s = (x @ kept[d] > 0).reshape(len(pick), tables, bits)
                    out[pick] = s @ weight
                sigs = pa.ListArray.from_arrays((np.arange(b.num_rows + 1) * tables).astype(np.int32), pa.array(out.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*b.columns, sigs], names=["rep", "h1", "n", "label", "v", "sigs"])

    signed = written(reps.mapInArrow(sign, "rep long, h1 long, n long, label string, v array<double>, sigs array<long>"), "signed")
    # bucket = (label and length, table, signature) as one key; sizes first
    keys = signed.select("rep", "h1", F.xxhash64("label", F.size("v")).alias("l"), F.posexplode("sigs").alias("t", "sig"))
    sizes = keys.groupBy("l", "t", "sig").agg(F.count("*").alias("m")).filter("m > 1")
    sizes = sizes.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).drop("m")
    placed = keys.join(sizes, ["l", "t", "sig"])
    own = F.pmod(F.xxhash64("rep", F.lit(3)), F.col("blocks")).cast("int")
    placed = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # block pair (a, b) with a <= b gets the rows of both
    placed = placed.select("rep", "h1", "t", F.xxhash64("l", "t", "sig", F.least("own", "other"), F.greatest("own", "other")).alias("g"),
                           "own", "other")
    meet = placed.join(signed, ["rep", "h1"]).select(
        "g", "t", "own", (F.col("own") == F.col("other")).alias("alone"), "rep", "h1", "n", "v", "sigs")
    meet = meet.repartition(shuffle_parts(spark), "g").sortWithinPartitions("g", "t", "own", "rep")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in whole_runs(batches, ["g", "t"], 4096):
            rep, h1, copies = (t.column(c).to_numpy() for c in ("rep", "h1", "n"))
            own, table = t.column("own").to_numpy(), t.column("t").to_numpy()
            alone = t.column("alone").to_numpy()
            sigs = matrix(t.column("sigs"))
            size = pc.list_value_length(t.column("v")).to_numpy()
            links, low = np.zeros(t.num_rows, np.int64), np.arange(t.num_rows)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if b - a < 2 or size[a] != size[b - 1]:
                    continue
                x = matrix(t.column("v").slice(a, b - a))
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                if alone[a]:
                    i, j = np.nonzero(np.triu(x @ x.T >= threshold, 1))
                else:
                    k = int(np.searchsorted(own[a:b], own[a], side="right"))
                    i, j = np.nonzero(x[:k] @ x[k:].T >= threshold)
                    j = j + k
                if not len(i):
                    continue
                i, j = i + a, j + a
                now = int(table[a])
                if now:
                    new = ~np.any(sigs[i, :now] == sigs[j, :now], axis=1)
                    i, j = i[new], j[new]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                while True:  # smallest row reachable within the block pair
                    least = np.minimum(low[i], low[j])
                    if (low[i] == least).all() and (low[j] == least).all():
                        break
                    np.minimum.at(low, i, least)
                    np.minimum.at(low, j, least)
            hit = np.flatnonzero((links > 0) | (low != np.arange(len(low))))
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(rep[hit]), pa.array(h1[hit]),
                                                  pa.array(links[hit]), pa.array(rep[low[hit]])], names=["rep", "h1", "links", "to"])

    found = written(meet.mapInArrow(compare, "rep long, h1 long, links long, to long"), "links")
    links = found.groupBy("rep", "h1").agg(F.sum("links").alias("links"))
    parts = connected_components(found.filter("rep <> to"), "rep", "to").withColumnRenamed("node", "rep")
    summary = classes.join(links, ["rep", "h1"], "left").join(parts, "rep", "left").select(
        "h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = rows.select("vec_id", "h1", "h2").join(summary, ["h1", "h2"], "left")
    comp = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"),
                      F.coalesce(F.col("vec_id") == comp, F.lit(False)).alias("kept"))


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
