"""Mixing sources to target weights by subset sums of document lengths.

Each source has a target number of words. Whole rounds over the source come
first (``target // size`` copies of every document). The remaining budget is
fitted on the histogram of exact document lengths: an equal share of every
length, then a bounded-knapsack dynamic programme over the lengths left for
what is still open. Documents of a length are interchangeable, so the solution
is a number of documents per length; which ones is decided by a seeded hash.

The histogram and everything after it are small next to the texts: the texts
are read once, for their lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlstrata.llm.common import n_words_expr, slices, text_buffer, word_spans, written

#: Weights of the sources in code-point order (null last), repeating.
WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
SEED = 20_240
#: Sums that the programme's table has. Where more words are open, the longest documents
#: are taken first until they fit; the programme then decides all the rest.
DP_WORDS = 1 << 22
#: Documents that are ranked together when a length is split.
RANKED = 4096


def sizes(docs: DataFrame, text_col: str = "text", keep_text: bool = False, name: str = "size") -> DataFrame:
    """``docs`` with ``size`` (or ``name``), the number of words of ``text_col`` (null: 0),
    in place of the text (or beside it)."""
    names = docs.columns
    kept = [i for i, c in enumerate(names) if keep_text or c != text_col]
    schema = T.StructType([docs.schema[i] for i in kept]).add(name, T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, text_col):
                data, off = text_buffer(b.column(names.index(text_col)))
                _, _, row = word_spans(data, off)
                n = pa.array(np.bincount(row, minlength=b.num_rows), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(i) for i in kept] + [n], names=[names[i] for i in kept] + [name])

    return docs.mapInArrow(run, schema)


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target): all words are shared by weight; a target
    stops at ``most`` times its source's size, and the excess is shared again
    by weight among the others until none is above."""
    spark = sized.sparkSession
    src = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row per source name
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    src = written(src.select("source", "source_size", pick.alias("weight")), "sources")
    level = 0.0
    while True:  # the level only rises, and each round caps one source at least
        full = F.col("weight") * F.lit(level) >= F.col("source_size") * most
        t = src.agg(F.sum("source_size").alias("all"),
                    F.sum(F.when(full, F.col("source_size") * most)).alias("full"),
                    F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not t["all"] or not t["open"]:
            break
        now = (t["all"] - (t["full"] or 0)) / t["open"]
        if now <= level:
            break
        level = now
    return src.select("source", "source_size", F.least(
        F.col("weight") * F.lit(level), F.col("source_size").cast("double") * most).alias("target"))


def fit_counts(length: np.ndarray, count: np.ndarray, budget: int, dp_words: int = DP_WORDS) -> np.ndarray:
    """Documents to take of each length so that their words come as near to
    ``budget`` as the programme finds, never above. Lengths are positive and
    distinct."""
    order = np.argsort(-length, kind="stable")
    length, count = length[order], count[order]
    whole = int((length * count).sum())
    budget = min(budget, whole)
    take = np.array([int(c) * budget // whole if whole else 0 for c in count], np.int64)
    rest = budget - int((take * length).sum())
    for i, l in enumerate(length.tolist()):  # largest first, down to the programme's size
        if rest <= dp_words:
            break
        k = min(int(count[i] - take[i]), (rest - dp_words // 2) // l)
        if k > 0:
            take[i] += k
            rest -= k * l
    # by[s]: the step that first reached the sum s
    reach, by, steps = np.zeros(rest + 1, bool), np.full(rest + 1, -1, np.int32), []
    reach[0] = True
    for i, l in enumerate(length.tolist()):
        left, part = min(int(count[i] - take[i]), rest // l), 1
        while left > 0 and not reach[rest]:
            k = min(part, left)
            new = np.flatnonzero(reach[:rest + 1 - k * l] & ~reach[k * l:]) + k * l
            reach[new], by[new] = True, len(steps)
            steps.append((i, k))
            left, part = left - k, part * 2
        if reach[rest]:
            break
    at = int(np.flatnonzero(reach)[-1])
    while at:  # a sum is first reached from one that an earlier step reached
        i, k = steps[by[at]]
        take[i] += k
        at -= k * int(length[i])
    out = np.empty_like(take)
    out[order] = take
    return out


def plan(sized: DataFrame, goal: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """(source, size, n, rounds, extra): documents of this length, copies of
    each, and how many of them get one copy more."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        whole, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        rounds = min(most, int(target // whole)) if whole else 0
        budget = int(round(target - rounds * whole)) if rounds < most else 0
        extra = np.zeros(len(pdf), np.int64)
        has = pdf["size"].to_numpy() > 0
        if budget > 0 and has.any():
            extra[has] = fit_counts(pdf["size"].to_numpy()[has], pdf["n"].to_numpy()[has], budget)
        return pd.DataFrame({"source": pdf["source"], "size": pdf["size"], "n": pdf["n"], "source_size": whole,
                             "target": target, "rounds": rounds, "extra": extra})

    hist = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    hist = hist.join(goal.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    return hist.groupBy("source").applyInPandas(
        fit, "source string, size long, n long, source_size long, target double, rounds int, extra long")


def thresholds(sized: DataFrame, todo: DataFrame) -> DataFrame:
    """``todo`` with ``upto``, ``last`` and ``ties``: documents whose hash ``u`` is below
    ``upto`` get the extra copy, and so do ``last`` of the ``ties`` whose hash it is.

    Lengths that are split are cut into ranges of the hash of about ``RANKED``
    documents, so that no task ranks a whole hot length; within a range hashes are
    counted before they are ranked, so rows of one hash are one row there."""
    split = todo.filter("extra > 0 and extra < n").select(
        F.col("source").alias("_s"), F.col("size").alias("_l"), "extra",
        F.ceil(F.col("n") / RANKED).cast("long").alias("ranges"))
    u = sized.select("source", "size", "u").join(
        split, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_l")))
    part = F.floor(F.shiftrightunsigned("u", 11).bitwiseXOR(F.lit(1 << 52)) / F.lit(float(1 << 53)) * F.col("ranges"))
    u = u.withColumn("part", part).groupBy("_s", "_l", "extra", "part", "u").agg(F.count("*").alias("m"))
    u = written(u, "hashes")
    per = u.groupBy("_s", "_l", "extra", "part").agg(F.sum("m").alias("m"))
    w = Window.partitionBy("_s", "_l").orderBy("part")
    per = per.withColumn("before", F.sum("m").over(w) - F.col("m")).filter("before < extra and before + m >= extra")
    per = per.select(F.col("_s").alias("s2"), F.col("_l").alias("l2"), F.col("part").alias("p2"), "before")
    hit = u.join(per, F.col("_s").eqNullSafe(F.col("s2")) & (F.col("_l") == F.col("l2")) & (F.col("part") == F.col("p2")))
    upto = F.sum("m").over(Window.partitionBy("_s", "_l").orderBy("u")) + F.col("before")
    cut = hit.withColumn("end", upto).filter("end >= extra and end - m < extra").select(
        "_s", "_l", F.col("u").alias("upto"), (F.col("extra") - (F.col("end") - F.col("m"))).alias("last"), F.col("m").alias("ties"))
    out = todo.join(cut, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_l")), "left")
    every = F.col("extra") >= F.col("n")
    return out.select("source", "size", "source_size", "target", "rounds",
                      F.when(F.col("extra") == 0, F.lit(None)).when(every, F.lit((1 << 63) - 1)).otherwise(F.col("upto")).alias("upto"),
                      F.when(every, 1).otherwise(F.coalesce("last", F.lit(0))).alias("last"), F.when(every, 1).otherwise(F.coalesce("ties", F.lit(0))).alias("ties"))


def _row_hash(id_col: str, text_col: str, seed: int) -> Column:
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"), F.lit(seed))


def decisions(sized: DataFrame, weights: tuple[float, ...], most: int) -> DataFrame:
    """Per source ``_s`` and length ``_l``: ``source_size, target, rounds, upto, last, ties``."""
    todo = written(plan(sized, targets(sized, weights, most), most), "mix")
    cut = thresholds(sized, todo)
    return written(cut.select(F.col("source").alias("_s"), F.col("size").alias("_l"), "source_size", "target", "rounds", "upto", "last", "ties"), "cut")


def _decided(rows: DataFrame, cut: DataFrame, most: int) -> DataFrame:
    """``rows`` (source, size, u, ...) with ``source_size``, ``target`` and ``copies``.

    Rows of the hash at which a length is split differ in nothing that the mix
    knows (id, source, text); they are numbered across partitions, without bringing
    them together: within each partition, after the counts of those before."""
    names = rows.columns
    all_ = rows.join(cut, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_l")), "left")
    more = (F.col("u") < F.col("upto")) | ((F.col("u") == F.col("upto")) & (F.col("last") == F.col("ties")))
    tied = F.coalesce((F.col("u") == F.col("upto")) & (F.col("last") < F.col("ties")), F.lit(False))
    copies = lambda extra: F.least(F.lit(most), F.col("rounds") + F.coalesce(extra.cast("int"), F.lit(0))).alias("copies")
    keep = [*names, "source_size", "target"]
    if cut.filter("last < ties").isEmpty():
        return all_.select(*keep, copies(more))
    edge = written(all_.filter(tied).withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id()), "ties")
    before = edge.groupBy("_s", "_l", "_part").agg(F.count("*").alias("_m"))
    before = before.select(F.col("_s").alias("s2"), F.col("_l").alias("l2"), F.col("_part").alias("p2"), (F.sum("_m").over(
        Window.partitionBy("_s", "_l").orderBy("_part")) - F.col("_m")).alias("_before"))
    edge = edge.join(before, F.col("_s").eqNullSafe(F.col("s2")) & (F.col("_l") == F.col("l2")) & (F.col("_part") == F.col("p2")))
    rank = F.row_number().over(Window.partitionBy("_s", "_l", "_part").orderBy("_seq")) + F.col("_before")
    return all_.filter(~tied).select(*keep, copies(more)).unionByName(edge.withColumn("_rank", rank).select(*keep, copies(F.col("_rank") <= F.col("last"))))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       F.col(text_col).cast("string").alias("text"), _row_hash(id_col, text_col, seed).alias("u"))
    return written(sizes(rows), "sizes")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies`` per input row.

    A null text has size 0, a null source is a source of its own. Which documents
    of a length get a copy more follows a hash of id and text, so rows without
    an id and rows that share one are decided one by one; rows equal in id, source and
    text are interchangeable, and as many of them as are due get it. Documents
    without words are copied with the whole rounds. Texts count whole, however long.
    Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    sized = _sized(docs, id_col, text_col, source_col, seed)
    out = _decided(sized, decisions(sized, weights, most), most)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with all their columns
    (whatever their names) and by the rules of ``mix``."""
    cut = decisions(_sized(docs, id_col, text_col, source_col, seed), weights, most)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(source_col).cast("string").alias("source"),
                        n_words_expr(text_col).alias("size"), _row_hash(id_col, text_col, seed).alias("u"))
    out = _decided(whole, cut, most).filter("copies > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col(f"_row.`{c}`") for c in docs.columns])


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
