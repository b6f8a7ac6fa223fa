"""Interaction of text filters, for every order in which they could run.

Each document becomes a 32-bit word: bit S says whether the document survives
when exactly the filters in the set S run. A set of five filters has 32
subsets, so one word holds every outcome. Counting the bits per position over
all documents (a positional popcount, by carry-save adders) gives the survivors
of every subset, per part and label, and those 32 numbers give every figure of
every order: no order is ever run.

The words are made and counted where the rows lie. What is shuffled is a
digest, an id and a few flags per document, and then 32 sums per part, label
and task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlstrata.llm.common import table, written

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: Limits of the filters (documents beyond them fail).
LEAST_WORDS = 50
LEAST_DISTINCT = 65  # percent of the words
MOST_UPPER = 5       # percent of the code points
MARKS = "[#$%&*|]"
#: A task hands its sums on when it holds so many groups.
HELD_GROUPS = 4096
#: Documents of a group that wait in a task before they are added up.
HELD_WORDS = 1 << 16

#: Fails of a document (bit i: fails filter i) -> its survival word.
SURVIVAL = np.array([sum(1 << s for s in range(SUBSETS) if not s & m) for m in range(SUBSETS)], np.uint32)


def failures(text: Column) -> Column:
    """Bits of the row-local filters A to D that a text fails (null: empty)."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(F.translate(t, "\t\n\x0b\x0c\r", "     "), " "), lambda x: x != "")
    n = F.size(words)
    tests = [n < LEAST_WORDS,
             F.size(F.array_distinct(words)) * 100 < n * LEAST_DISTINCT,
             F.length(F.regexp_replace(t, "[^A-Z]+", "")) * 100 > F.length(t) * MOST_UPPER,
             t.rlike(MARKS)]
    bits = F.lit(0)
    for i, x in enumerate(tests):
        bits = bits + F.when(x, 1 << i).otherwise(0)
    return bits.cast("int")


def survival_words(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, good, toxic, fails, word) of every row of ``docs``.

    Rows of a text that repeats: all but those of the smallest ``doc_id`` fail E.
    A row without an id neither fails E nor makes another row fail it. The
    survivor of a text is found by a grouped minimum with partial sums, and rows
    are matched by (id, text digest), so a text that a third of all rows hold is
    no hot key. An id with several label rows is good (toxic) if one of them says
    so."""
    rows = written(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)).alias("digest"), failures(F.col("text")).alias("fails")), "filter-rows")
    first = rows.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.lit(True).alias("first"))
    flags = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    named = rows.filter("doc_id is not null").join(first, ["doc_id", "digest"], "left").join(flags, "doc_id", "left")
    no = F.lit(False)
    named = named.select("doc_id", "part", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"),
                         (F.col("fails") + F.when(F.col("first"), 0).otherwise(1 << 4)).cast("int").alias("fails"))
    unnamed = rows.filter("doc_id is null").select("doc_id", "part", no.alias("good"), no.alias("toxic"), "fails")
    word = F.element_at(F.array(*[F.lit(int(w)) for w in SURVIVAL]), F.col("fails") + 1)
    return named.unionByName(unnamed).withColumn("word", word.cast("long"))


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit ``words`` have each bit set, by carry-save adders:
    three words of weight w become one of weight w and one of weight 2w, until two
    are left of each weight."""
    counts = np.zeros(32, np.int64)
    level, weight, bits = np.asarray(words, np.uint32), 1, np.arange(32, dtype=np.uint32)
    while len(level):
        carries = []
        while len(level) > 2:
            k = len(level) // 3
            a, b, c, rest = level[:k], level[k:2 * k], level[2 * k:3 * k], level[3 * k:]
            half = a ^ b
            carries.append((a & b) | (half & c))
            level = np.concatenate([half ^ c, rest])
        for w in level:
            counts += ((w >> bits) & np.uint32(1)).astype(np.int64) * weight
        level = np.concatenate(carries) if carries else np.zeros(0, np.uint32)
        weight *= 2
    return counts


class _Sums:
    """Bit counts of the words of each (part, label group) of a task."""

    def __init__(self) -> None:
        self.waiting: dict[tuple, list[np.ndarray]] = {}
        self.held: dict[tuple, int] = {}
        self.counts: dict[tuple, np.ndarray] = {}

    def add(self, key: tuple, words: np.ndarray) -> None:
        self.waiting.setdefault(key, []).append(words)
        self.held[key] = self.held.get(key, 0) + len(words)
        if self.held[key] >= HELD_WORDS:
            self.settle(key)

    def settle(self, key: tuple) -> None:
        got = positional_popcount(np.concatenate(self.waiting.pop(key)))
        self.counts[key] = self.counts[key] + got if key in self.counts else got
        del self.held[key]

    def take(self) -> pa.RecordBatch:
        for key in list(self.waiting):
            self.settle(key)
        keys = list(self.counts)
        out = pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
             pa.array([self.counts[k].tolist() for k in keys], pa.list_(pa.int64()))], names=["part", "label", "counts"])
        self.__init__()
        return out


def subset_survivors(words: DataFrame) -> DataFrame:
    """(part, label, survivors): for the part's documents of each label group
    (0 all, 1 good, 2 toxic), how many survive each of the 32 subsets of the
    filters (``survivors[S]``, S a set of bits in the order ``FILTERS``)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for b in batches:
            part = b.column(0).dictionary_encode()
            code = part.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            good, toxic = (b.column(i).to_numpy(zero_copy_only=False).astype(bool) for i in (1, 2))
            word = b.column(3).to_numpy(zero_copy_only=False).astype(np.uint32)
            order = np.argsort(code, kind="stable")
            edge = np.flatnonzero(np.diff(code[order], prepend=-1))
            for lo, hi in zip(edge, np.append(edge[1:], len(order))):
                at, name = order[lo:hi], part.dictionary[int(code[order[lo]])].as_py()
                sums.add((name, 0), word[at])
                for label, has in ((1, good[at]), (2, toxic[at])):
                    if has.any():
                        sums.add((name, label), word[at[has]])
                if len(sums.waiting) + len(sums.counts) > HELD_GROUPS:
                    yield sums.take()
        if sums.waiting or sums.counts:
            yield sums.take()

    own = words.select("part", "good", "toxic", "word").mapInArrow(count, "part string, label int, counts array<long>")
    total = own.groupBy("part", "label").agg(*[F.sum(F.col("counts")[s]).alias(f"s{s}") for s in range(SUBSETS)])
    return total.select("part", "label", F.array(*[F.col(f"s{s}") for s in range(SUBSETS)]).alias("survivors"))


def order_rows(survivors: dict[int, np.ndarray]) -> list[tuple]:
    """All figures of a part, from its subsets' survivors by label group."""
    none = np.zeros(SUBSETS, np.int64)
    alive, good, toxic = (survivors.get(i, none) for i in range(3))
    n = len(FILTERS)
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    full = SUBSETS - 1
    weight = [1] * (n + 1)  # orders in which exactly a given set of k filters runs before a given one: k! (n-1-k)!
    fact = [1, 1, 2, 6, 24, 120]
    for k in range(n):
        weight[k] = fact[k] * fact[n - 1 - k]
    shapley = {f: sum(weight[s.bit_count()] * int(alive[s] - alive[s | b]) for s in range(SUBSETS) if not s & b) for f, b in bit.items()}
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, f in enumerate(order, 1):
            b = bit[f]
            after = before | b
            removed = int(alive[before] - alive[after])
            out.append(("".join(order), step, int(alive[after]), removed, int(alive[0] - alive[b]) - removed,
                        int(alive[full & ~b] - alive[full]), int(good[before] - good[after]),
                        int(toxic[before] - toxic[after]), shapley[f]))
            before = after
    return out


AUDIT_SCHEMA = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
                "good_lost long, toxic_lost long, shapley long")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every order of the filters, step by step, per part (``AUDIT_SCHEMA``).

    One row per part (a source; null counts as empty), order and step, zeros
    included; without documents no row. Null and empty texts are one text without
    words (they fail A; all but one fail E). A text is taken whole, however long.
    Rows that repeat an id and its text are no copies of each other; other
    equal texts are, also across parts. Only ``doc_id``, ``text`` and ``source``
    (and ``quality`` and ``toxic`` of ``labels``) are read, so further
    columns may have any name."""
    found = subset_survivors(survival_words(docs, labels))
    parts = found.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("label", "survivors"))).alias("by"))

    def orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for b in batches:
            for part, by in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = order_rows({k: np.array(v, np.int64) for k, v in dict(by).items()})
                cols = list(zip(*rows))
                schema = schema or [pa.string(), pa.int32()] + [pa.int64()] * 7
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.string())] + [pa.array(c, t) for c, t in zip(cols, schema)],
                                                 names=["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
                                                        "good_lost", "toxic_lost", "shapley"])

    return parts.mapInArrow(orders, AUDIT_SCHEMA)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
