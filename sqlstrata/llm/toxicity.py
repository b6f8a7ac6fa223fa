"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score of its
words; the document's score is the noisy-or of its sentences,
``1 - prod(1 - p_i)``. Only documents carry labels: the weights maximise the
likelihood of the documents' labels, which pushes the blame to the sentences
that explain them, and scoring returns those sentences.

A word's features are the word and its first 4, 5 and 6 bytes (lower case,
hashed), so stems are learned too. The classifier is fitted on a bounded
sample of labelled documents, the first ``SAMPLE`` by hash; everything is
scored in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlstrata.llm.common import slices, span_hashes, text_buffer, written

#: Labelled documents the classifier is fitted on, at most.
SAMPLE = 12_000
BITS = 20
PREFIXES = (4, 5, 6)
THRESHOLD = 0.7
EPOCHS = 400
#: Labelled documents a feature must occur in, and how far above chance.
MIN_DOCS, MIN_Z = 3, 5.0
#: Text bytes that are scored at once.
TEXT_BYTES = 1 << 18

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x41:0x5B] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_ENDS = np.zeros(256, bool)
_ENDS[[0x0A, 0x0D, 0x21, 0x2E, 0x3F]] = True  # line ends ! . ?


def sentences(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words and sentences of rows: word starts and ends, the sentence of each
    word (numbered over the slice), and the row of each sentence. A sentence
    ends before a word when a row, a line end or one of ``.!?`` lies between."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    word = _WORD[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    full = off[:-1] < off[1:]
    first[off[:-1][full]] = word[off[:-1][full]]
    last[off[1:][full] - 1] = word[off[1:][full] - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(off, s, side="right") - 1
    if len(s) == 0:
        return s, e, s, s
    seen = np.concatenate([[0], np.cumsum(_ENDS[data])])
    new = np.ones(len(s), bool)
    new[1:] = (row[1:] != row[:-1]) | (seen[s[1:]] != seen[e[:-1]])
    return s, e, np.cumsum(new) - 1, row[new]


def features(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Feature numbers, one column per kind."""
    ends = [e] + [np.minimum(e, s + k) for k in PREFIXES]
    out = np.empty((len(s), len(ends)), np.int32)
    for k, to in enumerate(ends):
        h = span_hashes(data, s, to)
        out[:, k] = ((h * np.uint64(2 * k + 1)) >> np.uint64(64 - BITS)).astype(np.int32) ^ (k * 0x3779B)
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(used: np.ndarray, f: np.ndarray, at: np.ndarray, doc_of_sent: np.ndarray, label: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Maximise the noisy-or likelihood of the documents' labels (Adam with a
    soft threshold). ``f`` and ``at`` are the distinct pairs of a feature, as an
    index into ``used``, and a sentence."""
    n_sent, n_doc = len(doc_of_sent), len(label)
    w = np.zeros(1 << BITS, np.float32)
    y = label.astype(bool)
    if not len(used) or y.all():
        return Model(w, 0.0 if y.any() and y.all() else -30.0)
    v, b = np.zeros(len(used)), -6.0
    m, q, mb, qb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    up = max(1.0, (~y).sum() / max(1, y.sum()) / 2)
    for t in range(1, epochs + 1):
        p = _sigmoid(b + np.bincount(at, weights=v[f], minlength=n_sent))
        none = np.exp(np.bincount(doc_of_sent, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=n_doc))
        score = np.clip(1 - none, 1e-7, 1)
        pull = np.where(y, up * (1 - score) / score, -1.0)
        g = pull[doc_of_sent] * p / n_doc
        gv = np.bincount(f, weights=g[at], minlength=len(used))
        gb = g.sum()
        m, q = 0.9 * m + 0.1 * gv, 0.999 * q + 0.001 * gv * gv
        mb, qb = 0.9 * mb + 0.1 * gb, 0.999 * qb + 0.001 * gb * gb
        v += 0.25 * (m / (1 - 0.9 ** t)) / (np.sqrt(q / (1 - 0.999 ** t)) + 2e-5)
        v = np.sign(v) * np.maximum(0, np.abs(v) - 0.01)
        b += 0.1 * (mb / (1 - 0.9 ** t)) / (np.sqrt(qb / (1 - 0.999 ** t)) + 1e-8)
    w[used] = v
    return Model(w, float(b))


def _suspects(counts: DataFrame, docs: int, positive: int) -> np.ndarray:
    """Features that occur in far more labelled documents than their number
    explains: ``MIN_DOCS`` at least, and ``MIN_Z`` standard deviations above the
    labels' share. The others would only fit chance. ``counts``: (f, n, hit)."""
    share = positive / docs
    above = F.col("hit") - F.col("n") * share > MIN_Z * F.sqrt(F.col("n") * (share * (1 - share)))
    return np.sort(counts.filter((F.col("hit") >= MIN_DOCS) & above).select("f").toArrow().column("f").to_numpy()).astype(np.int64)


def pairs(data: np.ndarray, s: np.ndarray, e: np.ndarray, sent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (feature, sentence) pairs of a slice, by sentence."""
    both = np.unique((sent[:, None] << BITS | features(data, s, e)).reshape(-1))
    return (both & (1 << BITS) - 1).astype(np.int32), (both >> BITS).astype(np.int32)


def _is_held_out(col: str):
    return F.coalesce(F.crc32(F.col(col).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on labelled documents outside the held-out third. Labels that are
    null count as missing; a document with several labels takes the largest."""
    lab = (labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y"))
           .filter("_y is not null and _id is not null").filter(~_is_held_out("_id"))
           .groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(sample))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"))
    # at most ``sample`` ids with a label each
    rows = rows.join(F.broadcast(lab), "_id").select("text", "_y")

    rows = written(rows, "labelled")
    size = rows.agg(F.count("*").alias("n"), F.sum("_y").alias("hit")).first()
    if not size["hit"]:
        return Model(np.zeros(1 << BITS, np.float32), -30.0)

    def in_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", TEXT_BYTES):
                f, of, row = _pairs_of(b)
                both = np.unique(row[of].astype(np.int64) << BITS | f)
                y = b.column(1).to_numpy()[both >> BITS]
                yield pa.RecordBatch.from_arrays([pa.array((both & (1 << BITS) - 1).astype(np.int32)), pa.array(y)], names=["f", "y"])

    counts = rows.mapInArrow(in_documents, "f int, y int").groupBy("f").agg(F.count("*").alias("n"), F.sum("y").alias("hit"))
    used = _suspects(counts, size["n"], size["hit"])
    index = np.full(1 << BITS, -1, np.int32)
    index[used] = np.arange(len(used), dtype=np.int32)

    def of_suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", TEXT_BYTES):
                f, of, row = _pairs_of(b)
                of, f = of[index[f] >= 0], index[f][index[f] >= 0]
                begin = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    b.column(1), pa.ListArray.from_arrays(np.searchsorted(of, begin).astype(np.int32), pa.array(f)),
                    pa.ListArray.from_arrays(begin, pa.array(np.bincount(of, minlength=len(row)).astype(np.int32)))], names=["y", "f", "lens"])

    got = rows.mapInArrow(of_suspects, "y int, f array<int>, lens array<int>").toArrow()
    label = got.column("y").to_numpy()
    lens = got.column("lens").combine_chunks()
    flat = lens.flatten().to_numpy()
    doc = np.repeat(np.arange(len(label), dtype=np.int32), np.diff(lens.offsets.to_numpy()))
    feat = got.column("f").combine_chunks().flatten().to_numpy()
    return fit(used, feat, np.repeat(np.arange(len(flat), dtype=np.int32), flat), doc, label)


def _pairs_of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (feature, sentence) pairs of the rows, and the row of each sentence."""
    data, off = text_buffer(b.column(0))
    s, e, sent, row = sentences(data, off)
    return *pairs(data, s, e, sent), row


def _score_slice(b: pa.RecordBatch, col: int, w: np.ndarray, bias: float) -> tuple[np.ndarray, ...]:
    """Scores of the rows; and row, first and last byte, and probability of
    their sentences."""
    data, off = text_buffer(b.column(col))
    s, e, sent, row = sentences(data, off)
    logit = np.full(len(row), bias, np.float64)
    if len(s):
        f = features(data, s, e)
        hit = np.flatnonzero(np.any(w[f] != 0, axis=1))  # few features carry weight
        key = np.unique((sent[hit][:, None] << BITS | f[hit]).reshape(-1))
        logit += np.bincount(key >> BITS, weights=w[key & (1 << BITS) - 1], minlength=len(row))
    p = _sigmoid(logit)
    none = np.bincount(row, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=b.num_rows)
    each = np.arange(len(row))
    begin, end = s[np.searchsorted(sent, each)], e[np.searchsorted(sent, each, side="right") - 1]
    return -np.expm1(none), row, begin, end, p


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without its text, plus ``score``, ``predicted`` and the
    offending sentences: ``spans`` of (start, end, score) in characters, for
    sentences that reach half the threshold.

    A text without words (null, empty) scores 0. Repeated rows score alike, no
    row is dropped. Columns of ``docs`` by the names of the results make way.
    """
    names = docs.columns
    kept = [i for i, c in enumerate(names) if c not in (text_col, "score", "predicted", "spans")]
    at = names.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = shared.value
        for batch in batches:
            for b in slices(batch, text_col, TEXT_BYTES):
                total, row, begin, end, p = _score_slice(b, at, w, bias)
                data, off = text_buffer(b.column(at))
                bad = np.flatnonzero(p >= threshold / 2)
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                home = chars[off[row[bad]]]
                spans = pa.StructArray.from_arrays(
                    [pa.array(chars[begin[bad]] - home), pa.array(chars[end[bad]] - home), pa.array(p[bad])], fields=list(span))
                cuts = np.searchsorted(row[bad], np.arange(b.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(i) for i in kept] + [pa.array(total), pa.array((total >= threshold).astype(np.int32)),
                                                   pa.ListArray.from_arrays(cuts, spans)],
                    names=[names[i] for i in kept] + ["score", "predicted", "spans"])

    spot = T.StructType().add("start", T.LongType()).add("end", T.LongType()).add("score", T.DoubleType())
    schema = T.StructType([docs.schema[i] for i in kept]).add("score", T.DoubleType()).add("predicted", T.IntegerType())
    return docs.mapInArrow(run, schema.add("spans", T.ArrayType(spot)))


def accepted(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score below ``threshold``, with all their columns."""
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = shared.value
        for batch in batches:
            for b in slices(batch, text_col, TEXT_BYTES):
                yield b.filter(pa.array(_score_slice(b, at, w, bias)[0] < threshold))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model)
    return out.select("doc_id", _is_held_out("doc_id").alias("held_out"), "score", "predicted", "spans")
