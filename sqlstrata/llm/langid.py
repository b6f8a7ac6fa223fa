"""Language of web pages by Bayesian fusion of four kinds of evidence.

* text: likelihood of the page's byte trigrams under each language's trigram
  frequencies, counted over all labelled documents;
* declared: the markup's ``lang`` attribute, with ``P(declared | language)``;
* suffix: the last label of the host, with ``P(suffix | language)``;
* host: a prior that shrinks the host's shares towards its domain's and the
  domain's towards the overall shares (Dirichlet smoothing).

The tables behind the last three are sums over all pages of the languages'
probabilities by text alone, computed by grouped aggregation. A page's own
share is taken out of its host's and domain's sums, so its text counts once.
"""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlstrata.llm.common import slices, summed_table, text_buffer, written

GRAM_BITS = 16
#: Overlapping trigrams are not independent: each counts a third.
TEMPER = 1 / 3
#: Strength of a level's prior in pages.
ALPHA = 8.0
#: Pseudo-count of an unseen declaration or suffix.
SMOOTH = 0.5

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[0x41:0x5B] += 0x20
_FOLD[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0x20
_SILENT = re.compile(r"<!--.*?-->|<(script|style|noscript)\b.*?</\1\s*>", re.S | re.I)
_TAG = re.compile(r"<[^>]*>")
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})\b", re.I)


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams (lower case, blanks alike) and their rows. Runs of
    three digits or signs say nothing and are left out."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    d = _FOLD[data]
    g = d[:-2] << np.uint32(16) | d[1:-1] << np.uint32(8) | d[2:]
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    letter = ((d >= 0x61) & (d <= 0x7A)) | (d >= 0x80)
    ok = (row[:-2] == row[2:]) & (letter[:-2] | letter[1:-1] | letter[2:])
    return ((g[ok] * np.uint32(0x9E3779B1)) >> np.uint32(32 - GRAM_BITS)).astype(np.int64), row[:-2][ok]


def page_text(page: str) -> str:
    return htmllib.unescape(_TAG.sub(" ", _SILENT.sub(" ", page)))


def declared_language(page: str) -> str | None:
    m = _LANG.search(page)
    return m.group(1).lower() if m else None


def host_parts(url: str | None) -> tuple[str | None, str | None, str | None]:
    """(host, registered domain, suffix): the last two labels and the last."""
    try:
        host = (urlsplit(url or "").hostname or "").strip(".").lower()
    except ValueError:
        host = ""
    labels = host.split(".")
    if not host:
        return None, None, None
    return host, ".".join(labels[-2:]), labels[-1]


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages (in code-point order) and log P(trigram | language) over all
    documents with a language. The languages are few, and checked to be."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null")
    langs = sorted((r["lang"] for r in rows.select("lang").distinct().limit(513).collect()), key=str.encode)
    if len(langs) > 512:
        raise ValueError("more than 512 languages")
    if not langs:
        return [], np.zeros((0, 1 << GRAM_BITS))
    place = {x: i for i, x in enumerate(langs)}

    def count(batch: pa.RecordBatch, total: np.ndarray) -> None:
        for b in slices(batch, "text"):
            g, row = grams(*text_buffer(b.column(1)))
            lang = np.array([place[x] for x in b.column(0).to_pylist()], np.int64)
            total += np.bincount(lang[row] << GRAM_BITS | g, minlength=len(total)).astype(np.uint32)

    counts = summed_table(rows, len(langs) << GRAM_BITS, count).reshape(len(langs), -1)
    p = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * counts.shape[1])
    return langs, np.log(p)


def _evidence(pages: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """(page_id, host, domain, suffix, declared, ll): log-likelihood of the
    text per language, tempered."""
    shared = pages.sparkSession.sparkContext.broadcast(np.ascontiguousarray(model.T))
    names = ["page_id", "host", "domain", "suffix", "declared", "ll"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for b in slices(batch, "html"):
                raw = [x or "" for x in b.column(2).to_pylist()]
                g, row = grams(*text_buffer(pa.array([page_text(x) for x in raw], pa.string())))
                ll = np.stack([np.bincount(row, weights=table[g, k], minlength=len(raw)) for k in range(table.shape[1])], axis=1)
                ll = ll * TEMPER  # of integers, where no page has a trigram
                parts = list(zip(*(host_parts(u) for u in b.column(1).to_pylist())))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), *(pa.array(p, pa.string()) for p in parts), pa.array([declared_language(x) for x in raw], pa.string()),
                     pa.array((ll - ll.max(axis=1, keepdims=True)).tolist(), pa.list_(pa.float64()))], names=names)

    return pages.mapInArrow(run, "page_id long, host string, domain string, suffix string, declared string, ll array<double>")


def _softmax(logs: list[Column]) -> list[Column]:
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    e = [F.exp(x - top) for x in logs]
    total = e[0]
    for x in e[1:]:
        total = total + x
    return [x / total for x in e]


def identify(pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``page_id, lang, prob`` and the evidence: ``text_lang``
    (by text alone), ``declared``, ``suffix``, ``host``, ``host_prior`` (of
    ``lang``), ``probs``.

    A null or empty page has no text evidence, a missing declaration, host or
    suffix adds none. Ties go to the first language in code-point order.
    Without any labelled document ``lang`` is null. Repeated rows count as
    pages of their own; other columns are ignored.
    """
    langs, model = train(docs)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"))
    if not langs:
        none = F.lit(None)
        return rows.select("page_id", none.cast("string").alias("lang"), none.cast("double").alias("prob"),
                           *(none.cast("string").alias(c) for c in ("text_lang", "declared", "suffix", "host")),
                           none.cast("double").alias("host_prior"), none.cast("array<double>").alias("probs"))
    n = len(langs)
    ev = _evidence(rows, langs, model)
    r = _softmax([F.col("ll")[i] for i in range(n)])
    ev = written(ev.withColumn("r", F.array(*r)), "evidence")

    def sums(key: str) -> DataFrame:
        return ev.filter(F.col(key).isNotNull()).groupBy(key).agg(
            F.count("*").alias(f"{key}_n"), F.array(*[F.sum(F.col("r")[i]) for i in range(n)]).alias(f"{key}_s"))

    whole = ev.agg(F.count("*").alias("n"), *[F.sum(F.col("r")[i]).alias(f"s{i}") for i in range(n)]).first()
    overall = [((whole[f"s{i}"] or 0.0) + 1.0) / (whole["n"] + n) for i in range(n)]
    out = ev
    for key in ("host", "domain", "suffix", "declared"):
        out = out.join(sums(key), key, "left")
    logs, priors = [], []
    seen = ev.agg(F.countDistinct("suffix").alias("suffix"), F.countDistinct("declared").alias("declared")).first()
    for i in range(n):
        own = F.col("r")[i]
        dom = F.coalesce((F.col("domain_s")[i] - own + ALPHA * overall[i]) / (F.col("domain_n") - 1 + ALPHA), F.lit(overall[i]))
        prior = F.coalesce((F.col("host_s")[i] - own + dom * ALPHA) / (F.col("host_n") - 1 + ALPHA), dom)
        prior = F.greatest(prior, F.lit(1e-9))  # sums and differences round
        total = (whole[f"s{i}"] or 0.0)
        x = F.col("ll")[i] + F.log(prior)
        for key in ("suffix", "declared"):
            like = (F.col(f"{key}_s")[i] + SMOOTH) / F.lit(total + SMOOTH * (seen[key] + 1))
            x = x + F.coalesce(F.log(like), F.lit(0.0))
        logs.append(x)
        priors.append(prior)
    probs = _softmax(logs)
    out = out.withColumn("probs", F.array(*probs)).withColumn("priors", F.array(*priors))
    names = F.array(*[F.lit(x) for x in langs])
    best = F.array_position("probs", F.array_max("probs")).cast("int")
    by_text = F.array_position("r", F.array_max("r")).cast("int")
    has_text = F.exists("ll", lambda v: v != 0)
    return out.select("page_id", names[best - 1].alias("lang"), F.array_max("probs").alias("prob"),
                      F.when(has_text, names[by_text - 1]).alias("text_lang"), "declared", "suffix", "host",
                      F.col("priors")[best - 1].alias("host_prior"), "probs")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"))
