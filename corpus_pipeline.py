"""The training-data pipeline: five operators in a row over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all
that its predecessor kept, and its decisions take effect. All stages but the
last return the columns of ``documents``.

Null and empty texts pass every filter: they score 0, are linked with nothing, hold no
passage, have no words to mix (they come as often as the whole rounds of their source)
and pack as their end token. Texts are taken whole, however long. An empty table gives
an empty one. Rows without an id are treated like others; names that begin with ``_`` are
reserved for the stages' own columns.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlstrata.llm import chaining, mixing, packing, toxicity, triejoin
from sqlstrata.llm.common import IdFilter, scratch, written
from sqlstrata.llm.tokens import public_path
from sqlstrata.session import ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled
    documents among ``docs``."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.accepted(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect, the one of smallest id stays. Of its rows
    with the same text, the first by the other columns stays; rows with other
    texts stay."""
    found = written(triejoin.similarity_components(docs).select("doc_id", "component_id").filter("doc_id is not null"), "components")
    gone = written(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    some, rest = IdFilter(gone, "_gone").split(docs)
    kept = rest.unionByName(some.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti"))
    twice = written(found.filter("doc_id = component_id").groupBy("doc_id").count().filter("count > 1")
                    .select(F.col("doc_id").alias("_twice")), "twice")
    if twice.isEmpty():
        return kept
    repeated = kept.join(twice, F.col("doc_id") == F.col("_twice"), "left_semi")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    repeated = repeated.groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("_row")).select(
        *[F.col(f"_row.{c}").alias(c) if c in rest else c for c in docs.columns])
    return kept.join(twice, F.col("doc_id") == F.col("_twice"), "left_anti").unionByName(repeated)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out; ``n_chars`` follows."""
    passages = written(chaining.repeated_passages(docs), "repeated")
    out = chaining.without_passages(docs, passages)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences."""
    return packing.pack(docs, public_path("byte_bpe_50k.json"), end_id=1)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _shipped(stage: Stage) -> Stage:
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return stage(spark, docs, sf_dir)
    return run_stage


STAGES: list[tuple[str, Stage]] = [(name, _shipped(stage)) for name, stage in (
    ("toxicity", drop_toxic),
    ("ngram_join", one_of_each),
    ("substring_dedup", cut_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
)]

#: A trained classifier and token ids are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        out = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return STAGES[-1][1](spark, docs, sf_dir)
