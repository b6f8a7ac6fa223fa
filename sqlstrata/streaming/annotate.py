"""Streaming annotation of incoming queries.

The reference has no streaming. The operators that are plain row-local
column expressions (comment stripping, table and function lists, rule
conversion, error checks, dialect flags) run unchanged on a streaming
DataFrame, so new query texts can be annotated as they land. Nothing here is
stateful; the windowed decomposition runs as a batch job over the written
table (``plans.pipeline.run``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlstrata.functions.text import normalize_ws, strip_comments
from sqlstrata.operators import convert as V
from sqlstrata.operators import lineage as L

CORPUS_SCHEMA = T.StructType([T.StructField("query_id", T.LongType()),
                              T.StructField("sql", T.StringType())])


def annotate(corpus: DataFrame, rules=V.DEFAULT_RULES) -> DataFrame:
    """Row-local annotation (works on batch and streaming DataFrames)."""
    clean = strip_comments("sql")
    conv = V.apply_rules(clean, rules)
    flags = F.array(*[F.when(V._found(clean, p), F.lit(n)) for n, p in V.AUDIT])
    return corpus.select(
        "query_id",
        normalize_ws(clean).alias("normalized"),
        L.tables_expr(clean).alias("tables"),
        L.functions_expr(clean).alias("functions"),
        conv.alias("converted"),
        V.check_errors(conv).alias("response_error"),
        F.filter(flags, lambda x: x.isNotNull()).alias("constructs"))


def read_corpus_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """A stream of corpus files ``(query_id, sql)`` (parquet) arriving in ``path``."""
    return (spark.readStream.schema(CORPUS_SCHEMA).option("maxFilesPerTrigger", max_files)
            .parquet(path))


def start_annotation(spark: SparkSession, source: str, sink: str, checkpoint: str,
                     once: bool = False):
    """Annotate a corpus stream into a parquet table. The file sink's own log
    makes each micro-batch count once, also after a restart."""
    q = (annotate(read_corpus_stream(spark, source)).writeStream.format("parquet").outputMode("append")
         .option("path", sink).option("checkpointLocation", checkpoint))
    q = q.trigger(availableNow=True) if once else q.trigger(processingTime="30 seconds")
    return q.start()
