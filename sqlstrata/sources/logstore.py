"""Log tables (A3-A5, A7) and the few-shot example reader.

A log is plain parquet, or a table in buckets of ``query_id``: reassembly groups by
text, and over such a table it needs no exchange. A blank table name or path
is a no-op, as in the reference.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlstrata.operators.decompose import LOG_SCHEMA


def _blank(name: str | None) -> bool:
    return name is None or not name.strip()


def log_init(spark: SparkSession, table: str | None) -> DataFrame | None:
    """A3: create or reset the typed, empty log table (a catalog table: with a
    persistent metastore ``DROP TABLE`` also clears its folder)."""
    if _blank(table):
        return None
    empty = spark.createDataFrame([], LOG_SCHEMA)
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    empty.write.mode("overwrite").format("parquet").saveAsTable(table)
    return spark.table(table)


def write_log(df: DataFrame, target: str | None, as_table: bool = False, buckets: int | None = None,
              deal: bool = True) -> None:
    """A4: overwrite a log (path or table; a table in ``buckets`` of ``query_id``, if given).

    Each task writes a file per bucket, so rows are first dealt out by bucket; rows that
    come from a table in the same buckets lie so already (``deal=False``)."""
    if _blank(target):
        return
    if as_table and buckets and deal:
        df = df.repartition(buckets, "query_id")
    w = df.write.mode("overwrite").format("parquet")
    if as_table:
        (w.bucketBy(buckets, "query_id") if buckets else w).saveAsTable(target)
    else:
        w.save(target)


def read_log(spark: SparkSession, source: str, as_table: bool = False) -> DataFrame:
    """A5: read a log back."""
    return spark.table(source) if as_table else spark.read.parquet(source)


def log_patch(log: DataFrame, patch: DataFrame) -> DataFrame:
    """Apply a patch table ``(query_id, identifier, action, text)``.

    ``action = 'redo'`` clears ``converted_content`` / ``converted_columns``
    so the next incremental run converts the row again; ``action = 'set'``
    replaces ``content`` with ``text``. A row may have both; of several ``set``
    texts the largest counts. The patch is reduced to one row per key, so a
    left join on the key keeps the number of log rows.
    """
    p = patch.groupBy("query_id", "identifier").agg(
        F.max((F.col("action") == "redo").cast("int")).alias("_a"), F.max((F.col("action") == "set").cast("int")).alias("_s"),
        F.max(F.when(F.col("action") == "set", F.col("text"))).alias("_t"))
    out = log.join(p, ["query_id", "identifier"], "left")
    redo = F.col("_a") == 1
    out = (out.withColumn("converted_content", F.when(redo, F.lit("")).otherwise(F.col("converted_content")))
              .withColumn("converted_columns", F.when(redo, F.array().cast("array<string>"))
                          .otherwise(F.col("converted_columns")))
              .withColumn("content", F.when(F.col("_s") == 1, F.col("_t")).otherwise(F.col("content"))))
    return out.drop("_a", "_s", "_t")


EXAMPLES_ENV = "SQLSTRATA_EXAMPLE_FILE"


def write_examples(df: DataFrame, path: str) -> None:
    """Write few-shot examples as a header CSV that ``read_examples`` reads back."""
    (df.write.mode("overwrite").option("header", True).option("escape", '"')
       .option("quoteAll", True).csv(path))


def read_examples(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Few-shot CSV ``oracle_query, incorrect_query, correct_query``
    (multi-line cells); the path falls back to ``$SQLSTRATA_EXAMPLE_FILE``."""
    path = path or os.environ.get(EXAMPLES_ENV)
    if not path:
        raise ValueError(f"no example file given and {EXAMPLES_ENV} is unset")
    return (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
                 .csv(path).select("oracle_query", "incorrect_query", "correct_query"))
