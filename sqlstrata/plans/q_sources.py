"""Registered source/sink queries (A): reading corpora, log round trips,
patches and few-shot examples. Writes go to the session's shared checkpoint
folder (``spark.checkpoint.dir``)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sqlstrata import oracle as O
from sqlstrata.plans import pipeline as PL
from sqlstrata.plans.q_text import _ELOG as _ELOG_FRAGS
from sqlstrata.plans.registry import register
from sqlstrata.session import checkpoint_dir, materialize
from sqlstrata.sources import logstore as S
from sqlstrata.sources.corpus import corpus_from_dir, read_corpus

RS = "\x1e"


def _scratch(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


@register("read_corpus", "SELECT CAST(doc_id AS BIGINT) AS query_id, text AS sql FROM documents")
def q_read_corpus(spark, sf):
    return read_corpus(spark, f"{sf}/documents.parquet", id_col="doc_id", sql_col="text")


@register("log_write_read", O.with_(*O.BASE, O.SUBQUERIES, O.LOG, O.COLS, O.S1, body=(
    "SELECT query_id, section_id, identifier, type, content, array_to_string(cols, chr(30)) AS columns FROM s1log")))
def q_log_write_read(spark, sf):
    path = _scratch(spark, "log")
    S.write_log(PL.stage1(corpus_from_dir(spark, sf)), path)
    back = S.read_log(spark, path)
    return back.select("query_id", "section_id", "identifier", "type", "content",
                       F.array_join("columns", RS).alias("columns"))


_PATCH_BODY = """
SELECT query_id, section_id, identifier,
  CASE WHEN response_error2 LIKE '%rownum%' THEN '' ELSE converted_content END AS converted_content,
  CASE WHEN type = 'section_main' AND section = 'join' THEN lower(content) ELSE content END AS content
FROM e_log"""


def _patch_sql():
    return O.with_(*_ELOG_FRAGS, body=_PATCH_BODY)


def q_log_patch(spark, sf):
    """Redo rows whose conversion failed on ROWNUM; replace the text of
    set-operator main rows. The patch table is derived from the log."""
    log = materialize(PL.stage2(PL.stage1(corpus_from_dir(spark, sf))))
    redo = log.filter(F.col("response_error").contains("rownum")).select(
        "query_id", "identifier", F.lit("redo").alias("action"), F.lit(None).cast("string").alias("text"))
    setp = log.filter((F.col("type") == "section_main") & (F.col("section") == "join")).select(
        "query_id", "identifier", F.lit("set").alias("action"), F.lower("content").alias("text"))
    out = S.log_patch(log, redo.unionByName(setp))
    return out.select("query_id", "section_id", "identifier", "converted_content", "content")


register("log_patch", _patch_sql())(q_log_patch)


@register("read_examples", O.with_(*_ELOG_FRAGS, body=(
    "SELECT content AS oracle_query, content AS incorrect_query, converted_content AS correct_query FROM e_log "
    "WHERE type = 'subquery' AND converted_content <> ''")))
def q_read_examples(spark, sf):
    """Few-shot examples written as multi-line CSV from the converted log,
    read back with the example reader."""
    log = PL.stage2(PL.stage1(corpus_from_dir(spark, sf)))
    ex = log.filter((F.col("type") == "subquery") & (F.col("converted_content") != "")).select(
        F.col("content").alias("oracle_query"), F.col("content").alias("incorrect_query"),
        F.col("converted_content").alias("correct_query"))
    path = _scratch(spark, "examples")
    S.write_examples(ex, path)
    return S.read_examples(spark, path)


_DOC_CORPUS = "corpus AS (SELECT CAST(doc_id AS BIGINT) AS query_id, text AS sql FROM documents)"


@register("document_sections", O.with_(_DOC_CORPUS, O.STRIPPED, O.SECTIONS, body=(
    "SELECT query_id, section_id, section, content FROM sections")))
def q_document_sections(spark, sf):
    """B5 over whole documents (prose up to 20,000 words with stray quotes and
    parentheses): every text is processed whole."""
    from sqlstrata.operators.decompose import split_sections
    return split_sections(read_corpus(spark, f"{sf}/documents.parquet", id_col="doc_id", sql_col="text"))
