"""Registered text queries (families A-G) over the corpus built from ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from sqlstrata import oracle as O
from sqlstrata.functions import text as X
from sqlstrata.operators import assemble as A
from sqlstrata.operators import chat as G
from sqlstrata.operators import columns as C
from sqlstrata.operators import convert as V
from sqlstrata.operators import decompose as D
from sqlstrata.operators import lineage as L
from sqlstrata.plans import pipeline as PL
from sqlstrata.plans.registry import register
from sqlstrata.session import materialize
from sqlstrata.sources.corpus import corpus_from_dir


def _corpus(spark, sf):
    return corpus_from_dir(spark, sf)


# --- A2 ---------------------------------------------------------------------
@register("build_corpus", O.with_(O.CORPUS, body="SELECT query_id, sql FROM corpus"))
def q_build_corpus(spark, sf):
    return _corpus(spark, sf)


@register("build_corpus_customer", f"SELECT query_id, sql FROM ({O.corpus_sql_duckdb('customer')})")
def q_build_corpus_customer(spark, sf):
    return corpus_from_dir(spark, sf, "customer")


# --- B1, B2 -----------------------------------------------------------------
@register("strip_comments", O.with_(O.CORPUS, O.STRIPPED, body="SELECT query_id, sql AS stripped FROM stripped"))
def q_strip_comments(spark, sf):
    return _corpus(spark, sf).select("query_id", X.strip_comments("sql").alias("stripped"))


_WS_RE2 = rf"""((?:{O.LIT}|[^'"\s]+)*)\s+"""


@register("normalize_ws", O.with_(O.CORPUS, O.STRIPPED, body=(
    f"SELECT query_id, {O.strip_ws(f'regexp_replace(sql, {O.q(_WS_RE2)}, {O.q(chr(92) + "1 ")}, {O.q("g")})')}"
    " AS normalized FROM stripped")))
def q_normalize_ws(spark, sf):
    return _corpus(spark, sf).select(
        "query_id", X.normalize_ws(X.strip_comments("sql")).alias("normalized"))


# --- B3-B12 -----------------------------------------------------------------
@register("split_sections", O.with_(*O.BASE, body="SELECT query_id, section_id, section, content FROM sections"))
def q_split_sections(spark, sf):
    return D.split_sections(_corpus(spark, sf))


@register("classify_sections", O.with_(*O.BASE, body=(
    "SELECT section, CAST(count(*) AS BIGINT) AS n_sections, "
    "CAST(count(DISTINCT query_id) AS BIGINT) AS n_queries FROM sections GROUP BY section")))
def q_classify_sections(spark, sf):
    return (D.split_sections(_corpus(spark, sf)).groupBy("section")
            .agg(F.count(F.lit(1)).alias("n_sections"),
                 F.countDistinct("query_id").alias("n_queries")))


@register("cte_block", O.with_(*O.BASE, body=(
    "SELECT query_id, max(CASE WHEN section = 'cte' THEN content END) AS cte_block, "
    "string_agg(CASE WHEN section <> 'cte' THEN content END, chr(10) ORDER BY section_id) AS remainder "
    "FROM sections GROUP BY query_id")))
def q_cte_block(spark, sf):
    return D.cte_block(_corpus(spark, sf))


@register("extract_subqueries", O.with_(*O.BASE, O.SUBQUERIES, body=(
    "SELECT query_id, section, section_id, n, "
    "'subquery_' || section || '[' || section_id || ']_' || n AS identifier, content "
    "FROM pieces WHERE n > 0")))
def q_extract_subqueries(spark, sf):
    return D.extract_subqueries(_corpus(spark, sf))


_FULL = """
f_tok AS (
  SELECT query_id, section_id, section, pos, tok, sd, n0, isopen, isclose FROM u_t4 WHERE NOT unbalanced
),
f_close AS (SELECT query_id, section_id, section, pos AS cpos, n0 AS n, sd AS lvl FROM f_tok WHERE isclose),
f_open AS (
  SELECT query_id, section_id, pos AS opos, sd AS lvl,
         row_number() OVER (PARTITION BY query_id, section_id, sd ORDER BY pos) AS k FROM f_tok WHERE isopen
),
f_close2 AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, section_id, lvl ORDER BY cpos) AS k FROM f_close
),
f_span AS (
  SELECT c.query_id, c.section_id, c.section, c.n, o.opos, c.cpos
  FROM f_close2 c JOIN f_open o USING (query_id, section_id, lvl, k)
)"""


@register("subqueries_full", O.with_(*O.BASE, O.SUBQUERIES, _FULL, body=(
    "SELECT s.query_id, s.section_id, s.n, "
    "'subquery_' || s.section || '[' || s.section_id || ']_' || s.n AS id, "
    "coalesce(string_agg(t.tok, '' ORDER BY t.pos), '') AS full_sub_query "
    "FROM f_span s LEFT JOIN f_tok t ON t.query_id = s.query_id AND t.section_id = s.section_id "
    "AND t.pos > s.opos AND t.pos < s.cpos GROUP BY ALL")))
def q_subqueries_full(spark, sf):
    return D.subqueries_full(_corpus(spark, sf))


_LOG_FLAT = ("SELECT query_id, section, section_id, type, identifier, original_query, content, "
             "response_error FROM dlog")


@register("decompose_log", O.with_(*O.BASE, O.SUBQUERIES, O.LOG, body=_LOG_FLAT))
def q_decompose_log(spark, sf):
    return D.decompose_log(_corpus(spark, sf)).select(
        "query_id", "section", "section_id", "type", "identifier", "original_query", "content",
        "response_error")


@register("main_only_log", O.with_(O.CORPUS, body=(
    "SELECT query_id, 'select' AS section, 0 AS section_id, 'section_main' AS type, "
    "'section_0_main' AS identifier, sql AS original_query, sql AS content, '' AS response_error "
    "FROM corpus")))
def q_main_only_log(spark, sf):
    return D.main_only_log(_corpus(spark, sf)).select(
        "query_id", "section", "section_id", "type", "identifier", "original_query", "content",
        "response_error")


@register("setop_branches", O.with_(*O.BASE, body=(
    "SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY section_id) AS INTEGER) AS branch, "
    "'<<branch_' || row_number() OVER (PARTITION BY query_id ORDER BY section_id) || '>>' AS placeholder, content "
    "FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS k FROM sections WHERE section = 'select') WHERE k >= 2")))
def q_setop_branches(spark, sf):
    return D.setop_branches(_corpus(spark, sf))


# --- C: select lists ---------------------------------------------------------
def _dlog(spark, sf):
    """The decomposition log, checkpointed (several operators read it twice)."""
    return materialize(D.decompose_log(_corpus(spark, sf)))


def _clog(spark, sf):
    return D.decompose_log(_corpus(spark, sf), select_lists=True)

RS = "\x1e"  # array elements are joined with the record separator for hashing
_DLOG = [*O.BASE, O.SUBQUERIES, O.LOG]
_CLOG = [*_DLOG, O.COLS]
_S1 = [*_CLOG, O.S1]


def _j(c):
    return F.array_join(F.col(c) if isinstance(c, str) else c, RS)


def _dj(e):
    return f"array_to_string({e}, chr(30))"


@register("split_columns", O.with_(*_CLOG, body=(
    f"SELECT query_id, section_id, identifier, CAST(len(cols) AS INTEGER) AS n_columns, {_dj('cols')} AS columns "
    "FROM clog WHERE len(cols) > 0")))
def q_split_columns(spark, sf):
    log = _clog(spark, sf)
    return log.filter(F.size("columns") > 0).select(
        "query_id", "section_id", "identifier", F.size("columns").cast("int").alias("n_columns"),
        _j("columns").alias("columns"))


@register("star_rewrite", O.with_(*_CLOG, body="SELECT query_id, section_id, identifier, content FROM clog"))
def q_star_rewrite(spark, sf):
    return _clog(spark, sf).select(
        "query_id", "section_id", "identifier", "content")


@register("log_with_columns", O.with_(*_CLOG, body=(
    "SELECT query_id, section, section_id, type, identifier, original_query, content, "
    f"{_dj('cols')} AS columns, response_error FROM clog")))
def q_log_with_columns(spark, sf):
    log = _clog(spark, sf)
    return log.select("query_id", "section", "section_id", "type", "identifier", "original_query",
                      "content", _j("columns").alias("columns"), "response_error")


@register("column_chunks", O.with_(*_CLOG, body=(
    "SELECT query_id, section_id, identifier, CAST(i // 5 AS INTEGER) AS chunk, "
    "'SELECT ' || array_to_string(list_slice(cols, i + 1, i + 5), ', ') || ' FROM dummy' AS chunk_query "
    "FROM (SELECT *, unnest(range(0, len(cols), 5)) AS i FROM clog WHERE len(cols) > 0)")))
def q_column_chunks(spark, sf):
    log = _clog(spark, sf)
    return C.column_chunks(log, 5).select("query_id", "section_id", "identifier", "chunk", "chunk_query")


# --- D: lineage ----------------------------------------------------------------
@register("extract_tables", O.with_(*_S1, body=(
    f"SELECT query_id, section_id, identifier, {_dj('tables')} AS tables FROM s1log")))
def q_extract_tables(spark, sf):
    return PL.stage1(_corpus(spark, sf)).select("query_id", "section_id", "identifier",
                                                _j("tables").alias("tables"))


_LOOSE = (r"list_sort(list_distinct(list_transform(regexp_extract_all(content, '(?i)FROM\s+([^\s;()]+)', 1) || "
          r"regexp_extract_all(content, '(?i)JOIN\s+([^\s;()]+)', 1), lambda x: lower(trim(x)))))")


@register("extract_tables_loose", O.with_(*_DLOG, body=(
    f"SELECT query_id, section_id, identifier, {_dj(_LOOSE)} AS tables FROM dlog")))
def q_extract_tables_loose(spark, sf):
    return D.decompose_log(_corpus(spark, sf)).select(
        "query_id", "section_id", "identifier", _j(L.loose_tables_expr("content")).alias("tables"))


@register("unique_tables", O.with_(*_S1, body=(
    "SELECT tbl AS table_name, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT query_id) AS BIGINT) AS n_queries "
    "FROM (SELECT query_id, unnest(tables) AS tbl FROM s1log) GROUP BY tbl")))
def q_unique_tables(spark, sf):
    return L.unique_values(PL.stage1(_corpus(spark, sf)), "tables", "table_name")


@register("extract_functions", O.with_(*_S1, body=(
    f"SELECT query_id, section_id, identifier, {_dj('functions')} AS functions FROM s1log")))
def q_extract_functions(spark, sf):
    return PL.stage1(_corpus(spark, sf)).select("query_id", "section_id", "identifier",
                                                _j("functions").alias("functions"))


@register("unique_functions", O.with_(*_S1, body=(
    "SELECT fn AS function_name, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT query_id) AS BIGINT) AS n_queries "
    "FROM (SELECT query_id, unnest(functions) AS fn FROM s1log) GROUP BY fn")))
def q_unique_functions(spark, sf):
    return L.unique_values(PL.stage1(_corpus(spark, sf)), "functions", "function_name")


_DUP = f"""SELECT table_key, n_copies, query_id, identifier FROM (
  SELECT *, CAST(count(*) OVER (PARTITION BY table_key) AS BIGINT) AS n_copies FROM (
    SELECT query_id, identifier, array_to_string({_LOOSE}, ',') AS table_key FROM dlog WHERE type = 'subquery'))
WHERE n_copies > 1"""


@register("duplicate_subqueries", O.with_(*_DLOG, body=_DUP))
def q_duplicate_subqueries(spark, sf):
    return L.duplicate_subqueries(_dlog(spark, sf))


@register("duplicate_groups", O.with_(*_DLOG, body=(
    f"SELECT table_key, CAST(count(*) AS BIGINT) AS n_copies, CAST(count(DISTINCT query_id) AS BIGINT) AS n_queries "
    f"FROM (SELECT query_id, array_to_string({_LOOSE}, ',') AS table_key FROM dlog WHERE type = 'subquery') "
    "GROUP BY table_key HAVING count(*) > 1")))
def q_duplicate_groups(spark, sf):
    return L.duplicate_groups(D.decompose_log(_corpus(spark, sf)))


# --- E: conversion -------------------------------------------------------------
_CONV = f"""
e_conv AS (SELECT *, {O.place_sql(O.convert_sql('content'))} AS conv FROM s1log),
e_err AS (SELECT *, {O.errors_sql('conv')} AS err FROM e_conv),
e_log AS (
  SELECT *, CASE WHEN section = 'join' THEN '' WHEN err = '' THEN conv ELSE '' END AS converted_content,
    CASE WHEN section = 'join' THEN response_error ELSE {O.merge_errors('response_error', 'err')} END AS response_error2,
    CASE WHEN section = 'join' THEN 'passthrough' WHEN err = '' THEN 'success' ELSE 'failed' END AS status
  FROM e_err
)"""
_ELOG = [*_S1, _CONV]


@register("convert_rules", O.with_(*_S1, body=(
    f"SELECT query_id, section_id, identifier, {O.place_sql(O.convert_sql('content'))} AS converted FROM s1log")))
def q_convert_rules(spark, sf):
    return PL.stage1(_corpus(spark, sf)).select(
        "query_id", "section_id", "identifier", V.convert_piece(F.col("content")).alias("converted"))


@register("convert_log", O.with_(*_ELOG, body=(
    "SELECT query_id, section_id, identifier, converted_content, response_error2 AS response_error, status FROM e_log")))
def q_convert_log(spark, sf):
    return V.convert_log(PL.stage1(_corpus(spark, sf))).select(
        "query_id", "section_id", "identifier", "converted_content", "response_error", "status")


_PENDING = f"""
SELECT query_id, section_id, identifier FROM e_log WHERE section <> 'join' AND {O.SW('content')} <> ''
  AND {O.SW("coalesce(converted_content, '')")} = '' AND query_id IN (SELECT query_id FROM corpus WHERE sql LIKE '%DISTINCT%')
UNION ALL
SELECT query_id, NULL, NULL FROM corpus WHERE query_id NOT IN (SELECT query_id FROM corpus WHERE sql LIKE '%DISTINCT%')"""


@register("incremental_pending", O.with_(*_ELOG, body=_PENDING))
def q_incremental_pending(spark, sf):
    """The log holds the queries with DISTINCT; all others are new."""
    c = _corpus(spark, sf)
    return V.incremental_pending(c, PL.stage2(PL.stage1(c.filter(F.col("sql").contains("DISTINCT")))))


_AUDIT_SQL = " UNION ALL ".join(
    f"SELECT query_id, '{n}' AS construct FROM s1log WHERE regexp_matches({e}, {O.q(p)})"
    for n, p in V.AUDIT for e in ["content" if p.startswith("'") else O.code_sql("content")])


@register("dialect_audit", O.with_(*_S1, body=(
    "SELECT construct, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT query_id) AS BIGINT) AS n_queries "
    f"FROM ({_AUDIT_SQL}) GROUP BY construct")))
def q_dialect_audit(spark, sf):
    return V.dialect_audit(PL.stage1(_corpus(spark, sf)))


@register("failure_budget", O.with_(*_ELOG, body=(
    "SELECT query_id, section_id, identifier, response_error2 AS response_error FROM ("
    "SELECT *, coalesce(sum(CASE WHEN response_error2 <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY query_id "
    "ORDER BY section_id, CASE WHEN type = 'subquery' THEN 0 WHEN type = 'section_main' THEN 1 ELSE 2 END, "
    "coalesce(TRY_CAST(regexp_extract(identifier, '_(\\d+)$', 1) AS INTEGER), 0) "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e_log) WHERE before < 1")))
def q_failure_budget(spark, sf):
    log = PL.stage2(PL.stage1(_corpus(spark, sf)))
    return V.failure_budget(log, budget=1).select("query_id", "section_id", "identifier", "response_error")


# --- F: reassembly -------------------------------------------------------------
@register("resolve_placeholders", O.with_(*O.BASE, body=(
    "SELECT query_id, section_id, content AS resolved FROM sections UNION ALL SELECT query_id, 1, '' FROM blanks")))
def q_resolve_placeholders(spark, sf):
    log = D.decompose_log(_corpus(spark, sf))
    return A.resolve_sections(A.piece_text(log)).select("query_id", "section_id", "resolved")


_STAR_SQL = ("CASE WHEN len(cols) > 0 AND regexp_matches(content, '(?i)select\\s+\\*') THEN "
             "regexp_replace(content, '(?i)(select\\s+)\\*', '\\1' || replace(array_to_string(cols, ', '), '\\', '\\\\')) "
             "ELSE content END")


@register("star_expand", O.with_(*_CLOG, body=(
    f"SELECT query_id, section_id, identifier, {_STAR_SQL} AS expanded FROM clog")))
def q_star_expand(spark, sf):
    log = _clog(spark, sf)
    return log.select("query_id", "section_id", "identifier",
                      A.star_expand(F.col("content"), F.col("columns"), F.col("columns")).alias("expanded"))


_FOLD = O.fold("clog", _STAR_SQL, "f")


def _identity_columns(log):
    return log.withColumn("converted_columns", F.col("columns"))


@register("assemble_query", O.with_(*_CLOG, _FOLD, body="SELECT query_id, final_query FROM f_final"))
def q_assemble_query(spark, sf):
    log = _clog(spark, sf)
    return A.assemble_query(_identity_columns(log)).drop("text_key")


@register("final_row", O.with_(*_CLOG, _FOLD, body=(
    f"SELECT query_id, final_query, {_dj(O.tables_sql('final_query'))} AS tables, "
    f"{_dj(O.functions_sql('final_query'))} AS functions FROM f_final")))
def q_final_row(spark, sf):
    log = _clog(spark, sf)
    fin = A.final_row(L.with_tables(_identity_columns(log)))
    return fin.filter(F.col("type") == "final").select(
        "query_id", "final_query", _j("tables").alias("tables"), _j("functions").alias("functions"))


# --- G: chat tables ------------------------------------------------------------
@register("build_messages", O.with_(*_S1, body=(
    f"SELECT query_id, section_id, identifier, 2 AS n_messages, {O.q(G.SYSTEM_PROMPT)} AS system_content, "
    f"{O.q(G.USER_PREFIX)} || content AS user_content FROM s1log")))
def q_build_messages(spark, sf):
    m = G.build_messages(PL.stage1(_corpus(spark, sf)))
    return m.select("query_id", "section_id", "identifier", F.size("messages").alias("n_messages"),
                    F.col("messages")[0]["content"].alias("system_content"),
                    F.col("messages")[1]["content"].alias("user_content"))


@register("first_reply", """
SELECT conv_id, min(turn) AS turn, arg_min(text, turn) AS reply FROM conversations
WHERE role = 'assistant' GROUP BY conv_id""")
def q_first_reply(spark, sf):
    return G.first_reply(spark.read.parquet(f"{sf}/conversations.parquet"))


_WRAP = r"""
wrapped AS (
  SELECT conv_id, turn,
    CASE WHEN turn % 3 = 0 THEN '```sql' || chr(10) || text || chr(10) || '```' || chr(10) ELSE '' END
    || '## Query as given:' || chr(10) || '```sql' || chr(10) || text || chr(10) || '```' || chr(10)
    || '## Query for the new engine :' || chr(10) || '```SQL' || chr(10) || text || chr(10) || '```' || chr(10) || 'Done.'
    AS reply
  FROM conversations WHERE role = 'assistant'
),
items AS (
  SELECT conv_id, turn, reply,
    regexp_extract_all(reply, '(?:##\s*(?:.*?)\s*:)|(?:(?i)```sql\s*(?:[\s\S]*?)\s*```)') AS it FROM wrapped
),
blocks AS (
  SELECT conv_id, turn, unnest(list_filter(list_transform(it, lambda x, i: {
      'k': i - 1,
      'section': coalesce(regexp_replace(regexp_extract(list_filter(list_slice(it, 1, i - 1), lambda h: starts_with(h, '##'))[-1],
                                         '##\s*(.*?)\s*:', 1), '^\s+|\s+$', '', 'g'), 'Unknown'),
      'sql': regexp_replace(regexp_extract(x, '(?i)```sql\s*([\s\S]*?)\s*```', 1), '^\s+|\s+$', '', 'g'),
      'fence': NOT starts_with(x, '##')}), lambda s: s.fence), recursive := true)
  FROM items
)
SELECT conv_id, turn, CAST(k AS INTEGER) AS k, section, sql FROM blocks
UNION ALL
SELECT conv_id, turn, CAST(len(it) AS INTEGER), 'FULL_MESSAGE', regexp_replace(reply, '^\s+|\s+$', '', 'g') FROM items"""


@register("reply_sections", "WITH " + _WRAP.strip())
def q_reply_sections(spark, sf):
    w = G.wrap_reply(spark.read.parquet(f"{sf}/conversations.parquet"))
    return G.reply_sections(w, "reply", ["conv_id", "turn"]).select(
        "conv_id", "turn", F.col("k").cast("int").alias("k"), "section", "sql")


@register("few_shot_text", O.with_(*_ELOG, body=(
    "SELECT query_id, CAST(count(*) AS BIGINT) AS n_examples, string_agg('Oracle:' || chr(10) || content || chr(10) "
    "|| 'Spark SQL:' || chr(10) || converted_content, chr(10) || chr(10) ORDER BY section_id, "
    "CAST(regexp_extract(identifier, '_(\\d+)$', 1) AS BIGINT)) AS examples "
    "FROM e_log WHERE type = 'subquery' AND converted_content <> '' GROUP BY query_id")))
def q_few_shot_text(spark, sf):
    return G.few_shot_text(PL.stage2(PL.stage1(_corpus(spark, sf))))


@register("eval_rows", """
WITH f AS (SELECT conv_id, min(turn) AS t, arg_min(text, turn) AS reply FROM conversations
           WHERE role = 'assistant' GROUP BY conv_id)
SELECT c.conv_id, c.turn, c.role, c.text AS content, f.reply AS expected_response
FROM conversations c JOIN f ON f.conv_id = c.conv_id WHERE c.turn < f.t""")
def q_eval_rows(spark, sf):
    return G.eval_messages(spark.read.parquet(f"{sf}/conversations.parquet"))


# --- B4, B11, F5: named views ------------------------------------------------------
@register("cte_list", O.with_(*O.BASE, O.CTE_LIST, body="SELECT query_id, cte_pos, name, body, error FROM ctes"))
def q_cte_list(spark, sf):
    return D.cte_list(_corpus(spark, sf))


@register("named_view", O.with_(*_DLOG, O.CTE_LIST, O.NAMED_VIEW, body="SELECT query_id, name, type, query, error FROM nv"))
def q_named_view(spark, sf):
    return D.named_view(_corpus(spark, sf)).drop("text_key")


@register("main_text", O.with_(*_DLOG, O.CTE_LIST, O.NAMED_VIEW, O.MAIN_TEXT, body="SELECT query_id, main FROM mt"))
def q_main_text(spark, sf):
    return A.main_text(D.named_view(_corpus(spark, sf)))


# --- E6, F6: column conversion and the staged job ---------------------------------
_E6 = f"""
e6_new AS (
  SELECT query_id, section_id, identifier, cols, list_transform(cols, lambda c: {O.convert_sql('c')}) AS nc
  FROM e_log WHERE section <> 'join' AND len(cols) > 0
),
e6_err AS (SELECT *, list_transform(nc, lambda c: {O.errors_sql('c')}) AS ne FROM e6_new),
e6_all AS (
  SELECT *, string_split(array_to_string(list_filter(ne, lambda x: x <> ''), '; '), '; ') AS why FROM e6_err
),
e6 AS (
  SELECT query_id, section_id, identifier,
    list_transform(range(1, len(cols) + 1), lambda i: CASE WHEN ne[i] = '' THEN nc[i] ELSE cols[i] END) AS cc,
    array_to_string(list_filter(why, lambda x, i: list_position(why, x) = i), '; ') AS cerr
  FROM e6_all
),
s3log AS (
  SELECT l.*, coalesce(e.cc, []::VARCHAR[]) AS cc,
    {O.merge_errors('l.response_error2', "coalesce(e.cerr, '')")} AS response_error3
  FROM e_log l LEFT JOIN e6 e USING (query_id, section_id, identifier)
)"""
_S3 = [*_ELOG, _E6]


@register("convert_columns", O.with_(*_S3, body=(
    f"SELECT query_id, section_id, identifier, {_dj('cc')} AS converted_columns, response_error3 AS response_error "
    "FROM s3log")))
def q_convert_columns(spark, sf):
    log = V.convert_columns(PL.stage2(PL.stage1(_corpus(spark, sf))))
    return log.select("query_id", "section_id", "identifier", _j("converted_columns").alias("converted_columns"),
                      "response_error")


@register("pipeline_stage1", O.with_(*_S1, body=(
    f"SELECT query_id, section_id, identifier, type, content, {_dj('cols')} AS columns, {_dj('tables')} AS tables, "
    f"{_dj('functions')} AS functions, response_error FROM s1log")))
def q_pipeline_stage1(spark, sf):
    s1 = PL.stage1(_corpus(spark, sf))
    return s1.select("query_id", "section_id", "identifier", "type", "content", _j("columns").alias("columns"),
                     _j("tables").alias("tables"), _j("functions").alias("functions"), "response_error")


@register("pipeline_stage2", O.with_(*_ELOG, body=(
    "SELECT query_id, section_id, identifier, converted_content, response_error2 AS response_error FROM e_log")))
def q_pipeline_stage2(spark, sf):
    s2 = PL.stage2(PL.stage1(_corpus(spark, sf)))
    return s2.select("query_id", "section_id", "identifier", "converted_content", "response_error")


_S3_TEXT = O.star_sql("CASE WHEN converted_content <> '' THEN converted_content ELSE content END", "cols", "cc")


@register("pipeline_stage3", O.with_(*_S3, O.fold("s3log", _S3_TEXT), body=(
    f"SELECT query_id, final_query, {_dj(O.tables_sql('final_query'))} AS tables, "
    f"{_dj(O.functions_sql('final_query'))} AS functions FROM fd_final")))
def q_pipeline_stage3(spark, sf):
    s3 = PL.stage3(PL.stage2(PL.stage1(_corpus(spark, sf))))
    return s3.filter(F.col("type") == "final").select(
        "query_id", "final_query", _j("tables").alias("tables"), _j("functions").alias("functions"))
