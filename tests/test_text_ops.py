import re

from pyspark.sql import functions as F

from sqlstrata.functions import patterns as P
from sqlstrata.operators import assemble as A
from sqlstrata.operators import chat as G
from sqlstrata.operators import columns as C
from sqlstrata.operators import convert as V
from sqlstrata.operators import lineage as L


def _log(spark, rows):
    return spark.createDataFrame(
        [(1, i, f"r{i}", c) for i, c in enumerate(rows)],
        "query_id bigint, section_id int, identifier string, content string")


def test_split_columns(spark):
    rows = [
        "SELECT DISTINCT a, f(b, c) AS d, 'x, y' AS e, EXTRACT(YEAR FROM t) FROM tab WHERE z = 1",
        "SELECT calc_from(1) AS c1, (<<subquery_select[2]_1>>) AS c2 FROM t",
        "SELECT 1, 2",
        "UNION ALL",
        "  select a\n,b from t  ",
    ]
    got = {r.section_id: (r.columns, r.star_content) for r in C.split_columns(_log(spark, rows)).collect()}
    assert got[0] == (["DISTINCT a", "f(b, c) AS d", "'x, y' AS e", "EXTRACT(YEAR FROM t)"],
                      "SELECT * FROM tab WHERE z = 1")
    assert got[1] == (["calc_from(1) AS c1", "(<<subquery_select[2]_1>>) AS c2"], "SELECT * FROM t")
    assert got[2] == (["1", "2"], "SELECT *")
    assert got[3] == ([], "UNION ALL")
    assert got[4] == (["a", "b"], "SELECT * from t")


def test_column_chunks(spark):
    df = spark.createDataFrame([(1, 1, "r", [f"c{i}" for i in range(7)])],
                               "query_id bigint, section_id int, identifier string, columns array<string>")
    got = [(r.chunk, r.chunk_query) for r in C.column_chunks(df, 3).orderBy("chunk").collect()]
    assert got == [(0, "SELECT c0, c1, c2 FROM dummy"), (1, "SELECT c3, c4, c5 FROM dummy"),
                   (2, "SELECT c6 FROM dummy")]


def _brute_tables(s):
    found = re.findall(r"\b(?:FROM|JOIN)\s+([a-zA-Z_][a-zA-Z0-9_.]*)", s, re.IGNORECASE)
    return sorted({t for t in found if t.upper() not in set(P.TABLE_STOPWORDS)})


def _brute_functions(s, cols):
    out = set()
    for x in [s, *cols]:
        out.update(f for f in re.findall(P.FUNCTION_PATTERN, x.upper()) if f not in set(P.FUNCTION_STOPWORDS))
    return sorted(out)


def test_tables_and_functions_match_brute_force(spark):
    texts = ["SELECT a FROM s.t1 JOIN t2 ON x LEFT JOIN t3 ON y WHERE EXISTS (SELECT 1 FROM where_t)",
             "select nvl(a, 0), upper (b), COUNT(*) from t group by c",
             "SELECT CASE WHEN x IN (1) THEN coalesce(y, 0) END FROM dual, other"]
    df = spark.createDataFrame([(t, ["sum(z)", "max (w)"]) for t in texts], "c string, cols array<string>")
    got = df.select(L.tables_expr("c").alias("t"), L.functions_expr("c", "cols").alias("f"), "c").collect()
    for r in got:
        assert r.t == _brute_tables(r.c)
        assert r.f == _brute_functions(r.c, ["sum(z)", "max (w)"])


def test_convert_rules_are_literal_safe(spark):
    df = spark.createDataFrame([
        ("SELECT NVL(a, 'NVL(x)'), CAST(b AS VARCHAR2(20)), TO_DATE(c, 'YYYYMMDD'), SYSDATE FROM t",)], "c string")
    out = df.select(V.apply_rules(F.col("c")).alias("o")).first().o
    assert out == ("SELECT COALESCE(a, 'NVL(x)'), CAST(b AS STRING), TO_DATE(c, 'yyyyMMdd'), "
                   "CURRENT_TIMESTAMP() FROM t")


def test_convert_errors_are_columns(spark):
    log = spark.createDataFrame(
        [(1, "select", 1, "subquery", "s1", "SELECT a FROM t WHERE ROWNUM <= 5", "", "", []),
         (1, "join", 2, "", "", "UNION", "", "", []),
         (1, "select", 3, "section_main", "m", "SELECT NVL(a, 0) FROM t", "", "", [])],
        "query_id bigint, section string, section_id int, type string, identifier string, content string, "
        "converted_content string, response_error string, columns array<string>")
    got = {r.section_id: r for r in V.convert_log(log).collect()}
    assert got[1].status == "failed" and got[1].converted_content == "" and "rownum" in got[1].response_error
    assert got[2].status == "passthrough" and got[2].converted_content == ""
    assert got[3].converted_content == "SELECT COALESCE(a, 0) FROM t" and got[3].response_error == ""
    kept = V.failure_budget(V.convert_log(log), budget=1).select("section_id").collect()
    assert sorted(r.section_id for r in kept) == [1]


def test_a_filter_on_converted_rows_does_not_convert_again(spark):
    """the filter was pushed below the conversion, which then ran once per mention."""
    log = spark.createDataFrame(
        [(1, "select", 1, "subquery", "subquery_select[1]_1", "SELECT NVL(a, 0) FROM t", "", ""),
         (1, "select", 1, "subquery", "subquery_select[1]_2", "SELECT a FROM t, u WHERE ROWNUM < 3", "", "")],
        "query_id bigint, section string, section_id int, type string, identifier string, content string, "
        "converted_content string, response_error string")
    few = G.few_shot_text(V.convert_log(log))
    assert [(r.n_examples, r.examples) for r in few.collect()] == [
        (1, "Oracle:\nSELECT NVL(a, 0) FROM t\nSpark SQL:\nSELECT COALESCE(a, 0) FROM t")]
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("NVL") == 1


def test_errors_of_odd_texts(spark):
    texts = [None, "", "rowNum", "xROWNUM ROWNUM_1", "connect  \n by", "CONNECTBY", "a(+)", "a '(+)' (", "f('(') ROWNUM'x'", "\"rownum\" )", "it's ROWNUM"]
    got = [r.e for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string").orderBy("i").select(V.check_errors(F.col("c")).alias("e")).collect()]
    assert got == ["", "", "unsupported: rownum", "", "unsupported: connect_by", "", "unsupported: outer_join_plus", "unbalanced parentheses",
                   "unsupported: rownum", "unbalanced parentheses", "unsupported: rownum"]


def test_audit_words_in_literals_are_data(spark):
    df = spark.createDataFrame([("SELECT a FROM t WHERE n = 'see ROWNUM and (+) CONNECT BY' AND NVL(b, 0) = 1",), ("SELECT 'x' FROM t WHERE rownum < 3",)], "c string")
    got = [r.e for r in df.select(V.check_errors(F.col("c")).alias("e")).collect()]
    assert got == ["", "unsupported: rownum"]
    log = df.select(F.lit(1).alias("query_id"), F.col("c").alias("content"))
    assert {(r.construct, r.n_rows) for r in V.dialect_audit(log).collect()} == {("nvl", 1), ("rownum", 1)}


def test_failing_columns_keep_their_text(spark):
    cols = [f"NVL(c{i}, 0)" for i in range(10)] + ["ROWNUM AS r", "NVL(b, 0) AS b"]
    log = spark.createDataFrame([(1, "select", cols, [], "unbalanced parentheses"), (2, "select", ["a"], [], ""), (3, "join", [], [], "")],
                                "query_id bigint, section string, columns array<string>, converted_columns array<string>, response_error string")
    once = V.convert_columns(log)
    for out in (once, V.convert_columns(once)):  # a refresh adds no reason twice
        got = {r.query_id: r for r in out.collect()}
        assert got[1].converted_columns == [f"COALESCE(c{i}, 0)" for i in range(10)] + ["ROWNUM AS r", "COALESCE(b, 0) AS b"]
        assert got[1].response_error == "unbalanced parentheses; unsupported: rownum"
        assert got[2].converted_columns == ["a"] and got[2].response_error == "" and got[3].converted_columns == []


def test_star_expand_is_literal(spark):
    df = spark.createDataFrame([("SELECT * FROM t", ["a", "'$1 \\\\'"])], "c string, cols array<string>")
    out = df.select(A.star_expand(F.col("c"), F.col("cols"), F.col("cols")).alias("o")).first().o
    assert out == "SELECT a, '$1 \\\\' FROM t"


def test_reply_sections(spark):
    msg = ("intro\n```sql\nSELECT 0\n```\n## Oracle SQL:\n```sql\nSELECT NVL(a,0)\n```\n"
           "text\n## Spark SQL :\n```SQL\n  SELECT COALESCE(a,0)  \n```\nbye")
    df = spark.createDataFrame([(1, msg)], "id bigint, m string")
    got = [(r.section, r.sql) for r in G.reply_sections(df, "m", ["id"]).orderBy("k").collect()]
    assert got == [("Unknown", "SELECT 0"), ("Oracle SQL", "SELECT NVL(a,0)"),
                   ("Spark SQL", "SELECT COALESCE(a,0)"), ("FULL_MESSAGE", msg.strip())]


def test_first_reply_and_eval_rows(spark):
    conv = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a1"),
                                  (1, 3, "assistant", "a2"), (2, 0, "user", "x")],
                                 "conv_id bigint, turn bigint, role string, text string")
    assert [(r.conv_id, r.reply) for r in G.first_reply(conv).collect()] == [(1, "a1")]
    e = G.eval_rows(conv).first()
    assert [(m.role, m.content) for m in e.inputs.messages] == [("system", "s"), ("user", "u")]
    assert e.expected_response == "a1"
