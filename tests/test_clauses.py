"""Rewrites by place: what they give, what they leave, and that the converted
text means the same (run by Spark on small tables)."""

import pytest
from pyspark.sql import functions as F

from sqlstrata.operators import convert as V
from sqlstrata.operators.clauses import by_place, clause_map
from sqlstrata.operators import decompose as D

LEFT_ALONE = [
    "SELECT * FROM t, u WHERE ROWNUM = 1", "SELECT ROWNUM AS r, a FROM t WHERE ROWNUM = 1", "SELECT * FROM a x, b y, c z WHERE x.i = y.i",
    "SELECT * FROM a x, b y WHERE x.i = y.i OR x.k = 1", "SELECT * FROM t WHERE t.a = q.b AND ROWNUM = 1",
    "SELECT * FROM t WHERE a BETWEEN 1 AND 2 AND ROWNUM = 1", "SELECT * FROM t WHERE ROWNUM <= 5", "SELECT * FROM t WHERE 'ROWNUM = 1' = a",
    "SELECT * FROM (<<subquery_select[1]_1>>) v, b y WHERE v.i = y.i", "SELECT * FROM a, b WHERE a.i = a.j", "SELECT * FROM a x, b x WHERE x.i = x.i",
    "SELECT f(x FROM 1), 'FROM a, b WHERE' FROM t", "SELECT * FROM a, b", "UPDATE t SET a = 1 WHERE ROWNUM = 1", "", "ROWNUM", "FROM a, b WHERE",
    "SELECT * FROM t WHERE a = 1 START WITH b = 2 CONNECT BY c = d AND ROWNUM = 1", "SELECT * FROM t JOIN u ON t.i = u.i WHERE ROWNUM = 1"]
REWRITTEN = {
    "SELECT * FROM t WHERE ROWNUM = 1": "SELECT * FROM (SELECT t.*, ROW_NUMBER() OVER (ORDER BY 1) AS rn FROM t) t WHERE t.rn = 1",
    "select a from s.t x where x.a = 'ROWNUM (' and f(x.b, 1) > 2\n  and rownum<2 order by a":
        "select a from (SELECT x.*, ROW_NUMBER() OVER (ORDER BY 1) AS rn FROM s.t x WHERE x.a = 'ROWNUM (' AND f(x.b, 1) > 2) x WHERE x.rn = 1 order by a",
    "SELECT * FROM a x, b AS y WHERE x.i = y.i AND x.k IN (1, 2) AND Y.j=X.j GROUP BY a":
        "SELECT * FROM a x JOIN b AS y ON x.i = y.i AND Y.j=X.j WHERE x.k IN (1, 2) GROUP BY a",
    "SELECT * FROM s.a, s.b WHERE a.i = b.i": "SELECT * FROM s.a JOIN s.b ON a.i = b.i",
    "SELECT * FROM a x, b y WHERE x.t = 'a, b WHERE OR' AND x.i = y.i": "SELECT * FROM a x JOIN b y ON x.i = y.i WHERE x.t = 'a, b WHERE OR'",
}


def converted(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(2)
    return [r.c for r in df.select("i", by_place(F.col("t")).alias("c")).orderBy("i").collect()]


def test_forms(spark):
    assert converted(spark, [*LEFT_ALONE, None]) == [*LEFT_ALONE, None]
    assert converted(spark, list(REWRITTEN)) == list(REWRITTEN.values())
    assert converted(spark, list(REWRITTEN.values())) == list(REWRITTEN.values())  # nothing more to do


def test_map_is_linear(spark):
    text = "SELECT " + "f(a, 'x'), " * 20_000 + "b FROM t x, u y WHERE x.i = y.i AND ROWNUM = 3"
    got = spark.createDataFrame([(text,)], "t string").select(F.size(F.filter(clause_map(F.col("t")), lambda x: x["word"] != ",")).alias("n")).first().n
    assert got == 5  # SELECT FROM WHERE AND ROWNUM


@pytest.fixture
def tables(spark):
    spark.createDataFrame([(1, 10, "a"), (2, 20, "b"), (2, 30, "c"), (None, 40, "d")], "i int, k int, t string").createOrReplaceTempView("cl_a")
    spark.createDataFrame([(1, "x"), (2, "y"), (2, "z"), (3, "w")], "i int, v string").createOrReplaceTempView("cl_b")


def test_comma_joins_mean_the_same(spark, tables):
    for text in ("SELECT * FROM cl_a x, cl_b y WHERE x.i = y.i", "SELECT x.k, y.v FROM cl_a x, cl_b y WHERE x.k > 10 AND y.i = x.i AND y.v <> 'z' ORDER BY k",
                 "SELECT cl_a.t, COUNT(*) AS n FROM cl_a, cl_b WHERE cl_a.i = cl_b.i GROUP BY cl_a.t HAVING COUNT(*) > 1"):
        new, = converted(spark, [text])
        assert " JOIN " in new
        assert sorted(map(str, spark.sql(new).collect())) == sorted(map(str, spark.sql(text).collect()))


def test_first_rows_are_rows(spark, tables):
    new, = converted(spark, ["SELECT x.i, x.k FROM cl_a x WHERE x.k > 10 AND ROWNUM = 1"])
    rows = spark.sql(new).collect()
    assert len(rows) == 1 and (rows[0].i, rows[0].k) in {(2, 20), (2, 30), (None, 40)}
    new, = converted(spark, ["SELECT MAX(k) AS m FROM cl_a WHERE k > 100 AND ROWNUM = 1"])
    assert [r.m for r in spark.sql(new).collect()] == [None]


def test_log_rows_convert_or_say_why(spark, corpus_of):
    texts = ["SELECT NVL(a, 1) FROM t WHERE b = 2 AND ROWNUM = 1", "SELECT a FROM t, u WHERE ROWNUM = 1",
             "SELECT a, (SELECT MAX(c) FROM v WHERE v.k = 3 AND ROWNUM = 1) FROM t x, u y WHERE x.i = y.i"]
    log = V.convert_log(D.decompose_log(corpus_of(texts), select_lists=True))
    got = {(r.query_id, r.type): (r.converted_content, r.status) for r in log.collect()}
    assert got[1, "section_main"] == ("SELECT * FROM (SELECT t.*, ROW_NUMBER() OVER (ORDER BY 1) AS rn FROM t WHERE b = 2) t WHERE t.rn = 1", "success")
    assert got[2, "section_main"] == ("", "failed")
    assert got[3, "section_main"] == ("SELECT * FROM t x JOIN u y ON x.i = y.i", "success")
    assert got[3, "subquery"][0].startswith("SELECT * FROM (SELECT v.*") and got[3, "subquery"][1] == "success"
