import tempfile

from pyspark.sql import functions as F

from sqlstrata.plans import pipeline as PL

Q1 = "WITH a AS (SELECT NVL(x, 0) AS x FROM t) SELECT x, (SELECT MAX(y) FROM u) AS m FROM a"
Q2 = "SELECT CAST(b AS VARCHAR2(10)) FROM v WHERE c IN (SELECT c FROM w WHERE ROWNUM <= 5)"
Q3 = "SELECT SYSDATE, d FROM z UNION ALL SELECT NULL, e FROM y"


def test_run_full_then_incremental(spark, corpus_of):
    base = tempfile.mkdtemp(prefix="sqlstrata-run-")
    first = PL.run(spark, corpus_of([Q1, Q2]), f"{base}/r1")
    fin = {r.query_id: r.final_query for r in first.filter(F.col("type") == "final").collect()}
    assert set(fin) == {1, 2}
    assert "COALESCE(x, 0)" in fin[1] and "NVL" not in fin[1]
    assert "CAST(b AS STRING)" in fin[2]
    # the ROWNUM subquery fails, keeps its text and reports why
    err = first.filter(F.col("response_error").contains("rownum")).collect()
    assert len(err) == 1 and err[0].converted_content == ""

    second = PL.run(spark, corpus_of([Q1, Q2, Q3]), f"{base}/r2", full_refresh=False,
                    previous=f"{base}/r1")
    finals = second.filter(F.col("type") == "final").groupBy("query_id").count().collect()
    assert sorted((r.query_id, r["count"]) for r in finals) == [(1, 1), (2, 1), (3, 1)]
    f3 = second.filter((F.col("type") == "final") & (F.col("query_id") == 3)).first().final_query
    assert "CURRENT_TIMESTAMP()" in f3 and "UNION ALL" in f3
    # rows of known queries are carried over unchanged
    old = {(r.query_id, r.identifier): r.converted_content for r in first.filter("type != 'final'").collect()}
    new = {(r.query_id, r.identifier): r.converted_content
           for r in second.filter("type != 'final' AND query_id < 3").collect()}
    assert old == new
    # a changed text is decomposed again; errors do not pile up
    third = PL.run(spark, corpus_of([Q1.replace("MAX(y)", "MIN(z)"), Q2, Q3]), f"{base}/r3", full_refresh=False, previous=f"{base}/r2")
    fin = {r.query_id: r for r in third.filter(F.col("type") == "final").collect()}
    assert set(fin) == {1, 2, 3} and "MIN(z)" in fin[1].final_query and "MAX(y)" not in fin[1].final_query
    err = third.filter(F.col("response_error") != "").collect()
    assert [r.response_error for r in err] == ["unsupported: rownum"]
