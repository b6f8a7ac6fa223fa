from pyspark.sql import functions as F

from sqlstrata.operators import decompose as D
from sqlstrata.operators import lineage as L
from sqlstrata.plans.skew import salted_join


def test_salted_join_equals_plain_join(spark):
    big = spark.range(0, 3000).select(F.when(F.col("id") % 3 == 0, F.lit("hot"))
                                      .otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string")))
                                      .alias("key"), F.col("id"))
    summary = big.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    got = salted_join(big, summary, ["key"], ["id"], buckets=7)
    want = big.join(summary, "key")
    assert got.count() == want.count() == 3000
    assert got.exceptAll(want.select(*got.columns)).count() == 0


def test_duplicate_subqueries_with_a_hot_key(spark, corpus_of):
    # one subquery shape in two thirds of all queries, plus unique ones
    texts = [("SELECT a FROM t WHERE x IN (SELECT x FROM hot_table)" if i % 3 else
              f"SELECT a FROM t WHERE x IN (SELECT x FROM u{i})") for i in range(300)]
    log = D.decompose_log(corpus_of(texts))
    rows = L.duplicate_subqueries(log).collect()
    hot = [r for r in rows if r.table_key == "hot_table"]
    assert len(hot) == 200 and {r.n_copies for r in hot} == {200}
    assert {r.table_key for r in rows} == {"hot_table"}
