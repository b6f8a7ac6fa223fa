import os
import tempfile

from pyspark.sql import functions as F

from sqlstrata.operators import decompose as D
from sqlstrata.sources import logstore as S
from sqlstrata.sources.corpus import read_corpus


def test_read_corpus_whole_text_files(spark):
    d = tempfile.mkdtemp(prefix="sqlstrata-corpus-")
    texts = {"a.sql": "SELECT 1\nFROM t\nWHERE x IN (SELECT x FROM u)\n",
             "b.sql": "-- header\nWITH c AS (SELECT 2) SELECT * FROM c;\n"}
    for name, t in texts.items():
        with open(os.path.join(d, name), "w") as f:
            f.write(t)
    corpus = read_corpus(spark, d, fmt="text")
    rows = corpus.collect()
    assert sorted(r.sql for r in rows) == sorted(texts.values())      # whole texts, one row per file
    assert len({r.query_id for r in rows}) == 2
    again = {r.sql: r.query_id for r in read_corpus(spark, d, fmt="text").collect()}
    assert again == {r.sql: r.query_id for r in rows}                  # stable ids
    assert D.decompose_log(corpus).filter(F.col("type") == "subquery").count() == 2


def test_log_init_and_patch(spark):
    import uuid
    empty = S.log_init(spark, f"sqlstrata_log_{uuid.uuid4().hex[:8]}")
    assert empty.count() == 0
    assert empty.columns == D.LOG_COLUMNS
    assert S.log_init(spark, "  ") is None
    log = spark.createDataFrame(
        [(1, "s1", "SELECT a", "SELECT a", ["a"]), (1, "s2", "SELECT b", "SELECT b", ["b"])],
        "query_id bigint, identifier string, content string, converted_content string, "
        "converted_columns array<string>")
    patch = spark.createDataFrame([(1, "s1", "redo", None), (1, "s2", "set", "SELECT c")],
                                  "query_id bigint, identifier string, action string, text string")
    got = {r.identifier: r for r in S.log_patch(log, patch).collect()}
    assert got["s1"].converted_content == "" and got["s1"].converted_columns == []
    assert got["s2"].content == "SELECT c" and got["s2"].converted_content == "SELECT b"
    assert S.log_patch(log, patch.unionByName(patch)).count() == 2


def test_checkpoint_folder_must_be_shared():
    """A session that is not local has no folder of its own making."""
    import pytest
    from types import SimpleNamespace

    from sqlstrata.session import checkpoint_dir
    conf = SimpleNamespace(get=lambda k, d=None: "spark://host:7077" if k == "spark.master" else d)
    with pytest.raises(ValueError):
        checkpoint_dir(SimpleNamespace(conf=conf))


def test_hierarchy_walk_without_limits(spark):
    from sqlstrata.operators import relational as R
    chain = [(f"c{i}", f"c{i - 1}" if i else None) for i in range(1000)]
    loop = [("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("o", "missing")]
    got = {r.node: r for r in R.hierarchy_walk(spark, spark.createDataFrame(chain + loop, "node string, parent string")).collect()}
    assert all(got[f"c{i}"].root == "c0" and got[f"c{i}"].depth == i and got[f"c{i}"].error is None for i in range(1000))
    assert all(got[n].error == "cycle" and got[n].root is None for n in "xyzw")
    assert got["o"].root == "missing" and got["o"].depth == 1
    wide = spark.range(500_000).select(F.concat(F.lit("n"), "id").alias("node"), F.when(F.col("id") > 0, F.concat(F.lit("n"), (F.col("id") / 10).cast("long"))).alias("parent"))
    out = R.hierarchy_walk(spark, wide)
    assert out.filter("root = 'n0'").count() == 500_000 and out.filter("node = 'n499999'").first().depth == 6
