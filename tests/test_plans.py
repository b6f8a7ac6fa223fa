"""Plan-shape regressions. A registered text query deals out the rows of its
table once, before it builds texts; decomposition and everything else that is
about one text is local to its row. Only reassembly groups."""

import uuid

import pytest
from pyspark.sql import functions as F

from conftest import SMOKE_DIR
from sqlstrata.operators import assemble as A
from sqlstrata.operators import columns as C
from sqlstrata.operators import convert as V
from sqlstrata.operators import decompose as D
from sqlstrata.operators import lineage as L
from sqlstrata.plans import pipeline as PL
from sqlstrata.plans import registry
from sqlstrata.sources import logstore as S
from sqlstrata.sources.corpus import corpus_from_dir
from tools.plans import shape

registry.load_all()


@pytest.mark.parametrize("key, exchanges", [
    ("decompose_log", 1), ("log_with_columns", 1), ("pipeline_stage1", 1), ("extract_tables", 1), ("convert_log", 1), ("convert_columns", 1),
    ("pipeline_stage2", 1), ("split_sections", 1), ("extract_subqueries", 1), ("subqueries_full", 1), ("cte_list", 1), ("named_view", 1),
    ("cte_block", 1), ("setop_branches", 1), ("assemble_query", 2), ("final_row", 2), ("pipeline_stage3", 2), ("main_text", 2)])
def test_text_chain_scans_once(spark, key, exchanges):
    s = shape(registry.QUERIES[key](spark, SMOKE_DIR))
    assert s["exchanges"] <= exchanges and s["sorts"] == 0 and s["sort_merge_joins"] == 0, s
    assert s["scans_in_python"] == 1, s


def test_decomposition_has_no_exchange(spark, corpus_of):
    corpus = corpus_of(["SELECT a, (SELECT 1) FROM t"])
    for df in (D.split_sections(corpus), D.decompose_log(corpus), D.decompose_log(corpus, select_lists=True), D.cte_list(corpus),
               C.log_with_columns(D.decompose_log(corpus)), PL.stage2(PL.stage1(corpus))):
        assert shape(df)["exchanges"] == 0


def test_no_row_at_a_time_python(spark):
    """The boundary scan is the only Python, in Arrow batches, and only in text queries."""
    for key, fn in registry.QUERIES.items():
        s = shape(fn(spark, SMOKE_DIR))
        assert s["python_udfs"] == 0, key
        if fn.__module__.endswith("q_relational"):
            assert s["scans_in_python"] == 0, key


def test_stages_over_a_bucketed_log_shuffle_nothing(spark):
    name = f"log_{uuid.uuid4().hex[:8]}"
    corpus = corpus_from_dir(spark, SMOKE_DIR)
    S.write_log(PL.stage2(PL.stage1(corpus)), name, as_table=True, buckets=4)
    log = S.read_log(spark, name, as_table=True)
    done = PL.stage3(log)
    assert shape(done)["exchanges"] == 0
    assert shape(A.assemble_query(log))["exchanges"] == 0 and shape(V.convert_log(log))["exchanges"] == 0
    finals = {r.query_id: r.final_query for r in done.filter("type = 'final'").collect()}
    plain = {r.query_id: r.final_query for r in registry.QUERIES["pipeline_stage3"](spark, SMOKE_DIR).collect()}
    assert finals == plain


def test_counts_of_names_shuffle_by_name_only(spark):
    """Over a log in buckets of the id, a query's names are settled where they lie."""
    name = f"log_{uuid.uuid4().hex[:8]}"
    S.write_log(PL.stage1(corpus_from_dir(spark, SMOKE_DIR)), name, as_table=True, buckets=4)
    counts = L.unique_values(S.read_log(spark, name, as_table=True), "tables", "table_name")
    plan = counts._jdf.queryExecution().executedPlan().toString()
    exchanges = [x.split("hashpartitioning(")[1].split(")")[0] for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert len(exchanges) == 1 and exchanges[0].startswith("table_name") and "query_id" not in exchanges[0], plan
    assert sorted(map(str, counts.collect())) == sorted(map(str, registry.QUERIES["unique_tables"](spark, SMOKE_DIR).collect()))
