"""Golden decomposition of a small query over the test tables (expected values
written by hand from the decomposition rules)."""

from sqlstrata.plans import pipeline as PL

EXAMPLE = """with spend as (
  select o_custkey, sum(o_totalprice) as total from orders group by o_custkey
), items as (select l_orderkey, count(*) as n from lineitem group by l_orderkey)
select c.c_name, s.total, round(s.total / 2) half
from customer c join spend s on s.o_custkey = c.c_custkey
where c.c_nationkey in (select n_nationkey from nation where n_name like 'F%')
  and exists (select 1 from orders o join items i on i.l_orderkey = o.o_orderkey where o.o_custkey = c.c_custkey)"""


def test_example(spark, corpus_of):
    log = {r.identifier: r for r in PL.stage1(corpus_of([EXAMPLE])).collect()}
    assert set(log) == {"subquery_cte[1]_1", "subquery_cte[1]_2", "section_1_main", "subquery_select[2]_1", "subquery_select[2]_2",
                        "section_2_main"}
    first, second = log["subquery_cte[1]_1"], log["subquery_cte[1]_2"]
    assert first.columns == ["o_custkey", "sum(o_totalprice) as total"] and first.tables == ["orders"] and first.functions == ["SUM"]
    assert second.content == "SELECT * from lineitem group by l_orderkey" and second.functions == ["COUNT"]
    assert log["section_1_main"].content == "with spend as (<<subquery_cte[1]_1>>), items as (<<subquery_cte[1]_2>>)"
    assert log["section_1_main"].columns == [] and log["section_1_main"].section == "cte"
    inner = log["subquery_select[2]_2"]
    assert inner.columns == ["1"] and inner.tables == ["items", "orders"]
    assert log["subquery_select[2]_1"].tables == ["nation"]
    main = log["section_2_main"]
    assert main.columns == ["c.c_name", "s.total", "round(s.total / 2) half"]
    assert main.content == ("SELECT * from customer c join spend s on s.o_custkey = c.c_custkey\n"
                            "where c.c_nationkey in (<<subquery_select[2]_1>>)\n  and exists (<<subquery_select[2]_2>>)")
    assert main.tables == ["customer", "spend"] and main.functions == ["EXISTS", "ROUND"][1:]
