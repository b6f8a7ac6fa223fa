"""Repeated and missing ids, texts of unusual shape, and the refresh of a log."""

import os
import time
import uuid

import pytest
from pyspark.sql import functions as F

from brute import subqueries as brute_subqueries
from sqlstrata.functions import boundaries as B
from sqlstrata.operators import assemble as A
from sqlstrata.operators import columns as C
from sqlstrata.operators import decompose as D
from sqlstrata.operators import lineage as L
from sqlstrata.plans import pipeline as PL
from sqlstrata.sources.corpus import distinct_texts

A7, B7 = "SELECT a FROM t WHERE (x=1)", "SELECT b, (SELECT MAX(c) FROM v) FROM u"


def corpus(spark, rows):
    return spark.createDataFrame(rows, "query_id bigint, sql string").repartition(3)


def test_texts_under_one_id_stay_apart(spark):
    rows = [(7, A7), (7, B7), (None, A7), (None, B7), (None, None), (8, A7), (8, A7)]
    df = corpus(spark, rows)
    sections = sorted((r.query_id or 0, r.content) for r in D.split_sections(df).collect())
    assert sections == sorted([(q or 0, t) for q, t in rows if t])
    log = D.decompose_log(df, select_lists=True).withColumn("converted_columns", F.col("columns"))
    finals = A.assemble_query(log).collect()
    assert sorted(((r.query_id or 0, r.final_query) for r in finals)) == sorted([(7, A7), (7, B7), (0, A7), (0, B7), (0, ""), (8, A7)])
    view = D.named_view(df)
    mains = sorted((r.query_id or 0, r.main or "") for r in A.main_text(view.filter("error is null")).collect())
    assert mains == sorted([(7, A7), (7, B7), (0, A7), (0, B7), (8, A7)])
    final = A.final_row(log)
    assert final.filter("type = 'final'").count() == 6 and A.final_row(final).filter("type = 'final'").count() == 6


def test_equal_rows_count_once(spark):
    df = corpus(spark, [(1, A7), (1, A7), (1, B7), (None, A7), (None, A7), (None, None), (None, None), (2, A7)])
    assert sorted(map(str, distinct_texts(df).collect())) == sorted(map(str, corpus(
        spark, [(1, A7), (1, B7), (None, A7), (None, None), (2, A7)]).collect()))


def test_scan_is_linear_in_width_and_depth():
    wide = "SELECT " + ", ".join(f"(SELECT {i} FROM t{i})" for i in range(10_000)) + " FROM u"
    deep = "SELECT " + "(SELECT " * 3000 + "1" + " FROM t)" * 3000 + " FROM u"
    for text, n in ((wide, 10_000), (deep, 3000)):
        t = time.time()
        pieces = B.scan(text)
        assert len(pieces) == n + 1 and time.time() - t < 20
    assert len(B.scan(wide)[-1].columns) == 10_000
    for text in ("(" * 100_000, ")" * 100_000, "'" * 99_999, '"' + "a" * 200_000, "select " * 20_000, "union\n" * 20_000, "a," * 200_000):
        t = time.time()
        B.scan(text)
        B.select_list(text)
        assert time.time() - t < 20


def test_assembly_of_ten_thousand_subqueries(spark):
    text = "SELECT " + ", ".join(f"(SELECT {i} FROM t{i})" for i in range(10_000)) + " FROM u"
    nested = "SELECT " + "(SELECT a, " * 200 + "1" + " FROM t)" * 200 + " FROM u"
    log = D.decompose_log(corpus(spark, [(1, text), (2, nested)]))
    t = time.time()
    got = {r.query_id: r.final_query for r in A.assemble_query(log).collect()}
    assert got == {1: text, 2: nested} and time.time() - t < 60


def test_a_text_of_many_megabytes_is_one_scan(spark):
    """50 MB of text: 40 sections, 80,000 subqueries."""
    part = "SELECT " + ", ".join(f"(SELECT c{i}, '" + "x" * 580 + f"' FROM t{i} WHERE k IN (1, 2))" for i in range(2000)) + " FROM u"
    text = " UNION ALL ".join([part] * 40)
    assert len(text) > 49e6
    rows = D.decompose_pieces(corpus(spark, [(1, text)])).groupBy("section").agg(
        F.count("*").alias("n"), F.sum((F.col("n") > 0).cast("int")).alias("subs")).collect()
    assert {r.section: (r.n, r.subs) for r in rows} == {"select": (40 * 2001, 80_000), "join": (39, 0)}


@pytest.mark.parametrize("text", [A7, B7, "SELECT (SELECT (SELECT 1) FROM a), ')' FROM b", "SELECT a FROM (SELECT b FROM (c) ) x WHERE (("])
def test_scan_equals_brute_force(text):
    pieces = [p for p in B.scan(text) if p.section == "select"]
    main, subs, unbalanced = brute_subqueries(text, "select", 1)
    assert pieces[-1].content == main and pieces[-1].unbalanced == unbalanced
    assert {p.n: p.content for p in pieces if p.n} == subs


def test_stored_and_fresh_select_lists_agree(spark):
    texts = [A7, B7, "WITH q AS (SELECT 1, 2) SELECT a, f(b, c), 'x, y' FROM q UNION SELECT 1", "UPDATE t SET a = 1", "", "SELECT DISTINCT a, b"]
    df = corpus(spark, list(enumerate(texts)))
    one = D.decompose_log(df, select_lists=True)
    two = C.log_with_columns(D.decompose_log(df))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.select(*one.columns).collect()))


def files_of(spark, table):
    return {f for f in spark.table(table).inputFiles() if not os.path.basename(f).startswith("_")}


def test_refresh_rewrites_only_what_changed(spark):
    name = f"kept_{uuid.uuid4().hex[:8]}"
    texts = {i: f"SELECT a{i}, NVL(b, {i}), (SELECT MAX(c) FROM t{i}) FROM u" for i in range(1000)}
    df = corpus(spark, list(texts.items()) + [(None, A7), (None, B7)])
    first = PL.refresh(spark, df, name, parts=16)
    assert first.filter("type = 'final'").count() == 1002
    before, rows = files_of(spark, name), {str(r) for r in first.drop("part").collect()}
    assert PL.refresh(spark, df, name, parts=16).count() == len(rows) and files_of(spark, name) == before  # nothing changed, nothing written

    texts[17] = "SELECT SYSDATE FROM changed"
    df = corpus(spark, list(texts.items()) + [(None, A7), (None, B7)])
    second = PL.refresh(spark, df, name, parts=16)
    after = files_of(spark, name)
    parts = lambda files: {f.split("part=")[1].split("/")[0] for f in files}
    assert len(parts(before - after)) == 1 and parts(after - before) == parts(before - after)
    again = {str(r) for r in second.drop("part").collect()}
    assert {r for r in rows - again} and all("query_id=17," in r for r in (rows - again) | (again - rows))
    fin = {r.query_id: r.final_query for r in second.filter("type = 'final' and query_id = 17").collect()}
    assert fin == {17: "SELECT CURRENT_TIMESTAMP() FROM changed"}

    for kind in ("tables", "functions"):  # counts kept by partition equal counts of the whole log
        kept = L.merged_counts(spark.table(f"{name}_names"), kind)
        whole = L.unique_values(second.filter("type <> 'final'"), kind, "name")
        assert sorted(map(str, kept.collect())) == sorted(map(str, whole.collect())) and kept.count() > 0

    # texts that go: also when none of their partition is left
    keep = corpus(spark, [(i, t) for i, t in texts.items() if i < 3])
    third = PL.refresh(spark, keep, name, parts=16)
    assert sorted(r.query_id for r in third.filter("type = 'final'").collect()) == [0, 1, 2]
    assert sorted(r.query_id for r in spark.table(f"{name}_texts").collect()) == [0, 1, 2]
