"""Registered relational queries (H) over the TPC-H-like tables.

Outputs avoid floating-point sums and ROUND on doubles (engines differ in
summation order and rounding of binary fractions); integer and exact values
are compared instead.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sqlstrata.operators import relational as R
from sqlstrata.plans.registry import register


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@register("lookup_join", """
SELECT c.c_custkey, c.c_name, n.n_name FROM customer c
LEFT JOIN (SELECT DISTINCT ON (n_nationkey) n_nationkey, n_name FROM nation ORDER BY n_nationkey, n_name) n
  ON c.c_nationkey = n.n_nationkey""")
def q_lookup_join(spark, sf):
    c = _t(spark, sf, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey"))
    return R.lookup_join(c, _t(spark, sf, "nation"), ["n_nationkey"], ["n_name"]).select("c_custkey", "c_name", "n_name")


@register("lookup_top1", """
SELECT c.c_custkey, t.o_orderkey, t.o_totalprice FROM customer c LEFT JOIN (
  SELECT o_custkey, o_orderkey, o_totalprice FROM (
    SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey ASC) AS rn
    FROM orders) WHERE rn = 1) t ON t.o_custkey = c.c_custkey""")
def q_lookup_top1(spark, sf):
    c = _t(spark, sf, "customer").select("c_custkey")
    o = _t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return R.lookup_top1(c, o, "c_custkey", "c_custkey",
                         [F.col("o_totalprice"), -F.col("o_orderkey")], ["o_orderkey", "o_totalprice"])


@register("global_top1", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey ASC LIMIT 1""")
def q_global_top1(spark, sf):
    return R.global_top1(_t(spark, sf, "orders"), [F.col("o_totalprice"), -F.col("o_orderkey")],
                         ["o_orderkey", "o_custkey", "o_totalprice"])


@register("nvl_default", """
SELECT c.c_custkey, CAST(coalesce(o.n, 0) AS BIGINT) AS n_orders, coalesce(o.mx, 0.0) AS max_price
FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS mx FROM orders GROUP BY o_custkey) o
  ON o.o_custkey = c.c_custkey""")
def q_nvl_default(spark, sf):
    o = _t(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"),
                                                         F.max("o_totalprice").alias("mx"))
    c = _t(spark, sf, "customer").select("c_custkey")
    j = c.join(o, c.c_custkey == o.o_custkey, "left")
    return j.select("c_custkey", R.nvl("n", 0).cast("bigint").alias("n_orders"),
                    R.nvl("mx", 0.0).alias("max_price"))


@register("safe_ratio", """
SELECT l_orderkey, CASE WHEN coalesce(den, 0) = 0 THEN 0 ELSE CAST((200 * num + den) // (2 * den) AS DOUBLE) / 100 END AS ratio
FROM (SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS num,
             sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS den FROM lineitem GROUP BY l_orderkey)""")
def q_safe_ratio(spark, sf):
    g = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sum((F.col("l_returnflag") == "R").cast("long")).alias("num"),
        F.sum((F.col("l_linestatus") == "O").cast("long")).alias("den"))
    ratio = R.safe_ratio(F.col("num").cast("decimal(18,0)"), F.col("den").cast("decimal(18,0)"))
    return g.select("l_orderkey", ratio.cast("double").alias("ratio"))


@register("comma_join", """
SELECT o.o_orderkey, c.c_name, c.c_mktsegment FROM orders o, customer c WHERE o.o_custkey = c.c_custkey""")
def q_comma_join(spark, sf):
    o, c = _t(spark, sf, "orders"), _t(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey, "inner").select("o_orderkey", "c_name", "c_mktsegment")


@register("multiway_join", """
SELECT o.o_orderkey, c.c_name, n.n_name, l.l_quantity, c2.c_custkey AS peer
FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey AND n.n_regionkey IN (1, 2, 3)
JOIN customer c2 ON c2.c_custkey = c.c_custkey AND c2.c_mktsegment = c.c_mktsegment
LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_linenumber = 1
WHERE o.o_orderstatus = 'F' OR o.o_totalprice > 200000""")
def q_multiway_join(spark, sf):
    o, c, n, l = (_t(spark, sf, t) for t in ("orders", "customer", "nation", "lineitem"))
    c2 = c.select(F.col("c_custkey").alias("peer"), F.col("c_mktsegment").alias("seg2"))
    o = o.filter((F.col("o_orderstatus") == "F") | (F.col("o_totalprice") > 200000))
    n = n.filter(F.col("n_regionkey").isin(1, 2, 3))
    l1 = l.filter(F.col("l_linenumber") == 1).select("l_orderkey", "l_quantity")
    j = (o.join(c, o.o_custkey == c.c_custkey)
          .join(n, c.c_nationkey == n.n_nationkey)
          .join(c2, (c2.peer == c.c_custkey) & (c2.seg2 == c.c_mktsegment))
          .join(l1, o.o_orderkey == l1.l_orderkey, "left"))
    return j.select("o_orderkey", "c_name", "n_name", "l_quantity", "peer")


@register("left_join", """
SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey""")
def q_left_join(spark, sf):
    c, o = _t(spark, sf, "customer"), _t(spark, sf, "orders")
    return c.join(o, o.o_custkey == c.c_custkey, "left").select("c_custkey", "o_orderkey")


@register("derived_join", """
SELECT c.c_custkey, c.c_name, d.n_orders, d.max_price FROM customer c
JOIN (SELECT o_custkey, CAST(count(*) AS BIGINT) AS n_orders, max(o_totalprice) AS max_price FROM orders GROUP BY o_custkey) d
  ON d.o_custkey = c.c_custkey""")
def q_derived_join(spark, sf):
    d = _t(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"),
                                                         F.max("o_totalprice").alias("max_price"))
    c = _t(spark, sf, "customer")
    return c.join(d, d.o_custkey == c.c_custkey).select("c_custkey", "c_name", "n_orders", "max_price")


@register("in_semi", """
SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def q_in_semi(spark, sf):
    o = _t(spark, sf, "orders")
    c = _t(spark, sf, "customer").filter(F.col("c_mktsegment") == "BUILDING").select("c_custkey")
    return o.join(c, o.o_custkey == c.c_custkey, "left_semi").select("o_orderkey", "o_custkey")


@register("in_above_avg", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (
  SELECT c_custkey FROM customer c
  WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer c3 WHERE c3.c_nationkey = c.c_nationkey))""")
def q_in_above_avg(spark, sf):
    c = _t(spark, sf, "customer")
    rich = (R.group_stat_join(c, ["c_nationkey"], [F.avg("c_acctbal").alias("_avg")])
            .filter(F.col("c_acctbal") > F.col("_avg")).select("c_custkey"))
    o = _t(spark, sf, "orders")
    return o.join(rich, o.o_custkey == rich.c_custkey, "left_semi").select("o_orderkey", "o_custkey")


@register("exists_semi", """
SELECT c_custkey, 'correlated' AS kind FROM customer c
WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')
UNION ALL
SELECT c_custkey, 'uncorrelated' FROM customer
WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderpriority = '1-URGENT')""")
def q_exists_semi(spark, sf):
    c, o = _t(spark, sf, "customer"), _t(spark, sf, "orders")
    corr = c.join(o.filter(F.col("o_orderstatus") == "F"), c.c_custkey == o.o_custkey, "left_semi")
    unc = R.uncorrelated_exists(c, o.filter(F.col("o_orderpriority") == "1-URGENT"))
    return (corr.select("c_custkey", F.lit("correlated").alias("kind"))
            .unionByName(unc.select("c_custkey", F.lit("uncorrelated").alias("kind"))))


@register("exists_flag", """
SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey) THEN 'Y' ELSE 'N' END AS has_orders
FROM customer c""")
def q_exists_flag(spark, sf):
    c, o = _t(spark, sf, "customer"), _t(spark, sf, "orders")
    f = R.exists_flag(c, o, "c_custkey", "o_custkey", "hit")
    return f.select("c_custkey", F.when(F.col("hit"), "Y").otherwise("N").alias("has_orders"))


@register("in_list", """
SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
WHERE o_orderstatus IN ('F', 'O') AND coalesce(o_orderpriority, 'N') NOT IN ('1-URGENT', '2-HIGH')""")
def q_in_list(spark, sf):
    o = _t(spark, sf, "orders")
    return o.filter(F.col("o_orderstatus").isin("F", "O")
                    & ~R.nvl("o_orderpriority", "N").isin("1-URGENT", "2-HIGH")).select(
        "o_orderkey", "o_orderstatus", "o_orderpriority")


@register("above_group_avg", """
SELECT c_custkey, c_nationkey,
  CASE WHEN c_acctbal > (SELECT avg(c_acctbal) FROM customer c2 WHERE c2.c_nationkey = c.c_nationkey)
       THEN 'above' ELSE 'at or below' END AS band
FROM customer c""")
def q_above_group_avg(spark, sf):
    c = R.group_stat_join(_t(spark, sf, "customer"), ["c_nationkey"], [F.avg("c_acctbal").alias("_avg")])
    return c.select("c_custkey", "c_nationkey",
                    F.when(F.col("c_acctbal") > F.col("_avg"), "above").otherwise("at or below").alias("band"))


@register("scalar_agg_default", """
SELECT c.c_custkey,
  CAST(coalesce((SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'O'), 0) AS BIGINT) AS n_open,
  coalesce((SELECT max(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'O'), 0.0) AS max_open
FROM customer c""")
def q_scalar_agg_default(spark, sf):
    o = (_t(spark, sf, "orders").filter(F.col("o_orderstatus") == "O")
         .groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("mx")))
    c = _t(spark, sf, "customer").select("c_custkey")
    j = c.join(o, o.o_custkey == c.c_custkey, "left")
    return j.select("c_custkey", R.nvl("n", 0).cast("bigint").alias("n_open"), R.nvl("mx", 0.0).alias("max_open"))


@register("cte_aggregates", """
WITH li AS (
  SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, CAST(count(*) AS BIGINT) AS n_lines,
         max(l_extendedprice) AS max_price, min(l_discount) AS min_disc
  FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-06-17 00:00:00' GROUP BY l_returnflag, l_linestatus)
SELECT * FROM li""")
def q_cte_aggregates(spark, sf):
    l = _t(spark, sf, "lineitem").filter(F.col("l_shipdate") < F.lit("1995-06-17 00:00:00").cast("timestamp_ntz"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.count(F.lit(1)).alias("n_lines"),
        F.max("l_extendedprice").alias("max_price"), F.min("l_discount").alias("min_disc"))


@register("detail_plus_totals", """
SELECT c_custkey, c_nationkey, CAST(1 AS BIGINT) AS n, c_acctbal AS max_acctbal FROM customer
UNION ALL
SELECT NULL, c_nationkey, CAST(count(*) AS BIGINT), max(c_acctbal) FROM customer GROUP BY c_nationkey""")
def q_detail_plus_totals(spark, sf):
    d = _t(spark, sf, "customer").select("c_custkey", "c_nationkey", F.lit(1).cast("bigint").alias("n"),
                                         F.col("c_acctbal").alias("max_acctbal"))
    return R.detail_plus_totals(d, ["c_nationkey"], [F.count(F.lit(1)).alias("n"),
                                                     F.max("max_acctbal").alias("max_acctbal")])


@register("set_ops", """
SELECT 'union' AS op, k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)
UNION ALL
SELECT 'intersect', k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000
                            INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL
SELECT 'except', k FROM (SELECT c_nationkey AS k FROM customer WHERE c_mktsegment = 'BUILDING'
                         EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0)""")
def q_set_ops(spark, sf):
    c, s = _t(spark, sf, "customer"), _t(spark, sf, "supplier")
    ck = c.select(F.col("c_nationkey").alias("k"))
    sk = s.select(F.col("s_nationkey").alias("k"))
    u = ck.union(sk).distinct()
    i = c.filter(F.col("c_acctbal") > 5000).select(F.col("c_nationkey").alias("k")).intersect(sk)
    e = (c.filter(F.col("c_mktsegment") == "BUILDING").select(F.col("c_nationkey").alias("k"))
         .subtract(s.filter(F.col("s_acctbal") > 0).select(F.col("s_nationkey").alias("k"))))
    return (u.select(F.lit("union").alias("op"), "k").unionByName(i.select(F.lit("intersect").alias("op"), "k"))
            .unionByName(e.select(F.lit("except").alias("op"), "k")))


@register("ordered_output", """
SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey""")
def q_ordered_output(spark, sf):
    return _t(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal").orderBy(
        F.col("c_acctbal").desc(), "c_custkey")


@register("parse_date", """
SELECT o_orderkey, CAST(strptime(strftime(o_orderdate, '%Y%m%d'), '%Y%m%d') AS DATE) AS order_day,
       TRY_CAST(NULL AS DATE) AS bad_day
FROM orders""")
def q_parse_date(spark, sf):
    o = _t(spark, sf, "orders")
    s = F.date_format("o_orderdate", "yyyyMMdd")
    return o.select("o_orderkey", F.to_date(s, "yyyyMMdd").alias("order_day"),
                    F.try_to_date(F.concat(s, F.lit("x")), "yyyyMMdd").alias("bad_day"))


@register("scalar_mix", """
SELECT c.c_custkey, upper(c.c_name) AS name_u, concat(c.c_name, '-', CAST(c.c_custkey AS VARCHAR)) AS tag,
       CAST(year(o.o_orderdate) AS INTEGER) AS y, CAST(month(o.o_orderdate) AS INTEGER) AS m,
       coalesce(CAST(o.o_orderkey AS VARCHAR), 'N/A') AS last_order
FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P'""")
def q_scalar_mix(spark, sf):
    c = _t(spark, sf, "customer")
    o = _t(spark, sf, "orders").filter(F.col("o_orderstatus") == "P")
    j = c.join(o, o.o_custkey == c.c_custkey, "left")
    return j.select("c_custkey", F.upper("c_name").alias("name_u"),
                    F.concat("c_name", F.lit("-"), F.col("c_custkey").cast("string")).alias("tag"),
                    F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"),
                    F.coalesce(F.col("o_orderkey").cast("string"), F.lit("N/A")).alias("last_order"))


_EDGES_SQL = """
edges AS (
  SELECT 'R' || CAST(r_regionkey AS VARCHAR) AS node, NULL::VARCHAR AS parent FROM region
  UNION ALL SELECT 'N' || CAST(n_nationkey AS VARCHAR), 'R' || CAST(n_regionkey AS VARCHAR) FROM nation
  UNION ALL SELECT 'C' || CAST(c_custkey AS VARCHAR), 'N' || CAST(c_nationkey AS VARCHAR) FROM customer
)"""


@register("hierarchy_walk", f"""
WITH RECURSIVE {_EDGES_SQL.strip()},
walk(node, cur, depth) AS (
  SELECT node, node, 0 FROM edges
  UNION ALL
  SELECT w.node, e.parent, w.depth + 1 FROM walk w JOIN edges e ON e.node = w.cur WHERE e.parent IS NOT NULL
)
SELECT node, arg_max(cur, depth) AS root, CAST(max(depth) AS INTEGER) AS depth, NULL::VARCHAR AS error FROM walk GROUP BY node""")
def q_hierarchy_walk(spark, sf):
    return R.hierarchy_walk(spark, _edges(spark, sf))


def _edges(spark, sf):
    r, n, c = (_t(spark, sf, t) for t in ("region", "nation", "customer"))
    return (r.select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("node"),
                      F.lit(None).cast("string").alias("parent"))
             .unionByName(n.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("node"),
                                   F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("parent")))
             .unionByName(c.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("node"),
                                   F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("parent"))))


@register("hierarchy_closure", f"""
WITH RECURSIVE {_EDGES_SQL.strip()},
up(ancestor, descendant, distance, path) AS (
  SELECT parent, node, 1, parent || '/' || node FROM edges WHERE parent IS NOT NULL
  UNION ALL
  SELECT e.parent, u.descendant, u.distance + 1, e.parent || '/' || u.path FROM up u JOIN edges e ON e.node = u.ancestor WHERE e.parent IS NOT NULL
)
SELECT ancestor, descendant, CAST(distance AS BIGINT) AS distance, path, ancestor = descendant AS cycle FROM up""")
def q_hierarchy_closure(spark, sf):
    return R.hierarchy_closure(_edges(spark, sf), with_path=True).withColumn("path", F.array_join("path", "/"))


_WIDE_N = 599


def _wide_sql():
    cols = []
    for i in range(1, _WIDE_N + 1):
        if i % 10 == 0:
            cols.append(f"CASE WHEN coalesce(s.n_orders, 0) > {i // 10} THEN s.max_key ELSE 0 END AS w{i}")
        else:
            cols.append(f"c.c_custkey * {i} + c.c_nationkey AS w{i}")
    return ("SELECT c.c_custkey, " + ", ".join(cols) + " FROM customer c LEFT JOIN "
            "(SELECT o_custkey, count(*) AS n_orders, max(o_orderkey) AS max_key FROM orders GROUP BY o_custkey) s "
            "ON s.o_custkey = c.c_custkey")


@register("wide_projection", _wide_sql())
def q_wide_projection(spark, sf):
    """Many computed columns; the repeated lookups share one aggregate join. One
    array holds each kind of column; the columns are unpacked last."""
    c = _t(spark, sf, "customer")
    s = _t(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"),
                                                         F.max("o_orderkey").alias("max_key"))
    j = c.join(s, s.o_custkey == c.c_custkey, "left").select("c_custkey", "c_nationkey", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), "max_key")
    lookup = F.transform(F.sequence(F.lit(1), F.lit(_WIDE_N // 10)), lambda i: F.when(F.col("n_orders") > i, F.col("max_key")).otherwise(F.lit(0)))
    plain = F.transform(F.sequence(F.lit(1), F.lit(_WIDE_N)), lambda i: F.col("c_custkey") * i + F.col("c_nationkey"))
    return R.unpacked(j.select("c_custkey", lookup.alias("lookup"), plain.alias("plain")), ["c_custkey"], {
        f"w{i}": ("plain", i - 1) if i % 10 else ("lookup", i // 10 - 1) for i in range(1, _WIDE_N + 1)})


@register("user_function", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) * 2 + 1 AS f FROM lineitem")
def q_user_function(spark, sf):
    R.register_user_function(spark, "twice_plus_one", "x DOUBLE", "DOUBLE", "x * 2 + 1")
    _t(spark, sf, "lineitem").createOrReplaceTempView("uf_lineitem")
    return spark.sql("SELECT l_orderkey, l_linenumber, twice_plus_one(l_quantity) AS f FROM uf_lineitem")


@register("create_view", """
SELECT o.o_orderkey, c.c_name, coalesce(o.o_orderpriority, 'N') AS prio, CAST(o.o_orderdate AS DATE) AS d
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""")
def q_create_view(spark, sf):
    _t(spark, sf, "orders").createOrReplaceTempView("cv_orders")
    _t(spark, sf, "customer").createOrReplaceTempView("cv_customer")
    return R.create_view(spark, "converted_view", """
        SELECT o.o_orderkey, c.c_name, COALESCE(o.o_orderpriority, 'N') AS prio,
               to_date(date_format(o.o_orderdate, 'yyyyMMdd'), 'yyyyMMdd') AS d
        FROM cv_orders o JOIN cv_customer c ON o.o_custkey = c.c_custkey""")
