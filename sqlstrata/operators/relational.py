"""Relational operators the conversion rules call for.

Each takes DataFrames and key/column names. Scale notes:

* per-key statistics are grouped aggregates joined back (map-side partial
  aggregation; AQE sizes the join at run time) -- a window partitioned by a
  key would put a hot key's rows into one task;
* top-1 per key is ``max_by``/``min_by`` in an aggregate, for the same reason;
* lookups are reduced to one row per key (a defined one) before the join, so the
  result never fans out;
* no join is hinted to broadcast: Spark broadcasts only what its size
  statistics (or AQE's runtime sizes) prove small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlstrata.session import materialize


def lookup_join(left: DataFrame, dim: DataFrame, on: list[str], cols: list[str]) -> DataFrame:
    """H1: scalar lookup (correlated subquery returning one value) as a left
    join to the deduplicated lookup table."""
    # of several rows of a key, the first by the looked-up columns
    d = dim.select(*on, F.struct(*cols).alias("_row")).groupBy(*on).agg(F.min("_row").alias("_row"))
    return left.join(d, on, "left").select(*[F.col(c) for c in left.columns], *[F.col(f"_row.{c}").alias(c) for c in cols])


def top1_per_key(df: DataFrame, keys: list[str], order: list[Column], cols: list[str]) -> DataFrame:
    """H2 core: the row with the largest ``order`` per key (ROWNUM = 1 per key)."""
    pick = F.max_by(F.struct(*[F.col(c) for c in cols]), F.struct(*order))
    return df.groupBy(*keys).agg(pick.alias("_p")).select(*keys, *[F.col(f"_p.{c}").alias(c) for c in cols])


def lookup_top1(left: DataFrame, right: DataFrame, left_on: str, right_on: str,
                order: list[Column], cols: list[str]) -> DataFrame:
    """H2: lookup with ROWNUM = 1: top row per key, then a left join."""
    top = top1_per_key(right, [right_on], order, cols).withColumnRenamed(right_on, left_on)
    return left.join(top, left_on, "left")


def global_top1(df: DataFrame, order: list[Column], cols: list[str]) -> DataFrame:
    """H3: global ROWNUM = 1 as an aggregate (``max_by``), no global sort."""
    pick = F.max_by(F.struct(*[F.col(c) for c in cols]), F.struct(*order))
    return df.agg(pick.alias("_p")).select(*[F.col(f"_p.{c}").alias(c) for c in cols])


def nvl(c, default) -> Column:
    """H4: NVL(x, d)."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(default))


def safe_ratio(num, den, scale: int = 2) -> Column:
    """H5: CASE WHEN NVL(den, 0) = 0 THEN 0 ELSE ROUND(num / den, scale) END.
    Give decimals for a result that rounds alike in every engine."""
    n = F.col(num) if isinstance(num, str) else num
    d = F.col(den) if isinstance(den, str) else den
    return F.when(F.coalesce(d, F.lit(0)) == 0, F.lit(0)).otherwise(F.round(n / d, scale))


def group_stat_join(df: DataFrame, keys: list[str], aggs: list[Column], how: str = "left") -> DataFrame:
    """Per-key aggregates joined back to the rows."""
    return df.join(df.groupBy(*keys).agg(*aggs), keys, how)


def exists_flag(left: DataFrame, right: DataFrame, left_on: str, right_on: str,
                name: str = "exists_flag") -> DataFrame:
    """EXISTS inside CASE -> left join to the distinct keys."""
    k = right.select(F.col(right_on).alias("_k")).distinct().withColumn("_hit", F.lit(True))
    out = left.join(k, left[left_on] == k["_k"], "left")
    return out.withColumn(name, F.col("_hit").isNotNull()).drop("_k", "_hit")


def uncorrelated_exists(left: DataFrame, probe: DataFrame) -> DataFrame:
    """H12 (uncorrelated): keep ``left`` iff ``probe`` has a row; planned as a
    one-off EXISTS subquery, not a join."""
    return left.where(probe.exists())


def detail_plus_totals(detail: DataFrame, keys: list[str], aggs: list[Column]) -> DataFrame:
    """Detail rows UNION ALL per-key totals, missing columns padded with NULL."""
    totals = detail.groupBy(*keys).agg(*aggs)
    return detail.unionByName(totals, allowMissingColumns=True)


def hierarchy_walk(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """CONNECT BY over ``edges(node, parent)``: ``node, root, depth,
    error`` for every node (depth 0 at the root).

    Pointer doubling: each round every open path jumps as far as all rounds
    before together, so ``log2(depth)`` rounds do, whatever the number of rows
    or levels. Rounds are written (lineage cut). A path that has not ended after
    as many jumps as there are nodes runs in a cycle: ``error`` says so. A
    parent that is no node itself counts as a root.
    """
    state = edges.select("node", F.coalesce("parent", "node").alias("cur"), F.col("parent").isNotNull().cast("long").alias("depth"),
                         F.col("parent").isNull().alias("ended"))
    state = materialize(state)
    nodes, jumped = state.count(), 1
    while jumped <= 2 * nodes:
        open_ = state.filter("not ended")
        if open_.isEmpty():
            break
        # only the rows that some path stands on: few, where many paths share them
        on = open_.select(F.col("cur").alias("_n")).distinct()
        ahead = state.select(F.col("node").alias("_n"), F.col("cur").alias("_c"), F.col("depth").alias("_d"),
                             F.col("ended").alias("_e")).join(on, "_n")
        step = open_.join(ahead, F.col("cur") == F.col("_n"), "left").select(
            "node", F.coalesce("_c", "cur").alias("cur"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"),
            F.coalesce("_e", F.lit(True)).alias("ended"))
        state = materialize(state.filter("ended").unionByName(step))
        jumped *= 2
    best = state.groupBy("node").agg(F.max_by(F.struct("cur", "depth", "ended"), F.struct("ended", "depth", "cur")).alias("b"))
    ok = F.col("b.ended")
    return best.select("node", F.when(ok, F.col("b.cur")).alias("root"), F.when(ok, F.col("b.depth").cast("int")).alias("depth"),
                       F.when(~ok, F.lit("cycle")).alias("error"))


def hierarchy_closure(edges: DataFrame, with_path: bool = False) -> DataFrame:
    """The closure of ``edges(node, parent)``: ``ancestor, descendant, distance, cycle``
    and, with ``with_path``, ``path`` (array, from the ancestor to the descendant).

    One row per pair that a path of parents joins, with the least number of steps (and
    the smallest of the shortest paths, where a node has several parents). A pair of a node
    with itself, which only a cycle gives, is marked in ``cycle``. Rows without a parent
    add nothing, repeated rows count once.

    Semi-naive doubling: the pairs of a round are those of the longest distance so far
    joined with all, so distances up to 2^k take k rounds, and only pairs that were not
    known go on. Rounds are written (lineage cut). A node on a third of all paths is a
    skewed key of one side only, which adaptive execution splits.
    """
    step = edges.filter("node is not null and parent is not null").select(F.col("parent").alias("ancestor"), F.col("node").alias("descendant")).distinct()
    path = F.array("ancestor", "descendant") if with_path else F.array().cast(f"array<{step.schema['ancestor'].dataType.simpleString()}>")
    known = materialize(step.select("ancestor", "descendant", F.lit(1).cast("long").alias("distance"), path.alias("path")))
    reach = 1
    while True:
        far = known.filter(F.col("distance") == reach).select(F.col("ancestor").alias("_mid"), "descendant", F.col("path").alias("_low"))
        up = known.select("ancestor", F.col("descendant").alias("_mid"), "distance", F.col("path").alias("_high"))
        both = F.concat("_high", F.slice("_low", 2, F.greatest(F.size("_low") - 1, F.lit(0)))) if with_path else F.col("_high")
        found = far.join(up, "_mid").select("ancestor", "descendant", (F.col("distance") + reach).alias("distance"), both.alias("path"))
        best = found.groupBy("ancestor", "descendant").agg(F.min(F.struct("distance", "path")).alias("_b"))
        new = best.select("ancestor", "descendant", "_b.distance", "_b.path").join(known.select("ancestor", "descendant"), ["ancestor", "descendant"], "left_anti")
        new = materialize(new)
        if new.isEmpty():
            break
        known, reach = known.unionByName(new), reach * 2
    out = known.withColumn("cycle", F.col("ancestor") == F.col("descendant"))
    return out.select("ancestor", "descendant", "distance", *(["path"] if with_path else []), "cycle")


def unpacked(df: DataFrame, keep: list[str], columns: dict[str, tuple[str, int]]) -> DataFrame:
    """A very wide projection: ``keep``, and ``columns`` by name as entries (array
    column, index from 0). Hundreds of columns are computed as few array
    expressions and become columns here, last: each is one field access, so generated
    code, planning and what joins and exchanges below carry stay small. The arrays are
    computed once per row (they are more than a reference, and read more than once)."""
    return df.selectExpr(*[f"`{c}`" for c in keep], *[f"`{a}`[{i}] AS `{c}`" for c, (a, i) in columns.items()])


def register_user_function(spark: SparkSession, name: str, params: str, returns: str, body: str) -> None:
    """An opaque user function kept by name, as a SQL function (inlined
    by the optimizer, runs in the JVM)."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {returns} RETURN {body}")


def create_view(spark: SparkSession, name: str, sql: str) -> DataFrame:
    """CREATE OR REPLACE VIEW of a converted query (temporary view)."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} AS {sql}")
    return spark.table(name)
