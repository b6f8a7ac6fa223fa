"""Lineage and corpus statistics (D1-D6), all native expressions.

Per-row lists are higher-order-function expressions (no UDF). Corpus-wide
lists are grouped counts: partial aggregation runs map-side, so a table name
used by a third of all queries is pre-counted per task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlstrata.functions import patterns as P
from sqlstrata.functions.text import strip_comments


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tables_expr(c) -> Column:
    """Tables after FROM/JOIN, keyword-filtered, distinct, sorted, case kept."""
    found = F.regexp_extract_all(strip_comments(_c(c)), F.lit(P.TABLE_PATTERN), 1)
    stop = F.array(*[F.lit(w) for w in P.TABLE_STOPWORDS])
    kept = F.filter(found, lambda x: ~F.array_contains(stop, F.upper(x)))
    return F.when(_c(c).isNull(), F.array().cast("array<string>")).otherwise(
        F.array_sort(F.array_distinct(kept)))


def loose_tables_expr(c) -> Column:
    """Any non-space run after FROM / JOIN, lowercased, distinct, sorted."""
    both = F.concat(F.regexp_extract_all(_c(c), F.lit(P.LOOSE_FROM_PATTERN), 1),
                    F.regexp_extract_all(_c(c), F.lit(P.LOOSE_JOIN_PATTERN), 1))
    return F.when(_c(c).isNull(), F.array().cast("array<string>")).otherwise(
        F.array_sort(F.array_distinct(F.transform(both, lambda x: F.lower(F.trim(x))))))


def _funcs(c) -> Column:
    return F.regexp_extract_all(F.upper(c), F.lit(P.FUNCTION_PATTERN), 1)


def functions_expr(content, columns=None) -> Column:
    """Called functions (``NAME(``), upper-cased, minus keywords, from the
    content and every column, distinct and sorted."""
    stop = F.array(*[F.lit(w) for w in P.FUNCTION_STOPWORDS])
    found = F.coalesce(_funcs(_c(content)), F.array().cast("array<string>"))
    if columns is not None:
        per_col = F.flatten(F.transform(F.coalesce(_c(columns), F.array().cast("array<string>")),
                                        lambda x: F.coalesce(_funcs(x), F.array().cast("array<string>"))))
        found = F.concat(found, per_col)
    return F.array_sort(F.array_except(found, stop))


def with_tables(log: DataFrame, column: str = "content") -> DataFrame:
    return log.withColumn("tables", tables_expr(column))


def with_functions(log: DataFrame, content: str = "content", columns: str = "columns") -> DataFrame:
    return log.withColumn("functions", functions_expr(content, columns))


def _per_query(df: DataFrame, array_col: str, name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    ex = df.select(*keys, "query_id", F.explode(array_col).alias(name))
    return ex.groupBy(*keys, "query_id", name).agg(F.count(F.lit(1)).alias("n_rows"))


def unique_values(df: DataFrame, array_col: str, name: str) -> DataFrame:
    """``name, n_rows, n_queries`` over the exploded list column.

    Which queries hold a name is settled per query first: over a log in buckets of
    ``query_id`` that needs no exchange, and rows are shuffled by name only, as sums.
    Rows without an id count as rows, not as a query."""
    return (_per_query(df, array_col, name).groupBy(name)
            .agg(F.sum("n_rows").alias("n_rows"), F.count("query_id").alias("n_queries")))


def counts_by_part(log: DataFrame, part: str = "part") -> DataFrame:
    """``part, kind, name, n_rows, n_queries`` of the tables and functions of a log whose
    ``part`` follows ``query_id``: no query lies in two parts, so counts of parts add up."""
    out = None
    for kind in ("tables", "functions"):
        one = (_per_query(log, kind, "name", (part,)).groupBy(part, "name")
               .agg(F.sum("n_rows").alias("n_rows"), F.count("query_id").alias("n_queries"))
               .select(part, F.lit(kind).alias("kind"), "name", "n_rows", "n_queries"))
        out = one if out is None else out.unionByName(one)
    return out


def merged_counts(parts: DataFrame, kind: str) -> DataFrame:
    """D3 / D5 from stored counts of parts: ``name, n_rows, n_queries``."""
    return parts.filter(F.col("kind") == kind).groupBy("name").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_queries").alias("n_queries"))


def duplicate_subqueries(log: DataFrame, content_col: str = "content") -> DataFrame:
    """Subquery rows whose loose table key is shared with another subquery.

    Out (one row per member): ``table_key, n_copies, query_id, identifier``.
    Groups are never collected into one row: counts come from a grouped
    count (map-side partial aggregation), one row per key, and members are
    joined back. A hot key is left to the join: the summary is broadcast where
    its size allows, else AQE splits the members of the key.
    """
    subs = (log.filter(F.col("type") == "subquery")
               .select("query_id", "identifier",
                       F.concat_ws(",", loose_tables_expr(content_col)).alias("table_key")))
    counts = (subs.groupBy("table_key").agg(F.count(F.lit(1)).alias("n_copies"))
                  .filter(F.col("n_copies") > 1))
    return subs.join(counts, "table_key").select("table_key", "n_copies", "query_id", "identifier")


def duplicate_groups(log: DataFrame, content_col: str = "content") -> DataFrame:
    """D6 summary: ``table_key, n_copies, n_queries`` for keys seen more than once."""
    subs = (log.filter(F.col("type") == "subquery")
               .select("query_id", F.concat_ws(",", loose_tables_expr(content_col)).alias("table_key")))
    return (subs.groupBy("table_key")
                .agg(F.count(F.lit(1)).alias("n_copies"), F.countDistinct("query_id").alias("n_queries"))
                .filter(F.col("n_copies") > 1))
