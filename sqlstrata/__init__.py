"""sqlstrata: query-log analytics on Spark.

A corpus of SQL texts ``(query_id, sql)`` goes in; relational tables come out:
sections, subqueries, select-list columns, lineage, conversion log and the
reassembled text. Every operator is ``DataFrame -> DataFrame`` built from
built-in Spark expressions, windows and aggregates.
"""

from sqlstrata.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
