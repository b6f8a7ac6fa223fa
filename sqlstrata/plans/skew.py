"""Skew-safe join of a big table to a per-key summary.

A per-key summary (one row per key) joined back to the member rows puts a
hot key's members into one task. Salting spreads them: every big-side row
gets a salt from a hash of its own columns, the summary side is copied once
per salt value, and the join runs on ``(keys, salt)``. The copy factor is a
parameter, not data-dependent, so the summary side grows by a fixed factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_join(big: DataFrame, summary: DataFrame, keys: list[str], salt_from: list[str],
                buckets: int = 16, how: str = "inner") -> DataFrame:
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in salt_from]), F.lit(buckets)).cast("int")
    b = big.withColumn("_salt", salt)
    s = summary.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return b.join(s, keys + ["_salt"], how).drop("_salt")
