"""Row-local text expressions (JVM-side, codegen'd, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sqlstrata.functions import patterns as P


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_comments(c) -> Column:
    """B1: drop ``--`` and ``/* */`` comments; literals are kept whole."""
    c = _c(c)
    return F.when(c.contains("--") | c.contains("/*"), F.regexp_replace(c, P.STRIP, "$1")).otherwise(c)


def normalize_ws(c) -> Column:
    """B2: collapse whitespace runs outside literals to one space and trim."""
    return strip_ws(F.regexp_replace(_c(c), P.WS, "$1 "))


def strip_ws(c) -> Column:
    """Python ``str.strip()`` on ASCII whitespace (``trim`` only removes spaces)."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def ordered_concat(pos: str = "pos", tok: str = "tok", sep: str = "") -> Column:
    """Aggregate: the tokens of a group concatenated in ``pos`` order."""
    return F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos), F.col(tok)))),
                    lambda x: x[tok]), sep)


def is_blank(c) -> Column:
    return _c(c).isNull() | _c(c).rlike(P.BLANK)
