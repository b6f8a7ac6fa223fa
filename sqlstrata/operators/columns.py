"""Select lists.

The scan that decomposes a text (``functions.boundaries``) also knows the select
list of every piece, so a log with columns comes from that one scan
(``decompose_log(corpus, select_lists=True)``). For a log that was stored or
patched, or any other table of texts, the same scan runs over each row's own
text. Both are row-local: no exchange, and rows keep their other columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlstrata.functions import boundaries as B
from sqlstrata.functions import patterns as P
from sqlstrata.operators.decompose import row_local

LOG_KEYS = ["query_id", "section_id", "identifier"]
_FOUND = T.StructType([T.StructField("columns", T.ArrayType(T.StringType())), T.StructField("star_content", T.StringType())])


def _one_list(text: str) -> list[tuple]:
    return [B.select_list(text)]


def split_columns(df: DataFrame, keys=LOG_KEYS, content_col: str = "content",
                  carry: bool = False) -> DataFrame:
    """C1 + C2 per row: ``keys..., columns ARRAY<STRING>, star_content``.

    ``star_content`` is the text with the select list replaced by ``*``
    (``SELECT * FROM ...``); rows without a depth-0 SELECT keep their text and
    get no columns. DISTINCT stays glued to the first column, as the
    reference does, so that reassembly is exact. With ``carry`` every column of
    the input comes along (but for those two names).
    """
    names = [c for c in (df.columns if carry else keys) if c not in ("columns", "star_content")]
    return row_local(df, content_col, names, _FOUND, _one_list)


def log_with_columns(log: DataFrame) -> DataFrame:
    """The log with ``columns`` filled and ``content`` as the ``SELECT *`` form.

    Conversion fields are reset, as in the reference's stage 1.
    """
    out = split_columns(log, carry=True)
    empty = F.array().cast("array<string>")
    new = {
        "columns": F.col("columns"),
        "content": F.col("star_content"),
        "final_query": F.lit(""),
        "converted_content": F.lit(""),
        "converted_columns": empty,
    }
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in log.columns])


def column_chunks(df: DataFrame, k: int, keys=LOG_KEYS, columns_col: str = "columns") -> DataFrame:
    """C4: chunks of ``k`` columns: ``keys..., chunk INT, cols ARRAY, chunk_query``.

    ``chunk_query`` is ``SELECT c1, c2, ... FROM dummy`` as sent for
    conversion.
    """
    keys = list(keys)
    arr = F.col(columns_col)
    chunks = F.transform(F.sequence(F.lit(0), F.size(arr) - 1, F.lit(k)),
                         lambda i: F.slice(arr, i + 1, k))
    out = (df.filter(F.size(arr) > 0)
             .select(*keys, F.posexplode(chunks).alias("chunk", "cols")))
    return out.select(*keys, F.col("chunk").cast("int").alias("chunk"), "cols",
                      F.concat(F.lit(P.CHUNK_QUERY_PREFIX), F.array_join("cols", P.CHUNK_SEPARATOR),
                               F.lit(P.CHUNK_QUERY_SUFFIX)).alias("chunk_query"))
