"""Text -> rows decomposition.

Work unit: one query text. ``functions.boundaries`` finds the sections,
subqueries and select lists of a text in one pass; here its pieces become rows.
That is row-local: decomposition has no exchange, no sort and no window, and
its parallelism is that of the corpus files. Batches of texts go through
``mapInArrow`` in slices of bounded size.

``text_key`` (a hash of the text as given) goes with ``query_id`` through the whole
chain, so different texts under one id, or without an id, stay apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlstrata.functions import boundaries as B
from sqlstrata.functions.text import strip_comments
from sqlstrata.session import ship_code

UNBALANCED = "unbalanced parentheses"

# Field names and types of the parse log must equal the reference's
# (``query_id`` and ``text_key`` are ours).
LOG_SCHEMA = T.StructType([
    T.StructField("query_id", T.LongType(), True),
    T.StructField("text_key", T.LongType(), True),
    T.StructField("section", T.StringType(), True),
    T.StructField("section_id", T.IntegerType(), True),
    T.StructField("type", T.StringType(), True),
    T.StructField("identifier", T.StringType(), True),
    T.StructField("original_query", T.StringType(), True),
    T.StructField("final_query", T.StringType(), True),
    T.StructField("content", T.StringType(), True),
    T.StructField("columns", T.ArrayType(T.StringType()), True),
    T.StructField("tables", T.ArrayType(T.StringType()), True),
    T.StructField("functions", T.ArrayType(T.StringType()), True),
    T.StructField("converted_content", T.StringType(), True),
    T.StructField("converted_columns", T.ArrayType(T.StringType()), True),
    T.StructField("response_error", T.StringType(), True),
])
LOG_COLUMNS = [f.name for f in LOG_SCHEMA.fields]


#: Characters of text that are scanned, and of pieces that are handed on, at a time.
SLICE = 1 << 20


def text_key(sql: str = "sql") -> Column:
    return F.xxhash64(sql)


def row_local(df: DataFrame, text: str, kept: list[str], found: T.StructType, scan: Callable[..., list[tuple]], *args: str) -> DataFrame:
    """Rows ``kept`` and ``found`` for each tuple that ``scan(text, *args)`` gives for a
    row (a null text: empty). Rows come and go in slices of about ``SLICE`` characters,
    whatever the size of Spark's batches."""
    ship_code(df.sparkSession)
    names, out = df.columns, T.StructType([df.schema[c] for c in kept] + list(found.fields))
    at, rest, more = names.index(text), [names.index(c) for c in kept], [names.index(c) for c in args]
    types = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in found.fields])
    texts = [k for k, f in enumerate(found.fields) if f.dataType == T.StringType()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given = [b.column(i).to_pylist() for i in more]
            rows, of, size = [], [], 0

            def taken() -> pa.RecordBatch:
                cols = [b.column(i).take(pa.array(of, pa.int64())) for i in rest]  # noqa: B023
                cols += [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(types)]  # noqa: B023
                return pa.RecordBatch.from_arrays(cols, names=out.fieldNames())

            for i, t in enumerate(b.column(at)):
                t = t.as_py() or ""
                for row in scan(t, *[g[i] for g in given]):
                    rows.append(row)
                    of.append(i)
                    for k in texts:
                        size += len(row[k] or "")
                    if size > SLICE:
                        yield taken()
                        rows, of, size = [], [], 0
            if rows:
                yield taken()

    return df.mapInArrow(run, out)


def _arrow(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.ArrayType):
        return pa.list_(_arrow(t.elementType))
    return {T.StringType: pa.string(), T.IntegerType: pa.int32(), T.LongType: pa.int64(), T.BooleanType: pa.bool_()}[type(t)]


def _texts(corpus: DataFrame) -> DataFrame:
    return corpus.select("query_id", text_key().alias("text_key"), strip_comments("sql").alias("code"))


# ---------------------------------------------------------------------------
# sections
# ---------------------------------------------------------------------------
def _fields(*of: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in of])


_INT, _LONG, _TEXT, _BOOL = T.IntegerType(), T.LongType(), T.StringType(), T.BooleanType()
_KEYS = ["query_id", "text_key"]


def split_sections(corpus: DataFrame) -> DataFrame:
    """Sections of every query.

    Out: ``query_id, section_id INT, section STRING (cte|select|join|unknown),
    content STRING`` -- comments stripped, numbered from 1 in text order.
    A leading WITH block is the ``cte`` section; every depth-0 SELECT starts a
    ``select`` section; every depth-0 set operator (UNION [ALL], INTERSECT
    [ALL], EXCEPT [ALL], MINUS) is its own ``join`` section. Blank pieces are
    dropped before numbering. A piece that starts with ``(`` stays: it is a
    ``select`` section when the text inside starts with SELECT.
    """
    def sections(text: str) -> list[tuple]:
        return [(p.section_id, p.section, p.original) for p in B.scan(text) if p.n == 0]

    return row_local(_texts(corpus), "code", ["query_id"], _fields(("section_id", _INT), ("section", _TEXT), ("content", _TEXT)), sections)


def cte_block(corpus: DataFrame) -> DataFrame:
    """``query_id, cte_block, remainder`` (cte_block NULL without WITH)."""
    def block(text: str) -> list[tuple]:
        found = [(p.section, p.original) for p in B.scan(text) if p.n == 0]
        ctes = [t for kind, t in found if kind == "cte"]
        return [(ctes[0] if ctes else None, "\n".join(t for kind, t in found if kind != "cte"))] if found else []

    return row_local(_texts(corpus), "code", ["query_id"], _fields(("cte_block", _TEXT), ("remainder", _TEXT)), block)


# ---------------------------------------------------------------------------
# subqueries
# ---------------------------------------------------------------------------
def _identifier(section, section_id, n):
    return F.concat(F.lit("subquery_"), section, F.lit("["), section_id.cast("string"),
                    F.lit("]_"), n.cast("string"))


def subquery_pieces(sections: DataFrame) -> DataFrame:
    """Per section of a section table: one row per subquery (n >= 1) and the main piece (n = 0).

    Out: ``query_id, section_id, section, n, content, unbalanced``. Nested
    subqueries are replaced by ``(<<subquery_{section}[{section_id}]_{n}>>)``,
    numbers are post-order per section (inner before outer, left to right).
    An unbalanced section is returned whole as its main piece.
    """
    def pieces(text: str, section: str, section_id: int) -> list[tuple]:
        found = B.scan(text, sections=False, name=lambda kind, number, n: B.placeholder(section, section_id, n))
        return [(p.n, p.content, p.unbalanced) for p in found]

    src = sections.filter(F.col("section").isin("cte", "select"))
    return row_local(src, "content", ["query_id", "section_id", "section"],
                     _fields(("n", _LONG), ("content", _TEXT), ("unbalanced", _BOOL)), pieces, "section", "section_id")


def extract_subqueries(corpus: DataFrame) -> DataFrame:
    """One row per subquery: ``query_id, section, section_id, n, identifier, content``."""
    pieces = decompose_pieces(corpus)
    return (pieces.filter(F.col("n") > 0)
                  .select("query_id", "section", "section_id", "n",
                          _identifier(F.col("section"), F.col("section_id"), F.col("n")).alias("identifier"),
                          "content"))


def subqueries_full(corpus: DataFrame) -> DataFrame:
    """Every subquery with its nested subqueries left in place.

    Out: ``query_id, section_id, n, id, full_sub_query`` -- the text between
    the subquery's parentheses exactly as written (comments stripped).
    """
    found = _fields(("section_id", _INT), ("section", _TEXT), ("n", _LONG), ("full_sub_query", _TEXT))

    def full(text: str) -> list[tuple]:
        return [(p.section_id, p.section, p.n, p.full) for p in B.scan(text) if p.n]

    rows = row_local(_texts(corpus), "code", ["query_id"], found, full)
    return rows.select("query_id", "section_id", "n", _identifier(F.col("section"), F.col("section_id"), F.col("n")).alias("id"), "full_sub_query")


# ---------------------------------------------------------------------------
# The parse log and its views
# ---------------------------------------------------------------------------
def _empty_arr():
    return F.array().cast("array<string>")


def _log_row(qid, key, section, section_id, type_, identifier, original, content, error=None):
    return [qid.alias("query_id"), key.alias("text_key"), section.alias("section"), section_id.cast("int").alias("section_id"),
            type_.alias("type"), identifier.alias("identifier"),
            original.cast("string").alias("original_query"), F.lit("").alias("final_query"),
            content.alias("content"), _empty_arr().alias("columns"), _empty_arr().alias("tables"),
            _empty_arr().alias("functions"), F.lit("").alias("converted_content"),
            _empty_arr().alias("converted_columns"),
            (error if error is not None else F.lit("")).alias("response_error")]


EMPTY_TEXT = "empty text"
#: Section of a text without code, which has one empty piece and no section.
NOTHING = "nothing"

_PIECES = _fields(("section_id", _INT), ("section", _TEXT), ("n", _LONG), ("content", _TEXT), ("original", _TEXT), ("unbalanced", _BOOL))
_LISTS = _fields(("columns", T.ArrayType(_TEXT)), ("star_content", _TEXT))


def decompose_pieces(corpus: DataFrame, select_lists: bool = False) -> DataFrame:
    """Sections and subqueries, and with ``select_lists`` their columns, from one scan.

    Out: one row per piece ``query_id, text_key, section_id, section, n, content,
    original, unbalanced[, columns, star_content]`` (n = 0 is the section's main
    piece, whose ``original`` is the section text). A text with nothing but blanks
    and comments has one empty piece of the section ``NOTHING``.
    """
    def pieces(text: str) -> list[tuple]:
        found = B.scan(text)
        if not found:
            return [(1, NOTHING, 0, "", "", False) + (([], "") if select_lists else ())]
        return [(p.section_id, p.section, p.n, p.content, p.original, p.unbalanced) + ((p.columns, p.star) if select_lists else ()) for p in found]

    return row_local(_texts(corpus), "code", _KEYS, T.StructType(_PIECES.fields + (_LISTS.fields if select_lists else [])), pieces)


def decompose_log(corpus: DataFrame, select_lists: bool = False) -> DataFrame:
    """The parse log of every query (``LOG_SCHEMA``).

    Per cte/select section: one ``subquery`` row per subquery and one
    ``section_main`` row (content with placeholders, original_query = the
    section text). Per set-operator / unknown section: a row with empty type
    and identifier, and a ``section_main`` row. A NULL, blank or comment-only
    text has one empty ``section_main`` row with an error. With ``select_lists``
    the log comes as ``columns.log_with_columns`` makes it, from the same scan.
    """
    p = decompose_pieces(corpus, select_lists)
    n = F.col("n")
    nothing = F.col("section") == NOTHING
    splittable = F.col("section").isin("cte", "select")
    # kind per output row: 2 = subquery, 1 = section_main, 0 = set-operator / unknown row
    kinds = (F.when(n > 0, F.array(F.lit(2)))
              .when(splittable | nothing, F.array(F.lit(1)))
              .otherwise(F.array(F.lit(0), F.lit(1))))
    m = p.select("*", F.explode(kinds).alias("_k"))
    k = F.col("_k")
    sid = F.col("section_id")
    sec = F.when(nothing, F.lit("unknown")).otherwise(F.col("section"))
    typ = F.when(k == 2, F.lit("subquery")).when(k == 1, F.lit("section_main")).otherwise(F.lit(""))
    ident = (F.when(k == 2, _identifier(sec, sid, n))
              .when(k == 1, F.concat(F.lit("section_"), sid.cast("string"), F.lit("_main")))
              .otherwise(F.lit("")))
    err = (F.when(nothing, F.lit(EMPTY_TEXT))
            .when((k == 1) & F.col("unbalanced") & splittable, F.lit(UNBALANCED)).otherwise(F.lit("")))
    row = _log_row(F.col("query_id"), F.col("text_key"), sec, sid, typ, ident, F.when(k == 1, F.col("original")),
                   F.col("star_content" if select_lists else "content"), err)
    if select_lists:
        row[LOG_COLUMNS.index("columns")] = F.col("columns")
    return m.select(*row)


def main_only_log(corpus: DataFrame) -> DataFrame:
    """One undecomposed ``section_main`` row per query, ``section_id = 0``."""
    return corpus.select(*_log_row(
        F.col("query_id"), text_key(), F.lit("select"), F.lit(0), F.lit("section_main"),
        F.lit("section_0_main"), F.col("sql"), F.col("sql")))


NO_NAME = "CTE without a name"
NO_HEAD = "query must start with WITH or SELECT"


def cte_list(corpus: DataFrame) -> DataFrame:
    """CTEs in order: ``query_id, cte_pos, name, body, error``.

    Every depth-0 parenthesis span of the WITH block is numbered. A span is a
    body when the text since the span before ends in ``AS [[NOT]
    MATERIALIZED]``; its name (quotes kept) stands before that ``AS``, or, after a
    column list, before the list. Column lists give no row. Any other span
    gives a row without a name and with an ``error``.
    """
    def ctes(text: str) -> list[tuple]:
        block = [p.original for p in B.scan(text) if p.n == 0 and p.section == "cte"]
        return [(i, name, body, None if name else NO_NAME) for t in block for i, (name, body) in enumerate(B.with_list(t), 1)]

    return row_local(_texts(corpus), "code", ["query_id"], _fields(("cte_pos", _INT), ("name", _TEXT), ("body", _TEXT), ("error", _TEXT)), ctes)


def named_view(corpus: DataFrame) -> DataFrame:
    """Legacy flat view ``query_id, text_key, name, type, query, error``.

    Rows: every named CTE (type ``cte``, body as written), every subquery of
    the non-CTE sections (type ``subquery``, named by its log identifier --
    the legacy numbering restarts inside recursion and collides), and
    ``main``: ``WITH name AS (<<name>>), ...`` followed by the section main
    texts (with ``<<subquery_...>>`` placeholders) joined by newlines. Texts
    that do not start with WITH or SELECT give one ``main`` row with an
    ``error`` instead of raising.
    """
    def view(text: str, is_null: bool) -> list[tuple]:
        whole = text.strip(B.BLANK)
        if not B.starts_query(whole):
            return [("main", "main", None if is_null else whole, NO_HEAD)]
        found = B.scan(text)
        ctes = [x for p in found if p.n == 0 and p.section == "cte" for x in B.with_list(p.original)]
        rows = [(name or f"cte_{i}", "cte", body, None if name else NO_NAME) for i, (name, body) in enumerate(ctes, 1)]
        rest = [p for p in found if p.section != "cte"]
        rows += [(B.placeholder(p.section, p.section_id, p.n)[3:-3], "subquery", p.content, None) for p in rest if p.n]
        head = ", ".join(f"{name} AS (<<{name}>>)" for name, _ in ctes if name)
        main = "\n".join(p.content for p in rest if p.n == 0)
        return [*rows, ("main", "main", (f"WITH {head}\n" if head else "") + main, None)]

    texts = _texts(corpus).withColumn("is_null", F.col("code").isNull())
    return row_local(texts, "code", _KEYS, _fields(("name", _TEXT), ("type", _TEXT), ("query", _TEXT), ("error", _TEXT)), view, "is_null")


def setop_branches(corpus: DataFrame) -> DataFrame:
    """The set-operation branches of queries that have two or more.

    Out: ``query_id, branch (1..k), placeholder, content`` for every depth-0
    SELECT section of a query with >= 2 of them (``<<branch_{k}>>``).
    """
    def branches(text: str) -> list[tuple]:
        found = [p.original for p in B.scan(text) if p.n == 0 and p.section == "select"]
        return [(i, f"<<branch_{i}>>", t) for i, t in enumerate(found, 1)] if len(found) > 1 else []

    return row_local(_texts(corpus), "code", ["query_id"], _fields(("branch", _INT), ("placeholder", _TEXT), ("content", _TEXT)), branches)
