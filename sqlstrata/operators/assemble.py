"""Reassembly.

A piece table: the text of each piece is cut at its placeholders into fragments,
and the pieces of a section are resolved in ascending number. Numbers are
post-order, so the children of a piece are resolved before it, and it is joined
from its own fragments and theirs: each fragment is copied once per level of
nesting, no text is searched for a placeholder of another, and there is no
fixpoint loop. Texts under one ``query_id`` are kept apart by ``text_key``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlstrata.functions.text import strip_ws
from sqlstrata.operators.lineage import functions_expr, tables_expr

_STAR = r"(?i)(select\s+)\*"


def star_expand(content: Column, columns: Column, converted: Column) -> Column:
    """replace the first ``SELECT *`` by the converted column list when
    both column arrays are non-empty."""
    p = F.regexp_instr(content, F.lit(_STAR))
    head = F.regexp_extract(content, _STAR, 1)
    joined = F.array_join(converted, ", ")
    expanded = F.concat(F.substring(content, F.lit(1), p - 1), head, joined,
                        F.substring(content, p + F.length(head) + 1, F.length(content)))
    both = (F.size(F.coalesce(columns, F.array())) > 0) & (F.size(F.coalesce(converted, F.array())) > 0)
    # most pieces begin with it, and need no search
    first = F.concat(F.lit("SELECT "), joined, F.substring(content, F.lit(len("SELECT *") + 1), F.length(content)))
    return F.when(both & content.startswith("SELECT *"), first).when(both & content.contains("*") & (p > 0), expanded).otherwise(content)


def piece_text(log: DataFrame) -> DataFrame:
    """Per log row: converted text if any, else content, with F1 applied."""
    base = F.when(F.coalesce(F.col("converted_content"), F.lit("")) != "", F.col("converted_content")) \
            .otherwise(F.coalesce(F.col("content"), F.lit("")))
    return log.withColumn("_text", star_expand(base, F.col("columns"), F.col("converted_columns")))


#: A placeholder, or a run of text without one.
_FRAGMENT = r"<<subquery_[a-z]+\[\d+\]_\d+>>|[^<]++|<"
_NUMBER = r"^<<subquery_[a-z]+\[(\d+)\]_(\d+)>>$"


def _keys(log: DataFrame) -> list[str]:
    return ["query_id", "text_key"] if "text_key" in log.columns else ["query_id"]


def _resolved(text: Column, section_id: Column, done: Column) -> Column:
    """``text`` with the placeholders of its section replaced by entries of ``done``,
    which holds the resolved subqueries by number."""
    def one(f: Column) -> Column:
        n = F.regexp_extract(f, _NUMBER, 2).try_cast("int")
        own = F.regexp_extract(f, _NUMBER, 1) == section_id.cast("string")
        found = F.when(own & n.between(1, F.size(done)), F.get(done, n - 1))
        return F.when(f.startswith("<<subquery_"), F.coalesce(found, f)).otherwise(f)

    return F.when(text.contains("<<"), F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_FRAGMENT), 0), one), "")).otherwise(text)


def _with(done: Column, n: Column, text: Column) -> Column:
    """``done`` with ``text`` as its entry ``n``; numbers come in ascending order, a gap
    is null, and of several texts the last counts."""
    gap = F.array_repeat(F.lit(None).cast("string"), n - 1 - F.size(done))
    return F.when(n <= F.size(done), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(text))).otherwise(F.concat(done, gap, F.array(text)))


_EMPTY = "array<string>"


def _rows(log: DataFrame) -> DataFrame:
    return (log.filter(F.col("type").isin("subquery", "section_main"))
               .withColumn("_main", (F.col("type") == "section_main").cast("int"))
               .withColumn("_n", F.coalesce(F.regexp_extract(F.col("identifier"), r"_(\d+)$", 1).try_cast("int"), F.lit(0))))


def resolve_sections(log: DataFrame, text_col: str = "_text") -> DataFrame:
    """``query_id[, text_key], section_id, section, resolved`` for every section_main row.

    One aggregate per section gathers its pieces; rows of a text that the log holds
    twice count once. A number without a row leaves its placeholder as it is.
    """
    main = F.col("_main") == 1
    g = _rows(log).groupBy(*_keys(log), "section_id").agg(
        F.max(F.when(main, F.coalesce(F.col(text_col), F.lit("")))).alias("main"), F.max(F.when(main, F.col("section"))).alias("section"),
        F.collect_set(F.when(~main & (F.col("_n") > 0), F.struct(F.col("_n").alias("n"), F.col(text_col).alias("t")))).alias("subs"))
    sid = F.col("section_id")
    done = F.aggregate(F.array_sort("subs"), F.array().cast(_EMPTY), lambda acc, x: _with(acc, x["n"], _resolved(x["t"], sid, acc)))
    g = g.filter(F.col("main").isNotNull()).withColumn("done", done)
    return g.select(*_keys(log), "section_id", "section", _resolved(F.col("main"), sid, F.col("done")).alias("resolved"))


def assemble_query(log: DataFrame) -> DataFrame:
    """``query_id[, text_key], final_query``: resolved sections in order, blank line between.

    One aggregate gathers the pieces of a text; sorted by section, subqueries in
    ascending number before the main text, they are resolved in one pass."""
    g = _rows(piece_text(log)).groupBy(*_keys(log)).agg(F.collect_set(F.struct(
        F.col("section_id").alias("s"), F.col("_main").alias("main"), F.col("_n").alias("n"), F.coalesce("_text", F.lit("")).alias("t"))).alias("ps"))
    none = F.array().cast(_EMPTY)

    def step(acc: Column, x: Column) -> Column:
        text = _resolved(x["t"], x["s"], acc["done"])
        return F.when(x["main"] == 1, F.struct(none.alias("done"), F.concat(acc["out"], F.array(strip_ws(text))).alias("out"))).otherwise(
            F.struct(F.when(x["n"] > 0, _with(acc["done"], x["n"], text)).otherwise(acc["done"]).alias("done"), acc["out"].alias("out")))

    out = F.aggregate(F.array_sort("ps"), F.struct(none.alias("done"), none.alias("out")), step, lambda acc: F.array_join(acc["out"], "\n\n"))
    return g.filter(F.exists("ps", lambda x: x["main"] == 1)).select(*_keys(log), out.alias("final_query"))


def final_rows(log: DataFrame) -> DataFrame:
    """The ``final`` rows of a log: text, tables and functions, one row per text."""
    types = {f.name: f.dataType for f in log.schema.fields}
    empty = F.array().cast("array<string>")
    fq = F.col("final_query")
    values = {
        **{k: F.col(k) for k in _keys(log)}, "section": F.lit("final_query"), "section_id": F.lit(0),
        "type": F.lit("final"), "identifier": F.lit("final_query"), "final_query": fq,
        "columns": empty, "tables": tables_expr(fq), "functions": functions_expr(fq),
        "converted_columns": empty,
    }
    return assemble_query(log.filter(F.col("type") != "final")).select(
        *[(values[c] if c in values else F.lit(None)).cast(types[c]).alias(c) for c in log.columns])


def final_row(log: DataFrame) -> DataFrame:
    """the log plus one ``final`` row per text (text, tables, functions).

    Rows of an earlier final are replaced, never duplicated. The log goes on as it is;
    only the pieces' texts are gathered, per section and then per text."""
    return log.filter(F.col("type") != "final").unionByName(final_rows(log))


def main_text(view: DataFrame) -> DataFrame:
    """legacy: the ``main`` row of a named view with every placeholder
    resolved: ``query_id, main``. CTE placeholders ``<<name>>`` take the CTE
    bodies; subquery placeholders are resolved in descending number per
    section (parents before the children they contain)."""
    rows = view.filter(F.col("error").isNull())
    sec = F.regexp_extract("name", r"\[(\d+)\]", 1).try_cast("long")
    num = F.regexp_extract("name", r"_(\d+)$", 1).try_cast("long")
    key = F.struct((F.col("type") == "cte").alias("cte"), F.coalesce(sec, F.lit(0)).alias("sec"), F.coalesce(num, F.lit(0)).alias("num"))
    g = (rows.groupBy(*_keys(view))
             .agg(F.max(F.when(F.col("type") == "main", F.col("query"))).alias("main"),
                  F.sort_array(F.collect_list(F.when(F.col("type") != "main", F.struct(
                      key.alias("k"), F.col("name"), F.col("query")))), asc=False).alias("subs")))
    res = F.aggregate("subs", F.coalesce(F.col("main"), F.lit("")),
                      lambda acc, x: F.replace(acc, F.concat(F.lit("<<"), x["name"], F.lit(">>")), x["query"]))
    return g.select("query_id", res.alias("main"))
