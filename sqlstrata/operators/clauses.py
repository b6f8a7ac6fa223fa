"""Rewrites by place in one flat piece (E1): no grammar, a map of its clauses.

``clause_map`` lists where FROM, WHERE, GROUP, ORDER ... and the AND, OR and
commas between them stand outside of parentheses and literals. With it, two
forms are rewritten by cutting and joining the text:

* ``FROM a x, b y WHERE x.i = y.i AND rest`` -> ``FROM a x JOIN b y ON x.i = y.i WHERE rest``
* ``FROM a x WHERE rest AND ROWNUM = 1`` -> a derived table of the same name, numbered by
  ROW_NUMBER(), of which row 1 is taken; the select list and what follows stay.

Anything else (three tables, OR or BETWEEN, a condition on a table of an outer
query, more than one ROWNUM) stays as it is, for the audit to report. All is one
native expression per row, evaluated only where a piece shows one of the forms.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sqlstrata.functions import patterns as P

WORDS = ["SELECT", "FROM", "WHERE", "GROUP", "HAVING", "ORDER", "CONNECT", "START", "JOIN", "AND", "OR", "BETWEEN", "ROWNUM",
         "UNION", "INTERSECT", "EXCEPT", "MINUS", "FETCH", "LIMIT", "FOR", "WINDOW"]
_ENDS = ["GROUP", "HAVING", "ORDER", "FETCH", "LIMIT", "FOR", "WINDOW"]
_REPORTED = ["OR", "BETWEEN", "CONNECT", "START", "JOIN", "UNION", "INTERSECT", "EXCEPT", "MINUS"]
# A run of what the map does not list (literals whole; capped, so that no match recurses deeply), a word of WORDS, or a mark.
_RUN = rf"(?:{P.LIT}|[^{P.WORDCH}()'\",]++|(?!(?i:{'|'.join(WORDS)})(?![{P.WORDCH}]))[{P.WORDCH}]++){{1,256}}+"
_TOKEN = rf"{_RUN}|[{P.WORDCH}]++|[(),'\"]"
_NAME = r"[A-Za-z_][A-Za-z0-9_$#]*"
_TABLE = rf"^\s*({_NAME}(?:\.{_NAME})*)(?:\s+(?:[Aa][Ss]\s+)?({_NAME}))?\s*$"
_EQUAL = rf"^\s*({_NAME})\.{_NAME}\s*=\s*({_NAME})\.{_NAME}\s*$"
_FIRST = r"(?i)^\s*ROWNUM\s*(?:(?:=|<=)\s*1|<\s*2)\s*$"
# Two tables right between FROM and WHERE, and the condition that stands for the first row: no text without them is rewritten.
_PLAIN_TABLE = rf"{_NAME}(?:\.{_NAME})*+(?:\s+(?:AS\s+)?{_NAME})?"
_COMMA_FORM = rf"(?i)\bFROM\s+{_PLAIN_TABLE}\s*,\s*{_PLAIN_TABLE}\s+WHERE\b"
_FIRST_FORM = r"(?i)\bROWNUM\s*(?:(?:=|<=)\s*1|<\s*2)"
_ROWNUM_FORM = r"(?i)\bROWNUM\b"


def clause_map(c: Column) -> Column:
    """``array<struct<word, start, end>>``: the words of ``WORDS`` and commas that stand
    outside of parentheses and literals, with their places (from 1, end exclusive)."""
    words = F.array(*[F.lit(w) for w in [*WORDS, ","]])
    none = F.array().cast("array<struct<word:string,start:int,end:int>>")

    def step(acc: Column, t: Column) -> Column:
        end = acc["at"] + F.length(t)
        found = (acc["depth"] == 0) & (F.length(t) <= max(map(len, WORDS))) & F.array_contains(words, F.upper(t))
        return F.struct(
            (acc["depth"] + F.when(t == "(", 1).when(t == ")", -1).otherwise(0)).cast("int").alias("depth"), end.cast("int").alias("at"),
            F.when(found, F.concat(acc["map"], F.array(F.struct(F.upper(t).alias("word"), acc["at"].alias("start"), end.cast("int").alias("end")))))
             .otherwise(acc["map"]).alias("map"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(1).alias("at"), none.alias("map"))
    return F.aggregate(F.regexp_extract_all(c, F.lit(_TOKEN), 0), start, step, lambda acc: acc["map"])


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.transform(F.array(value), body)[0]


def _cut(c: Column, start: Column, end: Column) -> Column:
    return F.substring(c, start, end - start)


def _of(m: Column, *words: str) -> Column:
    return F.filter(m, lambda x: x["word"].isin(*words))


def _parts(c: Column, m: Column) -> Column:
    """A struct, or null unless ``ok`` (one FROM, one WHERE behind it, none of the reported words), the
    text up to FROM, the tables between commas, the conditions between ANDs, and the tail."""
    size = F.length(c) + 1

    def parts(k: Column) -> Column:
        frm, where, end = k["frm"], k["where"], k["end"]

        def between(word: str, lo: Column, hi: Column) -> Column:
            inner = F.filter(m, lambda x: (x["word"] == word) & (x["start"] >= lo) & (x["start"] < hi))
            begins = F.concat(F.array(lo), F.transform(inner, lambda x: x["end"]))
            ends = F.concat(F.transform(inner, lambda x: x["start"]), F.array(hi))
            return F.transform(F.arrays_zip(begins.alias("b"), ends.alias("e")), lambda x: F.trim(F.regexp_replace(_cut(c, x["b"], x["e"]), r"^\s+|\s+$", "")))

        ok = ((F.size(_of(m, "FROM")) == 1) & (F.size(_of(m, "WHERE")) == 1) & (F.size(_of(m, *_REPORTED)) == 0)
              & (F.size(_of(m, "SELECT")) == 1) & (where["start"] > frm["start"]) & (end > where["start"]))
        return F.when(F.coalesce(ok, F.lit(False)), F.struct(F.lit(True).alias("ok"), _cut(c, F.lit(1), frm["end"]).alias("head"),
                        between(",", frm["end"], where["start"]).alias("tables"), between("AND", where["end"], end).alias("conds"),
                        F.when(end < size, F.concat(F.lit(" "), _cut(c, end, size))).otherwise(F.lit("")).alias("tail")))

    # the places are found once per row, not once per condition that asks for them
    heads = F.struct(F.get(_of(m, "FROM"), F.lit(0)).alias("frm"), F.get(_of(m, "WHERE"), F.lit(0)).alias("where"))

    def places(k: Column) -> Column:
        after = F.filter(m, lambda x: x["word"].isin(*_ENDS) & (x["start"] > k["where"]["start"]))
        return F.struct(k["frm"].alias("frm"), k["where"].alias("where"), F.coalesce(F.get(after, F.lit(0))["start"], size).alias("end"))

    return let(let(heads, places), parts)


def _alias(table: Column) -> Column:
    """The name by which conditions know a table."""
    own = F.regexp_extract(table, _TABLE, 2)
    return F.upper(F.when(own != "", own).otherwise(F.regexp_extract(F.regexp_extract(table, _TABLE, 1), rf"({_NAME})$", 1)))


def _where(conds: Column) -> Column:
    return F.when(F.size(conds) > 0, F.concat(F.lit(" WHERE "), F.array_join(conds, " AND "))).otherwise(F.lit(""))


def comma_join_by_place(c: Column) -> Column:
    """The two-table comma join as JOIN ... ON, or the text as it is."""
    def joined(p: Column) -> Column:
        a, b = F.get(p["tables"], F.lit(0)), F.get(p["tables"], F.lit(1))

        def named(n: Column) -> Column:
            def links(k: Column) -> Column:
                return ((k["q"] == n["a"]) & (k["r"] == n["b"])) | ((k["q"] == n["b"]) & (k["r"] == n["a"]))

            # the two names of a condition are found once
            sides = F.transform(p["conds"], lambda x: F.struct(x.alias("x"), F.when(x.contains("="), F.struct(
                F.upper(F.regexp_extract(x, _EQUAL, 1)).alias("q"), F.upper(F.regexp_extract(x, _EQUAL, 2)).alias("r"))).alias("k")))
            marked = F.transform(sides, lambda s: F.struct(s["x"].alias("x"), F.coalesce(links(s["k"]), F.lit(False)).alias("on")))

            def joins(marks: Column) -> Column:
                on = F.transform(F.filter(marks, lambda s: s["on"]), lambda s: s["x"])
                rest = F.transform(F.filter(marks, lambda s: ~s["on"]), lambda s: s["x"])
                return F.when(F.exists(marks, lambda s: s["on"]), F.concat(
                    p["head"], F.lit(" "), a, F.lit(" JOIN "), b, F.lit(" ON "), F.array_join(on, " AND "), _where(rest), p["tail"]))

            return F.when(n["a"] != n["b"], let(marked, joins))

        fits = p["ok"] & (F.size(p["tables"]) == 2) & a.rlike(_TABLE) & b.rlike(_TABLE)
        return F.when(fits, let(F.struct(_alias(a).alias("a"), _alias(b).alias("b")), named))

    return F.coalesce(F.when(c.rlike(_COMMA_FORM), let(let(clause_map(c), lambda m: _parts(c, m)), joined)), c)


def rownum_by_place(c: Column) -> Column:
    """``ROWNUM = 1`` over one table as row 1 of a numbered derived table, or the text
    as it is."""
    def numbered(p: Column) -> Column:
        t = F.get(p["tables"], F.lit(0))

        # name, conditions and their code are found once per row, not once per mention
        def named(k: Column) -> Column:
            alias = k["alias"]
            name = F.when(alias != "", alias).otherwise(F.regexp_extract(k["table"], rf"({_NAME})$", 1))
            return F.struct(name.alias("name"), k["rest"].alias("rest"), F.regexp_replace(F.array_join(k["rest"], " AND "), P.LIT, "''").alias("code"))

        def row_one(k: Column) -> Column:
            name, rest, code = k["name"], k["rest"], k["code"]
            own = F.forall(F.regexp_extract_all(code, F.lit(rf"({_NAME})\s*\."), 1), lambda q: F.upper(q) == F.upper(name))
            fits = ((F.size(rest) == F.size(p["conds"]) - 1) & own & ~F.concat(p["head"], code, p["tail"]).rlike(_ROWNUM_FORM))
            return F.when(fits, F.concat(p["head"], F.lit(" (SELECT "), name, F.lit(".*, ROW_NUMBER() OVER (ORDER BY 1) AS rn FROM "), t, _where(rest),
                                         F.lit(") "), name, F.lit(" WHERE "), name, F.lit(".rn = 1"), p["tail"]))

        found = F.struct(F.regexp_extract(t, _TABLE, 1).alias("table"), F.regexp_extract(t, _TABLE, 2).alias("alias"),
                         F.filter(p["conds"], lambda x: ~x.rlike(_FIRST)).alias("rest"))
        return F.when(p["ok"] & (F.size(p["tables"]) == 1) & t.rlike(_TABLE), let(let(found, named), row_one))

    return F.coalesce(F.when(c.rlike(_FIRST_FORM), let(let(clause_map(c), lambda m: _parts(c, m)), numbered)), c)


def by_place(c: Column) -> Column:
    """Both rewrites; a text that shows neither form costs two searches, or none where it
    holds no comma and no ROWNUM."""
    def either(v: Column) -> Column:
        return F.when((v.contains(",") & v.rlike(_COMMA_FORM)) | (F.upper(v).contains("ROWNUM") & v.rlike(_FIRST_FORM)), let(comma_join_by_place(v), rownum_by_place)).otherwise(v)

    return let(c, either)
