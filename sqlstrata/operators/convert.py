"""Dialect conversion as a batch job.

Rules are data: ``(scope, pattern, replacement)``. A text is split row-locally
into literal and code pieces; code rules apply to code pieces, literal rules
to whole literals, and the pieces are joined again -- one expression, no
UDF, no shuffle. Errors are columns, never exceptions.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqlstrata.functions import patterns as P
from sqlstrata.functions.text import strip_ws
from sqlstrata.operators.clauses import by_place, let

# The reference's conversion rules (Oracle -> Spark SQL).
DEFAULT_RULES = [
    ("code", r"(?i)\bNVL\s*\(", "COALESCE("),
    ("code", r"(?i)\bVARCHAR2\b(\s*\(\s*\d+\s*(?:BYTE|CHAR)?\s*\))?", "STRING"),
    ("code", r"(?i)\bVARCHAR\b(?!\s*\()", "STRING"),
    ("code", r"(?i)\bNUMBER\s*\(\s*(\d+)\s*(,\s*\d+\s*)?\)", "DECIMAL($1$2)"),
    ("code", r"(?i)\bSYSDATE\b", "CURRENT_TIMESTAMP()"),
    ("literal", r"^'YYYYMMDD'$", "'yyyyMMdd'"),
]

# Constructs still needing work after rule conversion (E4/E5 audit).
AUDIT = [
    ("rownum", r"(?i)\bROWNUM\b"),
    ("connect_by", r"(?i)\bCONNECT\s+BY\b"),
    ("outer_join_plus", r"\(\+\)"),
    ("nvl", r"(?i)\bNVL\s*\("),
    ("varchar2", r"(?i)\bVARCHAR2\b"),
    ("sysdate", r"(?i)\bSYSDATE\b"),
    ("oracle_date_format", r"'YYYYMMDD'"),
    ("decode", r"(?i)\bDECODE\s*\("),
    ("comma_join", r"(?i)\bFROM\s+[A-Za-z_][A-Za-z0-9_.]*(\s+[A-Za-z_][A-Za-z0-9_]*)?\s*,\s*[A-Za-z_]"),
]
# A converted piece fails when one of these remains.
BLOCKING = ["rownum", "connect_by", "outer_join_plus"]
# Without this word (in upper case) a text cannot match the audit pattern of that name.
AUDIT_WORD = {"rownum": "ROWNUM", "connect_by": "CONNECT", "outer_join_plus": "(+)"}

# A text that holds none of these words (in lower case) matches no default rule.
RULE_WORDS = ["nvl", "varchar", "number", "sysdate", "'yyyymmdd'"]

PIECE = "(?:'[^']*+')++|\"[^\"]*+\"|[^'\"]++|['\"]"


def apply_rules(c: Column, rules=DEFAULT_RULES) -> Column:
    """Convert one text column with ``rules``; literals are untouched by
    code rules. A text without literals is one piece, and one that holds no word
    of the default rules is not searched for them."""
    if not rules:
        return c

    def code(p):
        for scope, pat, rep in rules:
            if scope == "code":
                p = F.regexp_replace(p, pat, rep)
        return p

    def lit(p):
        for scope, pat, rep in rules:
            if scope == "literal":
                p = F.regexp_replace(p, pat, rep)
        return p

    pieces = F.when(c.contains("'") | c.contains('"'), F.regexp_extract_all(c, F.lit(PIECE), 0)).otherwise(F.array(c))
    conv = F.transform(pieces, lambda p: F.when(p.startswith("'") | p.startswith('"'), lit(p))
                       .otherwise(code(p)))
    same = c.isNull() | (c == "")
    if all(r in DEFAULT_RULES for r in rules):
        lower = F.lower(c)
        same = same | ~reduce(or_, (lower.contains(w) for w in RULE_WORDS))
    return F.when(same, c).otherwise(F.array_join(conv, ""))


def convert_piece(c: Column, rules=DEFAULT_RULES) -> Column:
    """E1 for the text of a piece: the rules, then the rewrites by place (``clauses``)."""
    return by_place(apply_rules(c, rules)) if rules else c


def code_only(c: Column) -> Column:
    """The text with every literal emptied: audit words inside literals are data."""
    return F.when(c.contains("'") | c.contains('"'), F.regexp_replace(c, P.LIT, "''")).otherwise(c)


def _found(c: Column, pattern: str) -> Column:
    """Whether an audit pattern occurs: in the code, or, for patterns of whole
    literals, in the text."""
    return (c if pattern.startswith("'") else code_only(c)).rlike(pattern)


def _balance(code: Column) -> Column:
    return F.length(F.replace(code, F.lit(")"), F.lit(""))) - F.length(F.replace(code, F.lit("("), F.lit("")))


def paren_balance(c: Column) -> Column:
    """Open minus close parentheses outside literals."""
    return _balance(code_only(c))


def check_errors(c: Column) -> Column:
    """E4: '' when fine, else the reasons joined by '; '. The code of a text is cut
    out once, and searched for a pattern only where its word occurs; a text without
    parentheses and without such a word is fine."""
    def reasons(code: Column) -> Column:
        out = [F.when(_balance(code) != 0, F.lit("unbalanced parentheses"))]
        out += [F.when(F.upper(code).contains(AUDIT_WORD[name]) & code.rlike(pat), F.lit(f"unsupported: {name}"))
                for name, pat in AUDIT if name in BLOCKING]
        return F.concat_ws("; ", *out)

    upper = F.upper(c)
    fine = ~(c.contains("(") | c.contains(")") | upper.contains(AUDIT_WORD["rownum"]) | upper.contains(AUDIT_WORD["connect_by"]))
    return F.when(fine, F.lit("")).otherwise(let(code_only(c), reasons))


def _join_err(a: Column, b: Column) -> Column:
    """Reasons as a set, in the order they were found: a refresh adds none twice."""
    both = F.concat_ws("; ", F.when(a != "", a), F.when(b != "", b))
    return F.when((a == "") & (b == ""), F.lit("")).otherwise(F.array_join(F.array_distinct(F.split(both, "; ")), "; "))


def convert_log(log: DataFrame, rules=DEFAULT_RULES, full_refresh: bool = True) -> DataFrame:
    """E1/E2/E4 (+E3 when ``full_refresh=False``): fill ``converted_content``.

    Set-operator rows pass through unconverted. A row whose conversion still
    fails the checks keeps an empty ``converted_content`` and gets the reason
    appended to ``response_error``; ``status`` is success / failed / skipped.
    Without full refresh, rows that already hold a non-blank conversion are
    kept as they are.
    """
    is_setop = F.col("section") == "join"
    done = (F.col("converted_content").isNotNull() & (strip_ws(F.col("converted_content")) != ""))
    keep = F.lit(False) if full_refresh else done
    # a generator: no filter on its columns is pushed below it, which would convert a text again for each mention
    once = F.inline(F.transform(F.array(convert_piece(F.col("content"), rules)),
                                lambda v: F.struct(v.alias("_conv"), check_errors(v).alias("_err"))))
    out = (log.select("*", once)
              .withColumn("converted_content",
                          F.when(keep, F.col("converted_content"))
                           .when(is_setop, F.lit(""))
                           .when(F.col("_err") == "", F.col("_conv")).otherwise(F.lit("")))
              .withColumn("response_error",
                          F.when(keep | is_setop, F.col("response_error"))
                           .otherwise(_join_err(F.coalesce(F.col("response_error"), F.lit("")), F.col("_err"))))
              .withColumn("status", F.when(keep, F.lit("skipped")).when(is_setop, F.lit("passthrough"))
                          .when(F.col("_err") == "", F.lit("success")).otherwise(F.lit("failed"))))
    return out.drop("_conv", "_err")


def incremental_pending(corpus: DataFrame, log: DataFrame) -> DataFrame:
    """What a refresh must convert: log rows of known queries whose
    conversion is blank, plus every query of the corpus missing from the log
    (as ``query_id`` rows with ``identifier`` NULL)."""
    pending_rows = log.filter((F.col("section") != "join") & (strip_ws(F.coalesce("content", F.lit(""))) != "")
                              & (F.col("converted_content").isNull()
                                 | (strip_ws(F.col("converted_content")) == "")))
    new_q = corpus.select("query_id").join(log.select("query_id").distinct(), "query_id", "left_anti")
    return (pending_rows.select("query_id", "section_id", "identifier")
            .unionByName(new_q.select("query_id", F.lit(None).cast("int").alias("section_id"),
                                      F.lit(None).cast("string").alias("identifier"))))


def dialect_audit(log: DataFrame, content_col: str = "content") -> DataFrame:
    """E5: ``construct, n_rows, n_queries`` for constructs still present."""
    flags = F.array(*[F.when(_found(F.col(content_col), pat), F.lit(name)) for name, pat in AUDIT])
    ex = log.select("query_id", F.explode(F.filter(flags, lambda x: x.isNotNull())).alias("construct"))
    return ex.groupBy("construct").agg(F.count(F.lit(1)).alias("n_rows"),
                                       F.countDistinct("query_id").alias("n_queries"))


def convert_columns(log: DataFrame, rules=DEFAULT_RULES, full_refresh: bool = True) -> DataFrame:
    """Fill ``converted_columns`` from ``columns``, in order.

    Each column is converted and checked on its own. One that fails keeps its
    original text, and its reason joins ``response_error``, so there are always
    as many converted columns as columns, however they are cut in chunks (C4)
    on their way to a converter. Row-local: no shuffle.
    """
    cols = F.coalesce("columns", F.array().cast("array<string>"))
    done = F.coalesce("converted_columns", F.array().cast("array<string>"))
    todo = (F.col("section") != "join") & (F.size(cols) > 0)
    if not full_refresh:
        todo = todo & (F.size(done) == 0)
    conv = F.transform(cols, lambda c: F.struct(c.alias("old"), apply_rules(c, rules).alias("new")))
    conv = F.transform(conv, lambda x: F.struct(x["old"].alias("old"), x["new"].alias("new"), check_errors(x["new"]).alias("err")))
    out = log.withColumn("_cc", F.when(todo, conv))
    new = F.transform("_cc", lambda x: F.when(x["err"] == "", x["new"]).otherwise(x["old"]))
    err = F.array_join(F.filter(F.transform("_cc", lambda x: x["err"]), lambda e: e != ""), "; ")
    out = (out.withColumn("converted_columns", F.when(F.col("_cc").isNotNull(), new).otherwise(done))
              .withColumn("response_error", F.when(F.coalesce(err, F.lit("")) != "",
                                                   _join_err(F.coalesce(F.col("response_error"), F.lit("")), err))
                          .otherwise(F.col("response_error"))))
    return out.drop("_cc")


def failure_budget(log: DataFrame, budget: int = 5) -> DataFrame:
    """Per query, rows after the ``budget``-th failure are absent.

    Rows are ordered as processed: by section, subqueries before the section
    main row, then by subquery number.
    """
    failed = (F.coalesce(F.col("response_error"), F.lit("")) != "").cast("int")
    kind = F.when(F.col("type") == "subquery", 0).when(F.col("type") == "section_main", 1).otherwise(2)
    num = F.coalesce(F.regexp_extract(F.col("identifier"), r"_(\d+)$", 1).try_cast("int"), F.lit(0))
    w = (Window.partitionBy("query_id").orderBy("section_id", kind, num)
               .rowsBetween(Window.unboundedPreceding, -1))
    before = F.coalesce(F.sum(failed).over(w), F.lit(0))
    return log.withColumn("_before", before).filter(F.col("_before") < budget).drop("_before")
