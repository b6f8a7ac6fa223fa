"""What keeps conversion from searching texts in vain changes no result."""

from pyspark.sql import functions as F

from sqlstrata.operators import assemble as A
from sqlstrata.operators import clauses as C
from sqlstrata.operators import convert as V

TEXTS = ["", " ", "SELECT a FROM t", "select nvl (a, 1), Varchar2(20 byte), VARCHAR x, number(10,2), sysdate FROM t", "a 'NVL(' b NVL(c, 'it''s')",
         "TO_DATE(x, 'YYYYMMDD')", "'yyyymmdd'", "\"SYSDATE\" SYSDATE", "'open NVL(", "nVl(", "NVLX(1)", "VARCHAR(3) VARCHAR", "NUMBER ( 3 ) + xNUMBER(3)",
         "ROWNUMBER", "é NVL(é, 1) ß", None]


def values(spark, texts, *cols):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *cols).orderBy("i").collect()]


def test_rules_with_and_without_the_search_for_words(spark):
    never = [*V.DEFAULT_RULES, ("code", "(?!)", "")]  # not the default rules only: every text is searched
    t = F.col("t")
    for one, other in values(spark, TEXTS, V.apply_rules(t).alias("a"), V.apply_rules(t, never).alias("b")):
        assert one == other
    own = [("code", r"\bzz\b", "yy"), ("literal", "^'q'$", "'r'")]
    assert values(spark, ["zz", "zz 'zz' 'q'", "'q'"], V.apply_rules(t, own).alias("a")) == [("yy",), ("yy 'zz' 'r'",), ("'r'",)]


def test_texts_that_no_rewrite_changes_are_not_mapped(spark):
    t = F.col("t")
    got = values(spark, ["SELECT ROWNUM AS r, 'a, b' FROM t WHERE a = 1", "SELECT a FROM t, (<<subquery_select[1]_1>>) v WHERE t.i = v.i",
                         "SELECT a FROM t, u x WHERE t.i = x.i", "SELECT a FROM s.t as y\n,u WHERE ROWNUM <= 1"],
                 t.rlike(C._COMMA_FORM).alias("a"), t.rlike(C._FIRST_FORM).alias("b"))
    assert got == [(False, False), (False, False), (True, False), (True, True)]
    # the words from which rules start are those by which texts are left out
    assert all(any(w in p.lower() for w in V.RULE_WORDS) for _, p, _ in V.DEFAULT_RULES)


def test_star_expand_takes_the_first_star(spark):
    two = F.array(F.lit("a"), F.lit("b"))
    texts = ["SELECT * FROM t WHERE x IN (SELECT * FROM u)", "select  * from t", "(x) SELECT\n* FROM t", "SELECT a * b FROM t", "SELECT *", "SELECT a FROM t", "", None]
    want = ["SELECT a, b FROM t WHERE x IN (SELECT * FROM u)", "select  a, b from t", "(x) SELECT\na, b FROM t", "SELECT a * b FROM t", "SELECT a, b",
            "SELECT a FROM t", "", None]
    assert [r[0] for r in values(spark, texts, A.star_expand(F.col("t"), two, two).alias("a"))] == want
    assert [r[0] for r in values(spark, texts, A.star_expand(F.col("t"), two, F.lit(None).cast("array<string>")).alias("a"))] == texts


def test_errors_of_texts_without_marks(spark):
    texts = ["a = b", "(a", "a)", "x ROWNUM", "'ROWNUM ('", "CONNECT BY a", "a.b(+)", "connected", "", None]
    want = ["", "unbalanced parentheses", "unbalanced parentheses", "unsupported: rownum", "", "unsupported: connect_by", "unsupported: outer_join_plus", "", "", ""]
    assert [r[0] for r in values(spark, texts, V.check_errors(F.col("t")).alias("e"))] == want
