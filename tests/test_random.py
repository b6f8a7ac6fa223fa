"""Randomised differential test: generated SQL-like texts (nesting, keywords,
literals with doubled and unterminated quotes, comments, stray parentheses)
through the single-stream decomposition, the two-pass section splitter and
the brute-force scanner. Seeded, so failures reproduce."""

import random

from brute import strip_comments as brute_strip
from brute import subqueries as brute_subqueries

from sqlstrata.operators import assemble as A
from sqlstrata.operators import decompose as D

WORDS = ["a", "b1", "t.x", "selected", "from_x", "calc_from", "count", "sum", "x$y", "#t", "1", "2.5"]
KEYWORDS = ["SELECT", "select", "FROM", "WHERE", "UNION", "union all", "UNION\n ALL", "INTERSECT",
            "EXCEPT ALL", "MINUS", "IN", "EXISTS", "AND", "WITH"]
LITERALS = ["'x'", "'it''s'", "'(select'", "'a -- b'", "''", '"Col (1)"', "'/* c */'"]
NOISE = [", ", " ", "\n", " = ", " + ", "-- note (\n", "/* c ( */", "'", ")", "("]


def _expr(rng, depth):
    r = rng.random()
    if depth < 4 and r < 0.18:
        return "(SELECT " + _list(rng, depth + 1) + " FROM " + rng.choice(WORDS) + ")"
    if depth < 4 and r < 0.28:
        return rng.choice(WORDS) + "(" + _list(rng, depth + 1) + ")"
    if r < 0.40:
        return rng.choice(LITERALS)
    if r < 0.50:
        return rng.choice(KEYWORDS)
    if r < 0.56:
        return rng.choice(NOISE)
    return rng.choice(WORDS)


def _list(rng, depth):
    return ", ".join(_expr(rng, depth) for _ in range(rng.randint(1, 4)))


def _text(rng):
    parts = []
    if rng.random() < 0.3:
        parts.append("WITH c AS (SELECT " + _list(rng, 1) + " FROM t) ")
    for i in range(rng.randint(1, 3)):
        if i:
            parts.append(rng.choice([" UNION ", " union all ", " MINUS ", " INTERSECT ", " EXCEPT "]))
        parts.append("SELECT " + _list(rng, 0) + " FROM " + rng.choice(WORDS) + " WHERE " + _list(rng, 0))
    return "".join(parts)


def test_random_texts(spark, corpus_of):
    rng = random.Random(20261203)
    texts = [_text(rng) for _ in range(400)]
    corpus = corpus_of(texts)
    sections = {(s.query_id, s.section_id): s for s in D.split_sections(corpus).collect()}
    pieces = {}
    for p in D.decompose_pieces(corpus).collect():
        pieces.setdefault((p.query_id, p.section_id), {})[p.n] = p
    assert set(pieces) == set(sections)
    # the generator must keep producing the hard cases
    kinds = {s.section for s in sections.values()}
    assert kinds == {"cte", "select", "join", "unknown"}
    assert sum(1 for p in pieces.values() if p[0].unbalanced and p[0].section in ("cte", "select")) >= 20
    assert max(len(p) for p in pieces.values()) >= 10
    for key, s in sections.items():
        got = pieces[key]
        assert got[0].original == s.content, (texts[key[0] - 1], s.content)
        assert got[0].section == s.section
        if s.section in ("cte", "select"):
            main, subs, unb = brute_subqueries(s.content, s.section, s.section_id)
            assert got[0].unbalanced == unb, s.content
            assert got[0].content == main, s.content
            assert {k: v.content for k, v in got.items() if k > 0} == subs, s.content
    # every section text is a piece of the comment-stripped text, in order
    for qid in range(1, len(texts) + 1):
        secs = [sections[k].content for k in sorted(k for k in sections if k[0] == qid)]
        stripped = brute_strip(texts[qid - 1])
        pos = 0
        for c in secs:
            if sections[(qid, secs.index(c) + 1)].section == "join":
                continue
            found = stripped.find(c, pos)
            assert found >= 0, (stripped, c)
            pos = found + len(c)
    # round trip through the parse log
    log = D.decompose_log(corpus)
    res = {(r.query_id, r.section_id): r.resolved for r in A.resolve_sections(A.piece_text(log)).collect()}
    for key, s in sections.items():
        assert res[key] == s.content


def test_random_select_lists(spark, corpus_of):
    from brute import columns as brute_columns
    from sqlstrata.operators import columns as C
    rng = random.Random(7)
    corpus = corpus_of([_text(rng) for _ in range(300)])
    rows = C.split_columns(D.decompose_log(corpus)).collect()
    log = {(r.query_id, r.section_id, r.identifier): r.content for r in D.decompose_log(corpus).collect()}
    assert sum(1 for r in rows if len(r.columns) >= 3) >= 50
    for r in rows:
        cols, star = brute_columns(log[(r.query_id, r.section_id, r.identifier)])
        assert (r.columns, r.star_content) == (cols, star), log[(r.query_id, r.section_id, r.identifier)]


def test_random_conversion(spark):
    from brute import convert as brute_convert
    from pyspark.sql import functions as F
    from sqlstrata.operators import convert as V
    rng = random.Random(11)
    bits = ["nvl(", "NVL (", "Nvl\\n(", "nvl_x(", "varchar2(10)", "VARCHAR2 ( 20 BYTE )", "varchar2",
            "sysdate", "SYSDATE2", "'YYYYMMDD'", "'yyyymmdd'", "'NVL(a)'", "'it''s sysdate'", "'", '"NVL("',
            " ", ", ", "a", ")", "("]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.c for r in df.select(V.apply_rules(F.col("t")).alias("c")).collect()]
    assert got == [brute_convert(t) for t in texts]


def test_random_lineage(spark):
    import re

    from pyspark.sql import functions as F
    from sqlstrata.functions import patterns as P
    from sqlstrata.operators import lineage as L
    rng = random.Random(13)
    bits = ["FROM ", "from\n", "JOIN ", "join ", "t1", "s.t2", "_x", "ON", "WHERE", "left", "select",
            "count(", "COUNT (", "nvl(", "exists(", "in (", "my_fn(", "x1(", "1(", " ", ", ", ")", "'FROM q'",
            "--c\n", "/* JOIN z */"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(500)]
    cols = [[t[:7], t[3:]] for t in texts]
    df = spark.createDataFrame(list(zip(texts, cols)), "t string, c array<string>")
    got = df.select(L.tables_expr("t").alias("tb"), L.functions_expr("t", "c").alias("fn"),
                    L.loose_tables_expr("t").alias("lt")).collect()
    from brute import strip_comments as brute_strip
    stop_t, stop_f = set(P.TABLE_STOPWORDS), set(P.FUNCTION_STOPWORDS)
    for t, cs, r in zip(texts, cols, got):
        tables = re.findall(r"\b(?:FROM|JOIN)\s+([a-zA-Z_][a-zA-Z0-9_.]*)", brute_strip(t), re.IGNORECASE)
        assert r.tb == sorted({x for x in tables if x.upper() not in stop_t}), t
        funcs = set()
        for x in [t, *cs]:
            funcs.update(f for f in re.findall(P.FUNCTION_PATTERN, x.upper()) if f not in stop_f)
        assert r.fn == sorted(funcs), t
        loose = re.findall(r"FROM\s+([^\s;()]+)", t, re.IGNORECASE) + re.findall(r"JOIN\s+([^\s;()]+)", t, re.IGNORECASE)
        assert r.lt == sorted({x.strip().lower() for x in loose}), t
