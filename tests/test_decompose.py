from brute import strip_comments as brute_strip
from brute import subqueries as brute_subqueries
from pyspark.sql import functions as F

from sqlstrata.functions.text import normalize_ws, strip_comments
from sqlstrata.operators import assemble as A
from sqlstrata.operators import decompose as D

ADVERSARIAL = [
    # parens, select, -- and from inside literals; doubled quotes
    "SELECT a, 'x (select 1) -- not a comment' AS b, 'it''s (' FROM t WHERE c IN (SELECT d FROM u)",
    # nesting depth >= 5
    "SELECT (SELECT (SELECT (SELECT (SELECT (SELECT 1) FROM a) FROM b) FROM c) FROM d) FROM e",
    # unbalanced subquery
    "SELECT a FROM t WHERE EXISTS (SELECT 1 FROM u WHERE u.x = t.x",
    # comment-only and empty-ish
    "-- only a comment\n/* and a block */",
    # no FROM, trailing semicolon
    "SELECT 1, 2, 3;",
    # set operators in lower case over several lines, INTERSECT ALL, MINUS
    "select a from t\nunion\n   all\nselect b from u intersect all select c from v minus select d from w",
    # calc_from identifiers, placeholders past 10
    "SELECT calc_from(x) AS y, " + ", ".join(f"(SELECT {i} FROM s{i})" for i in range(12)) + " FROM t",
    # $1 and backslashes in the text
    "SELECT '$1 \\\\ x' AS a, (SELECT '$2' FROM t) AS b FROM u",
    # WITH block with CTEs and subqueries inside them
    "WITH a AS (SELECT x FROM t WHERE y IN (SELECT y FROM u)), b AS (SELECT 1 AS z) SELECT * FROM a, b",
    # select as part of identifiers must not count
    "SELECT selected, (selection) FROM (SELECT x AS selected FROM t) q",
]


def test_strip_comments_matches_brute_force(spark, corpus_of):
    texts = ADVERSARIAL + ["a -- b\n'--' /* c ( */ d", "x /* unterminated", "'a''b -- c' -- d"]
    got = dict(corpus_of(texts).select("query_id", strip_comments("sql").alias("s")).collect())
    for i, t in enumerate(texts):
        assert got[i + 1] == brute_strip(t), t


def test_normalize_ws_keeps_literals(spark, corpus_of):
    got = corpus_of(["  SELECT   'a   b'\n\n  FROM\tt  "]).select(normalize_ws("sql").alias("n")).first().n
    assert got == "SELECT 'a   b' FROM t"


def test_sections(spark, corpus_of):
    q = "WITH c AS (SELECT 1) SELECT * FROM c UNION ALL select 2 EXCEPT ALL SELECT 3 MINUS SELECT 4"
    rows = D.split_sections(corpus_of([q])).orderBy("section_id").collect()
    assert [(r.section, r.content) for r in rows] == [
        ("cte", "WITH c AS (SELECT 1)"), ("select", "SELECT * FROM c"), ("join", "UNION ALL"),
        ("select", "select 2"), ("join", "EXCEPT ALL"), ("select", "SELECT 3"), ("join", "MINUS"),
        ("select", "SELECT 4")]


PARENTHESISED = ["(SELECT a FROM t) UNION ALL (SELECT b FROM u)", "((select 1)) minus (x)", "( -- c\n SELECT a FROM t) EXCEPT SELECT (b) FROM u",
                 "(WITH q AS (SELECT 1) SELECT * FROM q)", "(a, b)"]
NAMES = ["WITH a(x, y) AS (SELECT 1, 2), b AS (SELECT 3) SELECT * FROM a, b",
         'WITH "My C" AS (SELECT 1), c AS MATERIALIZED (SELECT 2), d (z) as not materialized (SELECT (3)) SELECT 1',
         "WITH RECURSIVE r AS (SELECT 1 UNION ALL SELECT (2)), (SELECT 4) SELECT 1",
         "WITH " + ", ".join(f"c{i} AS (SELECT {i}, '(' AS q FROM t{i})" for i in range(400)) + " SELECT 1",
         "WITH x AS (SELECT " + " + ".join(f"a{i}.b" for i in range(400)) + "), very_long_name_after_many_words AS (SELECT 2) SELECT 1"]


def test_sections_match_brute_force(spark, corpus_of):
    """Pieces in parentheses stay."""
    from brute import sections as brute_sections
    texts = ADVERSARIAL + PARENTHESISED + NAMES
    got = {}
    for r in D.split_sections(corpus_of(texts)).orderBy("query_id", "section_id").collect():
        got.setdefault(r.query_id, []).append((r.section, r.content))
    for i, t in enumerate(texts):
        assert got.get(i + 1, []) == brute_sections(t), t


def test_ctes_match_brute_force(spark, corpus_of):
    from brute import ctes as brute_ctes
    from brute import sections as brute_sections
    got = {}
    for r in D.cte_list(corpus_of(NAMES)).orderBy("query_id", "cte_pos").collect():
        assert (r.error is None) == (r.name is not None)
        got.setdefault(r.query_id, []).append((r.name, r.body))
    for i, t in enumerate(NAMES):
        assert got[i + 1] == brute_ctes(brute_sections(t)[0][1]), t
    assert [n for n, _ in got[1]] == ["a", "b"] and [n for n, _ in got[2]] == ['"My C"', "c", "d"]
    assert got[3][1] == (None, "SELECT 4") and len(got[4]) == 400


def test_no_text_is_lost(spark, corpus_of):
    """Texts without code have a row; all others come back from the log."""
    texts = [None, "", " \n", "-- only", "/* a */ -- b"] + PARENTHESISED
    rows = D.decompose_log(corpus_of(texts)).collect()
    for q in range(1, 6):
        mine = [r for r in rows if r.query_id == q]
        assert len(mine) == 1 and mine[0].type == "section_main" and mine[0].response_error == D.EMPTY_TEXT and mine[0].content == ""
    final = {r.query_id: r.final_query for r in A.assemble_query(D.decompose_log(corpus_of(texts))).collect()}
    for i, t in enumerate(PARENTHESISED):
        assert final[6 + i].split() == (brute_strip(t).replace("minus", "MINUS")).split(), t


def test_subqueries_match_brute_force(spark, corpus_of):
    corpus = corpus_of(ADVERSARIAL)
    sections = D.split_sections(corpus)
    pieces = D.subquery_pieces(sections).collect()
    got = {}
    for p in pieces:
        got.setdefault((p.query_id, p.section_id), {})[p.n] = (p.content, p.unbalanced)
    for s in sections.filter(F.col("section").isin("cte", "select")).collect():
        main, subs, unb = brute_subqueries(s.content, s.section, s.section_id)
        g = got[(s.query_id, s.section_id)]
        assert g[0] == (main, unb), s.content
        assert {k: v[0] for k, v in g.items() if k > 0} == subs, s.content


def test_unbalanced_row_is_kept_with_error(spark, corpus_of):
    log = D.decompose_log(corpus_of([ADVERSARIAL[2]])).collect()
    assert len(log) == 1 and log[0].type == "section_main"
    assert log[0].response_error == D.UNBALANCED
    assert log[0].content == ADVERSARIAL[2]


def test_round_trip(spark, corpus_of):
    """resolve(decompose(sql)) gives back every section exactly."""
    corpus = corpus_of(ADVERSARIAL)
    log = D.decompose_log(corpus)
    res = {(r.query_id, r.section_id): r.resolved
           for r in A.resolve_sections(A.piece_text(log)).collect()}
    for s in D.split_sections(corpus).collect():
        assert res[(s.query_id, s.section_id)] == s.content


def test_numbering_is_post_order(spark, corpus_of):
    q = "SELECT (SELECT a FROM (SELECT b FROM t) x) AS c, (SELECT d FROM u) FROM v"
    subs = {r.n: r.content for r in D.extract_subqueries(corpus_of([q])).collect()}
    assert subs == {1: "SELECT b FROM t", 2: "SELECT a FROM (<<subquery_select[1]_1>>) x",
                    3: "SELECT d FROM u"}


def test_subqueries_full_keeps_nesting(spark, corpus_of):
    q = "SELECT (SELECT a FROM (SELECT b FROM t) x) AS c FROM v"
    full = {r.n: r.full_sub_query for r in D.subqueries_full(corpus_of([q])).collect()}
    assert full == {1: "SELECT b FROM t", 2: "SELECT a FROM (SELECT b FROM t) x"}


def test_cte_list_and_named_view(spark, corpus_of):
    q = "WITH a AS (SELECT x FROM t), b AS (SELECT (SELECT 1) AS y) SELECT * FROM a WHERE x IN (SELECT 2)"
    ctes = [(r.cte_pos, r.name, r.body) for r in D.cte_list(corpus_of([q])).orderBy("cte_pos").collect()]
    assert ctes == [(1, "a", "SELECT x FROM t"), (2, "b", "SELECT (SELECT 1) AS y")]
    view = {r.name: r for r in D.named_view(corpus_of([q, "DELETE FROM t"])).collect() if r.query_id == 1}
    assert view["main"].query.startswith("WITH a AS (<<a>>), b AS (<<b>>)\nSELECT * FROM a WHERE x IN (<<")
    bad = D.named_view(corpus_of(["DELETE FROM t"])).collect()
    assert bad[0].error and bad[0].name == "main"
    main = A.main_text(D.named_view(corpus_of([q]))).first().main
    assert main == "WITH a AS (SELECT x FROM t), b AS (SELECT (SELECT 1) AS y)\nSELECT * FROM a WHERE x IN (SELECT 2)"


def test_single_stream_matches_sections_and_brute_force(spark, corpus_of):
    corpus = corpus_of(ADVERSARIAL)
    sections = {(s.query_id, s.section_id): s for s in D.split_sections(corpus).collect()}
    pieces = {}
    for p in D.decompose_pieces(corpus).collect():
        if p.section != D.NOTHING:  # a text without code has a piece and no section
            pieces.setdefault((p.query_id, p.section_id), {})[p.n] = p
    assert set(pieces) == set(sections)
    for key, s in sections.items():
        got = pieces[key]
        assert got[0].original == s.content and got[0].section == s.section
        if s.section in ("cte", "select"):
            main, subs, unb = brute_subqueries(s.content, s.section, s.section_id)
            assert got[0].content == main and got[0].unbalanced == unb
            assert {k: v.content for k, v in got.items() if k > 0} == subs
