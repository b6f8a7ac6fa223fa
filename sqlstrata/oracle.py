"""DuckDB twins of the Spark operators (the correctness oracle).

Written independently of the Spark code: DuckDB's regex engine is RE2 (no
look-around, no possessive quantifiers), so texts are tokenized at word
level here and keywords are recognised by value, with ``X ALL`` merged by
``lead``/``lag``. Fragments are CTE bodies that later oracles build on.
"""

from __future__ import annotations

from sqlstrata.sources.corpus import corpus_sql_duckdb

LIT = r"""(?:'[^']*')+|"[^"]*\""""
STRIP = rf"""({LIT})|--[^\n\r]*|/\*(?s:.*?)\*/"""
WTOK = rf"""{LIT}|\(|\)|[A-Za-z0-9_$#]+|[^()'"A-Za-z0-9_$#]+|['"]"""
CTOK = rf"""{LIT}|\(|\)|,|<<[^>]*>>|[A-Za-z0-9_$#]+|[^(),'"<A-Za-z0-9_$#]+|['"<]"""


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip_ws(e: str) -> str:
    return f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"


CORPUS = f"corpus AS ({corpus_sql_duckdb('part')})"
STRIPPED = f"stripped AS (SELECT query_id, regexp_replace(sql, {q(STRIP)}, '\\1', 'g') AS sql FROM corpus)"

_SETW = "('UNION','INTERSECT','EXCEPT')"
SECTIONS = f"""
s_tok AS (
  SELECT query_id, unnest(l) AS tok, generate_subscripts(l, 1) AS pos
  FROM (SELECT query_id, regexp_extract_all(sql, {q(WTOK)}) AS l FROM stripped)
),
s_t1 AS (
  SELECT *, upper(tok) AS w,
    lead(tok, 1) OVER q AS l1, lead(tok, 2) OVER q AS l2,
    lag(tok, 1) OVER q AS p1, lag(tok, 2) OVER q AS p2,
    sum(CASE WHEN tok = '(' THEN 1 WHEN tok = ')' THEN -1 ELSE 0 END) OVER (q ROWS UNBOUNDED PRECEDING)
      - (CASE WHEN tok = '(' THEN 1 WHEN tok = ')' THEN -1 ELSE 0 END) AS dbefore
  FROM s_tok WINDOW q AS (PARTITION BY query_id ORDER BY pos)
),
s_t2 AS (
  SELECT *,
    CASE WHEN w IN {_SETW} AND regexp_full_match(coalesce(l1, ''), '\\s+') AND upper(l2) = 'ALL' THEN w || ' ALL'
         WHEN w IN ('SELECT','UNION','INTERSECT','EXCEPT','MINUS') THEN w END AS kwn,
    (upper(coalesce(p2, '')) IN {_SETW} AND regexp_full_match(coalesce(p1, ''), '\\s+') AND w = 'ALL')
      OR (upper(coalesce(p1, '')) IN {_SETW} AND regexp_full_match(tok, '\\s+') AND upper(coalesce(l1, '')) = 'ALL')
      AS absorbed
  FROM s_t1
),
s_t3 AS (
  SELECT *, (kwn IS NOT NULL AND dbefore = 0 AND NOT absorbed) AS kw0 FROM s_t2
),
s_t4 AS (
  SELECT *,
    sum(CASE WHEN kw0 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS g,
    last_value(CASE WHEN kw0 THEN kwn END IGNORE NULLS) OVER (PARTITION BY query_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS opener
  FROM s_t3
),
s_grp AS (
  SELECT query_id, 2 * g + CASE WHEN opener <> 'SELECT' AND NOT kw0 AND NOT absorbed THEN 1 ELSE 0 END AS sk,
         max(opener) AS opener, {strip_ws("string_agg(tok, '' ORDER BY pos)")} AS content
  FROM s_t4 GROUP BY ALL
),
sections AS (
  SELECT query_id,
    CAST(row_number() OVER (PARTITION BY query_id ORDER BY sk) AS INTEGER) AS section_id,
    CASE WHEN sk = 0 AND regexp_matches(content, '^\\s*(?i:with)([^A-Za-z0-9_$#]|$)') THEN 'cte'
         WHEN regexp_matches(upper(content), '^[\\s(]*SELECT') THEN 'select'
         WHEN sk % 2 = 0 AND opener <> 'SELECT' THEN 'join'
         ELSE 'unknown' END AS section,
    CASE WHEN sk % 2 = 0 AND opener <> 'SELECT' THEN upper(regexp_replace(content, '\\s+', ' ', 'g'))
         ELSE content END AS content
  FROM s_grp
  WHERE content <> ''
)"""

# texts without code have one row of their own in the log
BLANKS = f"blanks AS (SELECT query_id FROM stripped WHERE coalesce({strip_ws('sql')}, '') = '')"

SUBQUERIES = f"""
u_tok AS (
  SELECT query_id, section_id, section, unnest(l) AS tok, generate_subscripts(l, 1) AS pos
  FROM (SELECT query_id, section_id, section, regexp_extract_all(content, {q(WTOK)}) AS l
        FROM sections WHERE section IN ('cte', 'select'))
),
u_t1 AS (
  SELECT *,
    (tok = '(' AND (upper(coalesce(lead(tok, 1) OVER q, '')) = 'SELECT'
                    OR (regexp_full_match(coalesce(lead(tok, 1) OVER q, 'x'), '\\s+')
                        AND upper(coalesce(lead(tok, 2) OVER q, '')) = 'SELECT'))) AS isopen,
    sum(CASE WHEN tok = '(' THEN 1 WHEN tok = ')' THEN -1 ELSE 0 END) OVER (q ROWS UNBOUNDED PRECEDING) AS dincl
  FROM u_tok WINDOW q AS (PARTITION BY query_id, section_id ORDER BY pos)
),
u_t2 AS (
  SELECT *, CASE WHEN tok = '(' THEN dincl WHEN tok = ')' THEN dincl + 1 END AS d FROM u_t1
),
u_t3 AS (
  SELECT *,
    coalesce(tok = ')' AND last_value(CASE WHEN tok = '(' THEN isopen END IGNORE NULLS)
      OVER (PARTITION BY query_id, section_id, d ORDER BY pos ROWS UNBOUNDED PRECEDING), false) AS isclose
  FROM u_t2
),
u_t4 AS (
  SELECT *,
    sum(CAST(isopen AS INT) - CAST(isclose AS INT)) OVER (q ROWS UNBOUNDED PRECEDING) + CAST(isclose AS INT) AS sd,
    sum(CAST(isclose AS INT)) OVER (q ROWS UNBOUNDED PRECEDING) AS n0,
    sum(CAST(isopen AS INT) - CAST(isclose AS INT)) OVER (PARTITION BY query_id, section_id) > 0 AS unbalanced
  FROM u_t3 WINDOW q AS (PARTITION BY query_id, section_id ORDER BY pos)
),
u_ev AS (
  SELECT query_id, section_id, section, pos, unbalanced, 0 AS level, tok AS t, NULL::BIGINT AS closen
    FROM u_t4 WHERE unbalanced
  UNION ALL
  SELECT query_id, section_id, section, pos, unbalanced, sd, CASE WHEN isopen THEN '' ELSE tok END, NULL
    FROM u_t4 WHERE NOT unbalanced AND NOT isclose
  UNION ALL
  SELECT query_id, section_id, section, pos, unbalanced, sd, '', n0 FROM u_t4 WHERE NOT unbalanced AND isclose
  UNION ALL
  SELECT query_id, section_id, section, pos, unbalanced, sd - 1,
         '(<<subquery_' || section || '[' || section_id || ']_' || n0 || '>>)', NULL
    FROM u_t4 WHERE NOT unbalanced AND isclose
),
u_ev2 AS (
  SELECT *, CASE WHEN level = 0 THEN 0 ELSE first_value(closen IGNORE NULLS) OVER (
      PARTITION BY query_id, section_id, level ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END AS n
  FROM u_ev
),
pieces AS (
  SELECT query_id, section_id, n, max(section) AS section, string_agg(t, '' ORDER BY pos) AS content,
         bool_or(unbalanced) AS unbalanced
  FROM u_ev2 GROUP BY query_id, section_id, n
)"""

LOG = """
dlog AS (
  SELECT query_id, section, section_id, 'subquery' AS type,
         'subquery_' || section || '[' || section_id || ']_' || n AS identifier,
         NULL::VARCHAR AS original_query, content, '' AS response_error
    FROM pieces WHERE n > 0
  UNION ALL
  SELECT s.query_id, s.section, s.section_id, 'section_main', 'section_' || s.section_id || '_main',
         s.content, coalesce(p.content, s.content),
         CASE WHEN p.unbalanced THEN 'unbalanced parentheses' ELSE '' END
    FROM sections s LEFT JOIN pieces p ON p.query_id = s.query_id AND p.section_id = s.section_id AND p.n = 0
  UNION ALL
  SELECT query_id, section, section_id, '', '', NULL, content, '' FROM sections
   WHERE section NOT IN ('cte', 'select')
  UNION ALL
  SELECT query_id, 'unknown', 1, 'section_main', 'section_1_main', '', '', 'empty text' FROM blanks
)"""


def with_(*frags: str, body: str) -> str:
    return "WITH " + ",\n".join(frags) + "\n" + body


BASE = [CORPUS, STRIPPED, BLANKS, SECTIONS]

BIG = 1 << 40
SW = strip_ws

COLS = f"""
c_src AS (SELECT query_id, section_id, identifier, {SW('content')} AS q FROM dlog),
c_tok AS (
  SELECT query_id, section_id, identifier, unnest(l) AS tok, generate_subscripts(l, 1) AS pos
  FROM (SELECT query_id, section_id, identifier, regexp_extract_all(q, {q(CTOK)}) AS l FROM c_src)
),
c_t1 AS (
  SELECT *, (sum(dl) OVER (PARTITION BY query_id, section_id, identifier ORDER BY pos ROWS UNBOUNDED PRECEDING) - dl) = 0 AS d0
  FROM (SELECT *, CASE WHEN tok = '(' THEN 1 WHEN tok = ')' THEN -1 ELSE 0 END AS dl FROM c_tok)
),
c_t2 AS (
  SELECT *,
    sum(CASE WHEN d0 AND tok = ',' THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, section_id, identifier ORDER BY pos ROWS UNBOUNDED PRECEDING) AS commas,
    min(CASE WHEN d0 AND upper(tok) = 'SELECT' THEN pos END) OVER (PARTITION BY query_id, section_id, identifier) AS selpos
  FROM c_t1
),
c_t3 AS (
  SELECT *, min(CASE WHEN d0 AND upper(tok) = 'FROM' AND pos > selpos THEN pos END)
              OVER (PARTITION BY query_id, section_id, identifier) AS frompos
  FROM c_t2
),
c_t4 AS (
  SELECT *, CASE WHEN selpos IS NULL OR pos < selpos THEN -1 WHEN pos = selpos THEN NULL
                 WHEN pos >= coalesce(frompos, {BIG}) THEN {BIG}
                 WHEN d0 AND tok = ',' THEN NULL ELSE commas END AS part
  FROM c_t3
),
c_l1 AS (
  SELECT query_id, section_id, identifier, part, string_agg(tok, '' ORDER BY pos) AS text, max(selpos) AS selpos
  FROM c_t4 WHERE part IS NOT NULL GROUP BY ALL
),
c_l2 AS (
  SELECT query_id, section_id, identifier,
    max(CASE WHEN part = -1 THEN text END) AS prefix, max(CASE WHEN part = {BIG} THEN text END) AS suffix,
    max(selpos) AS selpos,
    list({SW('text')} ORDER BY part) FILTER (WHERE part >= 0 AND part < {BIG} AND {SW('text')} <> '') AS cols
  FROM c_l1 GROUP BY ALL
),
clog AS (
  SELECT d.query_id, d.section, d.section_id, d.type, d.identifier, d.original_query,
    coalesce(CASE WHEN c.selpos IS NOT NULL THEN {SW("coalesce(c.prefix, '') || 'SELECT * ' || coalesce(c.suffix, '')")}
                  ELSE c.prefix END, {SW('d.content')}) AS content,
    CASE WHEN c.selpos IS NOT NULL THEN coalesce(c.cols, []::VARCHAR[]) ELSE []::VARCHAR[] END AS cols,
    d.response_error
  FROM dlog d LEFT JOIN c_l2 c USING (query_id, section_id, identifier)
)"""

# Word lists and patterns that must equal the reference's (as in
# functions/patterns.py, spelled for this engine).
TABLE_STOP = "('ON','WHERE','GROUP','ORDER','HAVING','SELECT','INNER','LEFT','RIGHT','OUTER')"
FUNC_STOP = ("('SELECT','FROM','JOIN','WHERE','CASE','WHEN','THEN','ELSE','END','GROUP','ORDER',"
             "'HAVING','ON','UNION','EXISTS','IN','AS','WITH')")
TABLE_RE = r"(?i)\b(?:FROM|JOIN)\s+([a-zA-Z_][a-zA-Z0-9_.]*)"
FUNC_RE = r"\b([A-Z_][A-Z0-9_]*)\s*\("


def tables_sql(e: str) -> str:
    return (f"list_sort(list_distinct(list_filter(regexp_extract_all({e}, {q(TABLE_RE)}, 1), "
            f"lambda x: upper(x) NOT IN {TABLE_STOP})))")


def functions_sql(e: str, cols: str | None = None) -> str:
    found = f"regexp_extract_all(upper({e}), {q(FUNC_RE)}, 1)"
    if cols:
        found = (f"flatten([{found}] || list_transform({cols}, "
                 f"lambda c: regexp_extract_all(upper(c), {q(FUNC_RE)}, 1)))")
    return f"list_sort(list_distinct(list_filter({found}, lambda x: x NOT IN {FUNC_STOP})))"


S1 = f"""
s1log AS (
  SELECT *, {tables_sql('content')} AS tables, {functions_sql('content', 'cols')} AS functions FROM clog
)"""

PIECE = r"""(?:'[^']*')+|"[^"]*"|[^'"]+|['"]"""


def convert_sql(e: str) -> str:
    code = "p"
    for pat, rep in ((r'(?i)\bNVL\s*\(', 'COALESCE('), (r'(?i)\bVARCHAR2\b(\s*\(\s*\d+\s*(?:BYTE|CHAR)?\s*\))?', 'STRING'),
                     (r'(?i)\bVARCHAR\b(\s*[^\s(]|\s*$)', 'STRING\\1'),
                     (r'(?i)\bNUMBER\s*\(\s*(\d+)\s*(,\s*\d+\s*)?\)', 'DECIMAL(\\1\\2)'),
                     (r'(?i)\bSYSDATE\b', 'CURRENT_TIMESTAMP()')):
        code = f"regexp_replace({code}, {q(pat)}, {q(rep)}, 'g')"
    lit = "CASE WHEN p = '''YYYYMMDD''' THEN '''yyyyMMdd''' ELSE p END"
    return (f"CASE WHEN {e} IS NULL THEN NULL ELSE array_to_string(list_transform(regexp_extract_all({e}, "
            f"{q(PIECE)}), lambda p: CASE WHEN starts_with(p, '''') OR starts_with(p, '\"') THEN {lit} "
            f"ELSE {code} END), '') END")


def place_sql(e: str) -> str:
    """The forms of the corpus that are rewritten by place: one table with an alias, a
    comparison and ROWNUM = 1; two tables, one equality and one comparison."""
    one = r"(?i)^(SELECT \* FROM) (\w+ (\w+)) WHERE (\w+\.\w+ = \d+) AND ROWNUM = 1$"
    two = r"(?i)^(SELECT \* FROM \w+ \w+), (\w+ \w+) WHERE (\w+\.\w+ = \w+\.\w+) AND (\w+\.\w+ > \d+)$"
    return (f"regexp_replace(regexp_replace({e}, {q(two)}, {q(r'\1 JOIN \2 ON \3 WHERE \4')}), {q(one)}, "
            f"{q(r'\1 (SELECT \3.*, ROW_NUMBER() OVER (ORDER BY 1) AS rn FROM \2 WHERE \4) \3 WHERE \3.rn = 1')})")


def code_sql(e: str) -> str:
    """Literals emptied: audit words inside them are data."""
    return f"regexp_replace({e}, {q(LIT)}, {q(chr(39) * 2)}, 'g')"


def errors_sql(e: str) -> str:
    code = f"regexp_replace({e}, {q(LIT)}, '', 'g')"
    bal = (f"length(regexp_replace({code}, '[^(]', '', 'g')) - length(regexp_replace({code}, '[^)]', '', 'g'))")
    parts = [f"CASE WHEN {bal} <> 0 THEN 'unbalanced parentheses' END",
             f"CASE WHEN regexp_matches({code_sql(e)}, {q(r'(?i)\bROWNUM\b')}) THEN 'unsupported: rownum' END",
             f"CASE WHEN regexp_matches({code_sql(e)}, {q(r'(?i)\bCONNECT\s+BY\b')}) THEN 'unsupported: connect_by' END",
             f"CASE WHEN regexp_matches({code_sql(e)}, {q(r'\(\+\)')}) THEN 'unsupported: outer_join_plus' END"]
    return f"concat_ws('; ', {', '.join(parts)})"


def merge_errors(a: str, b: str) -> str:
    """Reasons of ``a``, then those of ``b`` that ``a`` does not have (``b`` has none twice)."""
    new = f"list_filter(string_split({b}, '; '), lambda x: NOT list_contains(string_split({a}, '; '), x))"
    return f"concat_ws('; ', nullif({a}, ''), nullif(array_to_string({new}, '; '), ''))"


CTE_LIST = f"""
k_tok AS (
  SELECT query_id, unnest(l) AS tok, generate_subscripts(l, 1) AS pos
  FROM (SELECT query_id, regexp_extract_all(content, {q(WTOK)}) AS l FROM sections WHERE section = 'cte')
),
k_t1 AS (
  SELECT *, sum(dl) OVER (PARTITION BY query_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - dl AS db,
         sum(CASE WHEN tok IN ('(', ')') THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS pc
  FROM (SELECT *, CASE WHEN tok = '(' THEN 1 WHEN tok = ')' THEN -1 ELSE 0 END AS dl FROM k_tok)
),
k_t2 AS (
  SELECT *, sum(CASE WHEN tok = '(' AND db = 0 THEN 1 ELSE 0 END)
              OVER (PARTITION BY query_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS span FROM k_t1
),
k_lead AS (
  SELECT query_id, span + 1 AS span, string_agg(tok, '' ORDER BY pos) AS lead FROM k_t2
  WHERE db = 0 AND tok <> '(' GROUP BY ALL
),
k_body AS (
  SELECT query_id, span, string_agg(tok, '' ORDER BY pos) AS body FROM k_t2
  WHERE db >= 1 AND NOT (tok = ')' AND db = 1) GROUP BY ALL
),
k_spans AS (
  SELECT o.query_id, o.span, coalesce(b.body, '') AS body, coalesce(l.lead, '') AS own, coalesce(p.lead, '') AS prev,
         coalesce(n.lead, '') AS next
  FROM (SELECT DISTINCT query_id, span FROM k_t2 WHERE span > 0) o
  LEFT JOIN k_body b USING (query_id, span)
  LEFT JOIN k_lead l USING (query_id, span)
  LEFT JOIN k_lead p ON p.query_id = o.query_id AND p.span = o.span - 1
  LEFT JOIN k_lead n ON n.query_id = o.query_id AND n.span = o.span + 1
),
k_names AS (
  SELECT *, regexp_matches(own, {q(r'(?i)(^|[^A-Za-z0-9_$#])AS(\s+(NOT\s+)?MATERIALIZED)?\s*$')}) AS is_body,
    regexp_matches(next, {q(r'(?i)^\s*AS(\s+(NOT\s+)?MATERIALIZED)?\s*$')}) AS is_list,
    CASE WHEN regexp_matches(own, {q(r'(?i)^\s*AS(\s+(NOT\s+)?MATERIALIZED)?\s*$')})
         THEN regexp_extract(prev, {q(r'("[^"]+"|[A-Za-z_][A-Za-z0-9_$#]*)\s*$')}, 1)
         ELSE regexp_extract(own, {q(r'(?i)("[^"]+"|[A-Za-z_][A-Za-z0-9_$#]*)\s*AS(\s+(NOT\s+)?MATERIALIZED)?\s*$')}, 1) END AS found
  FROM k_spans
),
ctes AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY span) AS INTEGER) AS cte_pos,
         CASE WHEN is_body THEN nullif(found, '') END AS name, body,
         CASE WHEN is_body AND found <> '' THEN NULL ELSE 'CTE without a name' END AS error
  FROM k_names WHERE is_body OR NOT is_list
)"""

NAMED_VIEW = f"""
nv_head AS (SELECT query_id, {SW('sql')} AS t FROM stripped),
nv_ok AS (SELECT query_id FROM nv_head WHERE regexp_matches(upper(t), '^(WITH|SELECT)([^A-Z0-9_$#]|$)')),
nv_cte_head AS (
  SELECT query_id, 'WITH ' || string_agg(name || ' AS (<<' || name || '>>)', ', ' ORDER BY cte_pos) || chr(10) AS cte_head
  FROM ctes WHERE name IS NOT NULL GROUP BY query_id
),
nv_mains AS (
  SELECT query_id, string_agg(content, chr(10) ORDER BY section_id) AS body FROM dlog
  WHERE section <> 'cte' AND type = 'section_main' GROUP BY query_id
),
nv AS (
  SELECT query_id, coalesce(name, 'cte_' || cte_pos) AS name, 'cte' AS type, body AS query, error FROM ctes
   WHERE query_id IN (SELECT query_id FROM nv_ok)
  UNION ALL
  SELECT query_id, identifier, 'subquery', content, NULL FROM dlog
   WHERE section <> 'cte' AND type = 'subquery' AND query_id IN (SELECT query_id FROM nv_ok)
  UNION ALL
  SELECT o.query_id, 'main', 'main', coalesce(h.cte_head, '') || coalesce(m.body, ''), NULL
    FROM nv_ok o LEFT JOIN nv_mains m USING (query_id) LEFT JOIN nv_cte_head h USING (query_id)
  UNION ALL
  SELECT query_id, 'main', 'main', t, 'query must start with WITH or SELECT' FROM nv_head
   WHERE query_id NOT IN (SELECT query_id FROM nv_ok)
)"""

MAIN_TEXT = """
mt_subs AS (
  SELECT query_id, name, query, row_number() OVER (PARTITION BY query_id ORDER BY
    CASE WHEN type = 'cte' THEN 1099511627776
         ELSE coalesce(TRY_CAST(regexp_extract(name, '\\[(\\d+)\\]', 1) AS BIGINT), 0) * 1048576
              + coalesce(TRY_CAST(regexp_extract(name, '_(\\d+)$', 1) AS BIGINT), 0) END DESC) AS rk
  FROM nv WHERE error IS NULL AND type <> 'main'
),
mt_lists AS (SELECT query_id, list(struct_pack(n := name, t := query) ORDER BY rk) AS subs FROM mt_subs GROUP BY query_id),
mt AS (
  SELECT query_id, CASE WHEN subs IS NULL THEN query ELSE
    list_reduce(subs, lambda a, x: struct_pack(n := '', t := replace(a.t, '<<' || x.n || '>>', x.t)), struct_pack(n := '', t := query)).t END AS main
  FROM (SELECT * FROM nv WHERE type = 'main' AND error IS NULL) m LEFT JOIN mt_lists USING (query_id)
)"""


def fold(src: str, text_expr: str, name: str = "fd") -> str:
    """Resolve placeholders per section: one replacement of the whole text per
    subquery, the largest number first."""
    num = "CAST(regexp_extract(identifier, '_(\\d+)$', 1) AS BIGINT)"
    return f"""
{name}_rows AS MATERIALIZED (SELECT query_id, section_id, type, identifier, {text_expr} AS t FROM {src}),
{name}_subs AS (
  SELECT query_id, section_id, list(struct_pack(id := identifier, t := t) ORDER BY {num} DESC) AS subs
  FROM {name}_rows WHERE type = 'subquery' GROUP BY query_id, section_id
),
{name}_fold AS (
  SELECT query_id, section_id, CASE WHEN subs IS NULL THEN m.t ELSE
    list_reduce(subs, lambda a, x: struct_pack(id := '', t := replace(a.t, '<<' || x.id || '>>', x.t)), struct_pack(id := '', t := m.t)).t END AS resolved
  FROM (SELECT * FROM {name}_rows WHERE type = 'section_main') m LEFT JOIN {name}_subs USING (query_id, section_id)
),
{name}_final AS (
  SELECT query_id, string_agg({SW('resolved')}, chr(10) || chr(10) ORDER BY section_id) AS final_query
  FROM {name}_fold GROUP BY query_id
)"""


def star_sql(content: str, cols: str, conv: str) -> str:
    return (f"CASE WHEN len({cols}) > 0 AND len({conv}) > 0 AND regexp_matches({content}, '(?i)select\\s+\\*') THEN "
            f"regexp_replace({content}, '(?i)(select\\s+)\\*', '\\1' || replace(array_to_string({conv}, ', '), '\\', '\\\\')) "
            f"ELSE {content} END")
