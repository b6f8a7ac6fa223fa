"""Regular expressions and word lists (Java regex, as used by Spark).

Everything is literal-safe: a quoted literal ``'...'`` (with doubled quotes)
or a quoted identifier ``"..."`` is always consumed as one piece, so
parentheses, keywords and comment markers inside literals are never seen.
Possessive quantifiers keep the Java matcher from recursing on long literals.
"""

# ---------------------------------------------------------------------------
# Building blocks
# ---------------------------------------------------------------------------
LIT = "(?:'[^']*+')++|\"[^\"]*+\""
WORDCH = r"A-Za-z0-9_$#"
_NB = rf"(?<![{WORDCH}])"          # not preceded by a word character
_NA = rf"(?![{WORDCH}])"           # not followed by a word character

# Comments: keep group 1 (a literal), drop the comment.
STRIP = rf"({LIT})|--[^\n\r]*|/\*(?s:.*?)\*/"
# Whitespace outside literals: group 1 is everything up to the next blank
# run (literals whole); replacing by "$1 " collapses each run to one space.
WS = rf"((?:{LIT}|[^'\"\s]++)*+)\s+"

# A balanced parenthesis group with no nested parens, quotes or SELECT
# (function arguments such as COUNT(*), VARCHAR2(20)): it only matters for
# depth, so it stays inside a run instead of becoming separate tokens.
SIMPLE_GROUP = rf"\((?![^()]*?{_NB}(?i:select){_NA})[^()'\"]*+\)"

# Section tokens: runs first (maximal, literal-safe, with simple groups;
# capped at 256 pieces so one match never recurses deeply -- consecutive runs
# simply concatenate again), then parens, then depth-0 candidates (SELECT and
# set operators as whole words).
SET_OPS = r"union(?:\s+all)?|intersect(?:\s+all)?|except(?:\s+all)?|minus"
_SECT_KW = rf"{_NB}(?i:select|{SET_OPS}){_NA}"
_NOT_SECT_KW = rf"(?!(?i:select|union|intersect|except|minus){_NA})"
SECTION_TOKEN = (
    rf"(?:{LIT}|{SIMPLE_GROUP}|[^()'\"{WORDCH}]++|{_NOT_SECT_KW}[{WORDCH}]++){{1,256}}+"
    rf"|\(|\)|{_SECT_KW}"
    r"|['\"]"
)

# Subquery tokens inside one section: parens, SELECT, runs.
_SUB_KW = rf"{_NB}(?i:select){_NA}"
_NOT_SUB_KW = rf"(?!(?i:select){_NA})"
SUBQUERY_TOKEN = (
    rf"\(|\)|{_SUB_KW}"
    rf"|(?:{LIT}|[^()'\"{WORDCH}]++|{_NOT_SUB_KW}[{WORDCH}]++){{1,256}}+"
    r"|['\"]"
)

# Select-list tokens: runs (with simple groups) first, then parens, commas,
# placeholders (one token each), SELECT and FROM as whole words.
_COL_KW = rf"{_NB}(?i:select|from){_NA}"
_NOT_COL_KW = rf"(?!(?i:select|from){_NA})"
COLUMN_TOKEN = (
    rf"(?:{LIT}|{SIMPLE_GROUP}|[^(),'\"<{WORDCH}]++|{_NOT_COL_KW}[{WORDCH}]++|<(?!<)){{1,256}}+"
    rf"|\(|\)|,|<<[^>]*+>>|{_COL_KW}"
    r"|['\"<]"
)

WITH_HEAD = r"^\s*(?i:with)(?![A-Za-z0-9_$#])"
SELECT_HEAD = r"^\s*(?i:select)(?![A-Za-z0-9_$#])"
BLANK = r"^\s*$"

# ---------------------------------------------------------------------------
# These must equal the reference's to give the same results.
# ---------------------------------------------------------------------------
# Tables after FROM/JOIN (case-insensitive), and words that are not tables.
TABLE_PATTERN = r"(?i)\b(?:FROM|JOIN)\s+([a-zA-Z_][a-zA-Z0-9_.]*)"
TABLE_STOPWORDS = ["ON", "WHERE", "GROUP", "ORDER", "HAVING", "SELECT",
                   "INNER", "LEFT", "RIGHT", "OUTER"]
# Looser table list: any run without space, ';' or parens after FROM / JOIN.
LOOSE_FROM_PATTERN = r"(?i)FROM\s+([^\s;()]+)"
LOOSE_JOIN_PATTERN = r"(?i)JOIN\s+([^\s;()]+)"
# Function calls NAME( on upper-cased text, and words that are not functions.
FUNCTION_PATTERN = r"\b([A-Z_][A-Z0-9_]*)\s*\("
FUNCTION_STOPWORDS = ["SELECT", "FROM", "JOIN", "WHERE", "CASE", "WHEN", "THEN",
                      "ELSE", "END", "GROUP", "ORDER", "HAVING", "ON", "UNION",
                      "EXISTS", "IN", "AS", "WITH"]
# Reply mining: headings '## name:' and fenced sql blocks.
HEADING_PATTERN = r"##\s*(.*?)\s*:"
FENCE_PATTERN = r"(?i)```sql\s*([\s\S]*?)\s*```"
# Column chunks are sent as 'SELECT <cols> FROM dummy'.
CHUNK_QUERY_PREFIX = "SELECT "
CHUNK_QUERY_SUFFIX = " FROM dummy"
CHUNK_SEPARATOR = ", "
