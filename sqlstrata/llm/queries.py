"""Registered queries of this subpackage: key -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sqlstrata.llm.chaining import op10_passages
from sqlstrata.llm.filteraudit import op12_filter_audit
from sqlstrata.llm.langid import op4_language
from sqlstrata.llm.mixing import op9_mix
from sqlstrata.llm.neardup import op8_near_vectors
from sqlstrata.llm.packing import op7_pack
from sqlstrata.llm.pii import op13_personal_data
from sqlstrata.llm.prefixtrie import op11_prefix_trie
from sqlstrata.llm.rangecoder import op1_token_files
from sqlstrata.llm.topk import op5_top_k
from sqlstrata.llm.toxicity import op2_toxicity
from sqlstrata.llm.triejoin import op6_trie_join
from sqlstrata.llm.warc import op3_warc
from sqlstrata.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]


def _shipped(query: Query) -> Query:
    """The query, with this package on the executors before its tasks start."""
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)
    return run


QUERIES: dict[str, Query] = {k: _shipped(q) for k, q in {
    "op1_token_files": op1_token_files,
    "op2_toxicity": op2_toxicity,
    "op3_warc": op3_warc,
    "op4_language": op4_language,
    "op5_top_k": op5_top_k,
    "op6_trie_join": op6_trie_join,
    "op7_pack": op7_pack,
    "op8_near_vectors": op8_near_vectors,
    "op9_mix": op9_mix,
    "op10_passages": op10_passages,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_filter_audit": op12_filter_audit,
    "op13_personal_data": op13_personal_data,
}.items()}

_SHA_BITS = """array_to_string(list_transform(range(1, 41), lambda i:
  ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][
    strpos('0123456789abcdef', substr(sha, i, 1))]), '')"""

_WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS sha FROM pages),
b AS (SELECT page_id, body, n, {_SHA_BITS} AS bits, max(page_id) OVER (PARTITION BY body) AS keeper FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
    + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT)
    + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT)
    + CAST(substr(bits, 5 * i + 5, 1) AS INT), 1)), '') AS payload_digest,
  CASE WHEN keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM b"""

_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS f FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_dot_product(q.f, r.f) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id <> r.vec_id AND len(q.f) = len(r.f) WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""

_JOIN = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS l FROM documents
),
g AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(l, i, i + 4), ' ') AS s
  FROM (SELECT doc_id, l, unnest(range(1, greatest(len(l) - 4, 1) + 1)) AS i FROM w WHERE len(l) > 0)
),
n AS (SELECT doc_id, count(*) AS k FROM g GROUP BY doc_id),
links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.c >= 80 * (na.k + nb.k - p.c)
),
r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN links l ON l.a = r.doc_id WHERE r.c < l.b
),
comp AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.k, 0) AS BIGINT) AS n_shingles, comp.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)""".replace("\\\\", "\\")

_TRIE = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(r) || ':' || r || x)) AS k,
    sha256(length(r) || ':' || r || x) AS s, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)
),
l AS (SELECT conv_id, list(struct_pack(s := s, w := w) ORDER BY k) AS own FROM t GROUP BY conv_id),
c AS (
  -- the checksum of the decimal id, bit by bit
  SELECT conv_id, own, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)),
    lambda crc, b: list_reduce([xor(crc, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 4 AS h
  FROM l
),
rebuilt AS (
  SELECT c.conv_id, coalesce(list_slice(b.own, 1, c.h), []) || list_slice(c.own, c.h + 1, len(c.own)) AS turns
  FROM c LEFT JOIN l b ON b.conv_id = c.conv_id - c.conv_id % 20
),
m AS (
  SELECT conv_id, d, len(turns) = d AS ends, array_to_string(list_transform(list_slice(turns, 1, d), lambda x: x.s), ' ') AS node,
    CASE WHEN d > 0 THEN array_to_string(list_transform(list_slice(turns, 1, d - 1), lambda x: x.s), ' ') END AS parent,
    CASE WHEN d > 0 THEN turns[d].w ELSE 0 END AS w
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)
),
n AS (
  SELECT node, d, parent, max(w) AS w, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM m GROUP BY ALL
),
kids AS (SELECT parent AS node, count(*) AS k FROM n WHERE d > 0 GROUP BY ALL),
path AS (SELECT a.node AS top, v.node, v.n_convs, v.w, kids.k FROM n v JOIN m ON m.conv_id = v.conv_id AND m.d <= v.d
         JOIN n a ON a.node = m.node LEFT JOIN kids ON kids.node = v.node),
sums AS (SELECT top, count(*) FILTER (WHERE k IS NULL) AS n_leaves, sum((n_convs - 1) * w) AS saved FROM path GROUP BY top)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.k, 0) AS n_children,
  sums.n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN sums ON sums.top = n.node LEFT JOIN kids ON kids.node = n.node LEFT JOIN n p ON p.node = n.parent"""

_AUDIT = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS l, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
lab AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CAST(len(l) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(l)) < 65 * len(l) AS INT)
    + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS INT)
    + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(w.doc_id > least, false) AS INT) AS fails
  FROM w LEFT JOIN lab ON lab.doc_id = w.doc_id
),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS x FROM f GROUP BY ALL),
a AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS o FROM a, a b, a c, a d, a e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5
),
s AS (
  SELECT o, step, 1 << (strpos('ABCDE', substr(o, step, 1)) - 1) AS bit,
    coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (strpos('ABCDE', substr(o, i, 1)) - 1))), 0)::INT AS before
  FROM (SELECT o, CAST(unnest(range(1, 6)) AS INT) AS step FROM o)
),
r AS (
  SELECT part, o, step, bit,
    sum(CASE WHEN fails & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN fails & before = 0 AND fails & bit <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails & before <> 0 AND fails & bit <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails & before = 0 AND fails & bit <> 0 THEN g ELSE 0 END) AS good_lost,
    sum(CASE WHEN fails & before = 0 AND fails & bit <> 0 THEN x ELSE 0 END) AS toxic_lost
  FROM m, s GROUP BY ALL
)
SELECT part, o AS filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r"""

#: DuckDB twins, where SQL can express the query.
ORACLES: dict[str, str] = {"op3_warc": _WARC, "op5_top_k": _TOP_K, "op6_trie_join": _JOIN, "op11_prefix_trie": _TRIE,
                           "op12_filter_audit": _AUDIT}
