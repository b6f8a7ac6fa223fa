"""Query corpora: read them (A1) or build them from table rows (A2).

``build_corpus`` turns every row of a source table into one SQL text, so the
corpus grows with the table. The text is one template rendered twice: as a
Spark Column (row-local, no shuffle) and as DuckDB SQL for the oracle. Both
renderings use only string concatenation, integer-to-string casts, modulo and
CASE, so the two engines produce byte-identical texts.

Each query mixes what the reference's fixtures contain: optional WITH block,
scalar subqueries in CASE, NVL over a scalar subquery, IN / EXISTS, nested
derived tables, custom functions (``calc_from``), Oracle-only constructs
(ROWNUM, VARCHAR2, SYSDATE, TO_DATE with 'YYYYMMDD'), comments and literals
that contain parentheses, keywords and comment markers, DISTINCT, and a
second set-operation branch. Every 97th row is left unbalanced on purpose.
Some keys give a 599-column query, twelve CTEs, CTEs with column lists, quoted
names or MATERIALIZED, branches and whole queries in parentheses, or a text of
comments or blanks only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlstrata.session import materialize


class _SparkR:
    """Render template pieces as Spark Columns."""

    def lit(self, s):
        return F.lit(s)

    def col(self, name):
        return F.col(name)

    def num(self, e):
        return e.cast("string")

    def num_lit(self, n):
        return F.lit(n).cast("bigint")

    def mod(self, e, k):
        return F.pmod(e, F.lit(k))

    def add(self, e, k):
        return e + F.lit(k)

    def mul(self, e, k):
        return e * F.lit(k)

    def concat(self, *parts):
        return F.concat(*parts)

    def case(self, key, branches, default):
        """``branches`` maps int -> piece; compared against ``key``."""
        out = None
        for k, v in branches.items():
            out = F.when(key == F.lit(k), v) if out is None else out.when(key == F.lit(k), v)
        return out.otherwise(default)

    def seq_join(self, n, fn, sep):
        return F.array_join(F.transform(F.sequence(F.lit(1), n.cast("int")), fn), sep)


class _DuckR:
    """Render template pieces as DuckDB SQL text."""

    def lit(self, s):
        return "'" + s.replace("'", "''") + "'"

    def col(self, name):
        return name

    def num(self, e):
        return f"CAST({e} AS VARCHAR)"

    def num_lit(self, n):
        return str(n)

    def mod(self, e, k):
        return f"((({e}) % {k}) + {k}) % {k}"

    def add(self, e, k):
        return f"({e} + {k})"

    def mul(self, e, k):
        return f"({e} * {k})"

    def concat(self, *parts):
        return "(" + " || ".join(parts) + ")"

    def case(self, key, branches, default):
        whens = " ".join(f"WHEN {key} = {k} THEN {v}" for k, v in branches.items())
        return f"(CASE {whens} ELSE {default} END)"

    def seq_join(self, n, fn, sep):
        return f"array_to_string(list_transform(range(1, {n} + 1), lambda i: {fn('i')}), {self.lit(sep)})"


NL = "\n"


def _column(r, k, s, i):
    """Generated select-list column number ``i`` of the query for part ``k``."""
    si = r.num(i)
    ci = r.concat(r.lit(" AS col"), si)
    kind = r.mod(_plus(r, k, r.mul(i, 5)), 12)
    literal = r.concat(r.lit("'col"), si, r.lit("'"), ci)
    return r.case(kind, {
        0: r.concat(r.lit("ROWNUM"), ci),
        1: r.concat(r.lit("CAST(p.p_retailprice AS NUMBER(10, 2)) || CAST(p.p_size AS VARCHAR)"), ci),
        2: r.concat(r.lit("'see ROWNUM and NVL( docs, col"), si, r.lit("'"), ci),
        3: r.concat(r.lit("CASE WHEN p.p_retailprice > (SELECT AVG(p_retailprice) FROM part "
                          "WHERE p_brand = p.p_brand) THEN 'above (avg)' ELSE 'below' END"), ci),
        4: r.concat(r.lit("NVL((SELECT MAX(l_quantity) FROM lineitem WHERE l_partkey = "
                          "p.p_partkey AND ROWNUM = 1), 0)"), ci),
        5: r.concat(r.lit("calc_from("), r.num(s), r.lit(" + "), si, r.lit(")"), ci),
        6: r.concat(r.lit("CAST(p.p_size AS VARCHAR2(20)) || TO_DATE('2024"),
                    r.num(r.add(r.mod(_plus(r, k, i), 9), 10)),
                    r.lit("01', 'YYYYMMDD')"), ci),
        7: r.concat(r.lit("COALESCE((SELECT MIN(o_totalprice) FROM orders WHERE o_orderkey IN "
                          "(SELECT l_orderkey FROM lineitem WHERE l_partkey = p.p_partkey)), 0)"), ci),
        8: r.concat(r.lit("NVL(p.p_type, 'n/a') || ' @ ' || SYSDATE"), ci),
        9: r.concat(r.lit("(SELECT COUNT(*) FROM (SELECT l_orderkey FROM lineitem WHERE l_partkey = "
                          "p.p_partkey GROUP BY l_orderkey) x)"), ci),
        10: r.concat(r.lit("(SELECT MAX(s.s_acctbal) FROM supplier s WHERE s.s_nationkey = "), si, r.lit(" AND ROWNUM = 1)"), ci),
        11: r.concat(r.lit("(SELECT COUNT(*) FROM orders o, customer c WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > "), si,
                     r.lit(")"), ci),
    }, literal)


def _plus(r, a, b):
    if isinstance(r, _SparkR):
        return a + b
    return f"({a} + {b})"


def corpus_text(r, k, name, brand, ptype, s):
    """The SQL text for one part row, rendered with ``r``."""
    ks = r.num(k)
    # every 499th query is a wide one
    ncols = r.case(r.mod(k, 499), {100: r.num_lit(599)}, r.add(r.mod(_plus(r, r.mul(k, 7), s), 9), 1))
    cols = r.seq_join(ncols, lambda i: _column(r, k, s, i), "," + NL + "    ")
    with_block = r.concat(
        r.lit("WITH brand_totals AS (" + NL
              + "    SELECT p_brand, SUM(p_retailprice) AS total_price, COUNT(*) AS n_parts" + NL
              + "    FROM part" + NL + "    WHERE p_size <= "), r.num(s),
        r.lit(" /* size cap ( */" + NL + "    GROUP BY p_brand" + NL + ")," + NL
              + "type_sizes AS (" + NL + "    SELECT p_type, MAX(p_size) AS max_size" + NL
              + "    FROM part" + NL
              + "    WHERE p_type IN (SELECT p_type FROM part WHERE p_brand = '"), brand,
        r.lit("')" + NL + "    GROUP BY p_type" + NL + ")" + NL))
    has_with = r.mod(k, 5)  # 0 -> no WITH block
    many = r.concat(r.lit("WITH brand_totals AS (SELECT p_brand FROM part), type_sizes AS MATERIALIZED (SELECT p_type FROM part)," + NL),
                    r.seq_join(r.num_lit(10), lambda i: r.concat(
                        r.lit("c"), r.num(i), r.lit(" AS (SELECT p_size, CASE WHEN EXISTS (SELECT 1 FROM lineitem) THEN "), r.num(i),
                        r.lit(" ELSE 0 END AS f FROM part ORDER BY p_size)")), "," + NL), r.lit(NL))
    named = r.concat(r.lit('WITH brand_totals (p_brand, total_price) AS NOT MATERIALIZED (SELECT p_brand, SUM(p_retailprice) FROM part '
                           'GROUP BY p_brand), "Type Sizes"(p_type) AS (SELECT p_type FROM part), type_sizes AS (SELECT p_type FROM '
                           '"Type Sizes" WHERE p_type <> \''), ptype, r.lit("')" + NL))
    head = r.case(has_with, {0: r.lit("")}, r.case(r.mod(k, 13), {4: many, 8: named}, with_block))
    joins = r.case(has_with, {0: r.lit(
        "FROM part p" + NL + "    JOIN supplier s ON p.p_partkey = s.s_suppkey" + NL)},
        r.lit("FROM part p" + NL + "    JOIN brand_totals b ON p.p_brand = b.p_brand" + NL
              + "    LEFT JOIN type_sizes t ON p.p_type = t.p_type" + NL))
    distinct = r.case(r.mod(k, 7), {0: r.lit("DISTINCT ")}, r.lit(""))
    # every 97th query misses the closing parenthesis of its EXISTS subquery
    exists_close = r.case(r.mod(k, 97), {13: r.lit("")}, r.lit(")"))
    setop = r.case(r.mod(k, 6), {
        0: r.lit("UNION ALL"), 1: r.lit("UNION"), 2: r.lit("INTERSECT"),
        3: r.lit("EXCEPT"), 4: r.lit("MINUS"), 5: r.lit("union" + NL + "  all")}, r.lit(""))
    branch = r.concat(
        setop, r.lit(NL + "SELECT NULL AS p_partkey, UPPER(p_brand) AS part_name, "
                     "NVL((SELECT MAX(p_size) FROM part WHERE p_type = '"), ptype,
        r.lit("'), 0) AS col1" + NL + "FROM part" + NL + "WHERE p_size = "), r.num(s), r.lit(NL))
    # some branches stand in parentheses
    closed = r.concat(setop, r.lit(NL + "(SELECT p_partkey, p_name FROM part WHERE p_brand = '"), brand,
                      r.lit("' AND p_size IN (SELECT p_size FROM part))" + NL))
    tail = r.case(r.mod(k, 3), {0: r.lit("")}, r.case(r.mod(k, 11), {5: closed}, branch))
    text = r.concat(
        r.lit("-- generated query "), ks, r.lit(" for "), brand, r.lit(" (see 'notes' --)" + NL),
        head,
        r.lit("SELECT "), distinct, r.lit("p.p_partkey," + NL + "    UPPER(p.p_name) AS part_name," + NL
                                          + "    "), cols, r.lit(NL),
        joins,
        r.lit("WHERE p.p_size IN (SELECT p_size FROM part WHERE p_type = '"), ptype,
        r.lit("' AND p_name <> 'it''s (select) -- x')" + NL
              + "  AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey"),
        exists_close, r.lit(NL),
        tail)
    # a query in parentheses, and texts without code
    return r.case(r.mod(k, 89), {7: r.concat(r.lit("-- nothing for "), ks), 11: r.lit("  " + NL), 17: r.concat(
        r.lit("(SELECT p_name FROM part WHERE p_size = "), r.num(s), r.lit(") UNION ALL (SELECT s_name FROM supplier)"))}, text)


#: Columns that the template takes from a source table: key, name, two texts, a small number.
SOURCES = {
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size"),
    "customer": ("c_custkey", "c_name", "c_mktsegment", "c_mktsegment", "c_nationkey"),
}


def build_corpus(rows: DataFrame, source: str = "part") -> DataFrame:
    """A2: one query per row of ``part`` or ``customer``: ``(query_id BIGINT, sql STRING)``."""
    key, *rest = (F.col(c).cast("bigint") if i in (0, 4) else F.col(c) for i, c in enumerate(SOURCES[source]))
    return rows.select(key.alias("query_id"), corpus_text(_SparkR(), key, *rest).alias("sql"))


def corpus_sql_duckdb(source: str = "part") -> str:
    """The same corpus as a DuckDB SELECT (used inside every oracle)."""
    key, *rest = SOURCES[source]
    return f"SELECT CAST({key} AS BIGINT) AS query_id, {corpus_text(_DuckR(), key, *rest)} AS sql FROM {source}"


def read_corpus(spark: SparkSession, path: str, fmt: str = "parquet",
                id_col: str = "query_id", sql_col: str = "sql") -> DataFrame:
    """A1: read a corpus.

    ``fmt='parquet'`` (or any table format) expects ``(query_id, sql)``
    columns. ``fmt='text'`` reads every file as one query (whole text) and
    derives a stable ``query_id`` from the file path.
    """
    if fmt == "text":
        df = spark.read.text(path, wholetext=True)
        return df.select(F.xxhash64(F.input_file_name()).alias("query_id"),
                         F.col("value").alias("sql"))
    df = spark.read.format(fmt).load(path)
    return df.select(F.col(id_col).cast("bigint").alias("query_id"), F.col(sql_col).alias("sql"))


def distinct_texts(corpus: DataFrame) -> DataFrame:
    """The corpus with equal rows (id and text) once. Different texts under one id, or
    without an id, all stay: ``text_key`` keeps them apart later on. Keys are
    counted first, and only rows whose key repeats are shuffled with their text."""
    keys = ["query_id", "text_key"]
    keyed = corpus.withColumn("text_key", F.xxhash64("sql"))
    twice = materialize(keyed.groupBy(*keys).count().filter("count > 1").select(*keys))
    if twice.isEmpty():
        return corpus
    same = (F.col("c.text_key") == F.col("t.text_key")) & F.col("c.query_id").eqNullSafe(F.col("t.query_id"))
    keyed, twice = keyed.alias("c"), twice.alias("t")
    once = keyed.join(twice, same, "left_semi").dropDuplicates(["query_id", "sql"])
    return keyed.join(twice, same, "left_anti").unionByName(once).select(*corpus.columns)


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus_from_dir(spark: SparkSession, sf_dir: str, source: str = "part") -> DataFrame:
    """The corpus of a table in ``sf_dir``. A row gives a text of 10 to 500 times its
    size, so the narrow rows are dealt out before texts are built, into the session's
    number of shuffle partitions (an explicit number: adaptive execution would see
    little data and join the parts)."""
    rows = load_table(spark, sf_dir, source).select(*dict.fromkeys(SOURCES[source]))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return build_corpus(rows.repartition(parts, SOURCES[source][0]), source)
