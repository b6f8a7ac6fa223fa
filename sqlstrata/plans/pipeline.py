"""The whole job in stages (F6), as DataFrame compositions.

stage 1: decompose -> select lists -> tables / functions
stage 2: convert each piece (rules), errors as columns
stage 3: convert select lists chunk-wise, reassemble, append the final row

``run`` writes each stage's table before the next one reads it, which cuts
the lineage (a lost executor recomputes from the last written table, not
from the corpus). ``refresh`` keeps one log up to date and rewrites only the
partitions in which a text came, went or changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlstrata.operators import assemble as A
from sqlstrata.operators import convert as V
from sqlstrata.operators import decompose as D
from sqlstrata.operators import lineage as L
from sqlstrata.sources.corpus import corpus_from_dir, distinct_texts


def stage1(corpus: DataFrame) -> DataFrame:
    """Decompose with select lists, in one scan of each text, then tables and
    functions: all row-local, without an exchange."""
    log = D.decompose_log(corpus, select_lists=True)
    return L.with_functions(L.with_tables(log))


def stage2(log1: DataFrame, rules=V.DEFAULT_RULES, full_refresh: bool = True) -> DataFrame:
    return V.convert_log(log1, rules, full_refresh).drop("status")


def stage3(log2: DataFrame, rules=V.DEFAULT_RULES, full_refresh: bool = True) -> DataFrame:
    log3 = V.convert_columns(log2, rules, full_refresh)
    fin = A.final_row(log3)
    conv = F.when(F.col("type") == "final", F.col("final_query")).otherwise(F.col("converted_content"))
    return (fin.withColumn("tables", L.tables_expr(F.coalesce(conv, F.lit(""))))
               .withColumn("functions", L.functions_expr(F.coalesce(conv, F.lit("")),
                                                         F.col("converted_columns"))))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage1(corpus_from_dir(spark, sf_dir))


def run(spark: SparkSession, corpus: DataFrame, out_dir: str, total_stages: int = 3,
        rules=V.DEFAULT_RULES, full_refresh: bool = True,
        previous: str | None = None, tables: str | None = None, buckets: int = 200) -> DataFrame:
    """Run the stages, writing ``out_dir/stage{i}`` (parquet) after each; the
    next stage reads the written table (lineage cut, restartable). With ``tables``
    the stages are catalog tables of that prefix in ``buckets`` of ``query_id``: the first
    one is dealt out by it, and stages 2 and 3 shuffle nothing.

    Incremental mode (``full_refresh=False`` and ``previous``, the ``out_dir`` of
    the run before): queries whose text is unchanged keep their rows and
    conversions, queries that are new or changed are decomposed, and only rows
    without a conversion are converted; final rows are rebuilt, one per query.
    Texts are compared by hash (``out_dir/texts``).
    """
    from sqlstrata.sources.logstore import read_log, write_log

    corpus = distinct_texts(corpus)
    texts = corpus.select("query_id", D.text_key().alias("text_key"))
    texts.write.mode("overwrite").parquet(f"{out_dir}/texts")
    if full_refresh or previous is None:
        log1 = stage1(corpus)
    else:
        known = texts.alias("c").join(spark.read.parquet(f"{previous}/texts").alias("k"), _same_text("c", "k"), "left_semi")
        old = read_log(spark, f"{previous}/stage{total_stages}")
        old = old.filter(F.col("type") != "final").alias("o").join(known.alias("k"), _same_text("o", "k"), "left_semi")
        new_q = corpus.withColumn("text_key", D.text_key()).alias("c").join(known.alias("k"), _same_text("c", "k"), "left_anti")
        log1 = old.unionByName(stage1(new_q.select("query_id", "sql")).select(*old.columns))

    def stored(df: DataFrame, i: int) -> DataFrame:
        if not tables:
            write_log(df, f"{out_dir}/stage{i}")
            return read_log(spark, f"{out_dir}/stage{i}")
        write_log(df, f"{tables}_stage{i}", as_table=True, buckets=buckets, deal=i == 1)
        return read_log(spark, f"{tables}_stage{i}", as_table=True)

    log = stored(log1, 1)
    if total_stages >= 2:
        log = stored(stage2(log, rules, full_refresh), 2)
    if total_stages >= 3:
        log = stored(stage3(log, rules, full_refresh), 3)
    return log


#: Partitions of a refreshed log.
PARTS = 256
_TEXT = ["query_id", "text_key"]


def _with_part(df: DataFrame, parts: int) -> DataFrame:
    return df.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))


def _same_text(a: str, b: str) -> Column:
    return (F.col(f"{a}.text_key") == F.col(f"{b}.text_key")) & F.col(f"{a}.query_id").eqNullSafe(F.col(f"{b}.query_id"))


def refresh(spark: SparkSession, corpus: DataFrame, table: str, rules=V.DEFAULT_RULES, parts: int = PARTS) -> DataFrame:
    """Bring the log ``table`` (all stages, final rows included) up to date with ``corpus``.

    The log, ``{table}_texts``, the texts it covers, and ``{table}_names``, counts of the
    tables and functions of its pieces (``lineage.merged_counts`` adds them up), are
    partitioned by a hash of ``query_id``. Texts are compared by (id, hash). Only partitions in which a text came
    or went are read, converted where a row has no conversion yet, and overwritten;
    the files of all others stay as they are. Equal rows of the corpus count once."""
    from sqlstrata.session import materialize

    corpus = corpus.select("query_id", "sql").withColumn("text_key", D.text_key())
    texts = _with_part(corpus.select(*_TEXT).distinct(), parts)
    known = spark.catalog.tableExists(table)
    if known:
        both = texts.withColumn("_side", F.lit(1)).unionByName(spark.table(f"{table}_texts").withColumn("_side", F.lit(-1)))
        change = both.groupBy(*_TEXT, "part").agg(F.sum("_side").alias("_side")).filter("_side <> 0")
    else:
        change = texts.withColumn("_side", F.lit(1))
    change = materialize(change)
    touched = [r["part"] for r in change.select("part").distinct().collect()]  # at most ``parts``
    if known and not touched:
        return spark.table(table)
    fresh = corpus.alias("c").join(change.filter("_side > 0").alias("k"), _same_text("c", "k"), "left_semi").dropDuplicates(_TEXT)
    log = _with_part(stage1(fresh.select("query_id", "sql")), parts)
    if known:
        old = spark.table(table).filter(F.col("part").isin(touched) & (F.col("type") != "final")).alias("o")
        old = old.join(change.filter("_side < 0").alias("k"), _same_text("o", "k"), "left_anti")
        log = old.unionByName(log.select(*old.columns))
    done = stage3(stage2(log.drop("part"), rules, full_refresh=False), rules, full_refresh=False)
    done = materialize(_with_part(done, parts))  # before the files that it comes from are replaced
    left = {r["part"] for r in done.select("part").distinct().collect()}
    now = materialize(texts.filter(F.col("part").isin(touched)))
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(mode, "static")
    spark.conf.set(mode, "dynamic")
    try:
        names = L.counts_by_part(done.filter(F.col("type") != "final"))
        for name, rows, by in ((table, done, "query_id"), (f"{table}_texts", now, "query_id"), (f"{table}_names", names, "name")):
            rows = rows.repartitionByRange("part", by)
            if known:
                rows.select(*spark.table(name).columns).write.mode("overwrite").insertInto(name)
                for part in sorted(set(touched) - left):
                    spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION (part = {part})")
            else:
                rows.write.partitionBy("part").format("parquet").saveAsTable(name)
    finally:
        spark.conf.set(mode, before)
    return spark.table(table)
