"""Chat-table operators (G1-G5): requests out, replies in.

All row-local expressions except the per-conversation picks, which are
grouped aggregates (``min_by``) with map-side partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlstrata.functions import patterns as P
from sqlstrata.functions.text import strip_ws
from sqlstrata.plans.skew import salted_join

SYSTEM_PROMPT = ("Convert Oracle SQL to Spark SQL. Return only the converted SQL. "
                 "Leave every <<...>> placeholder unchanged.")
USER_PREFIX = "Convert the following SQL to Spark SQL: "
FULL_MESSAGE = "FULL_MESSAGE"
UNKNOWN = "Unknown"

_MSG = "array<struct<role:string,content:string>>"


def build_messages(df: DataFrame, content_col: str = "content", system: str = SYSTEM_PROMPT,
                   prefix: str = USER_PREFIX) -> DataFrame:
    """G1: add ``messages`` = [system, user(prefix + content)]."""
    msgs = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
                   F.struct(F.lit("user").alias("role"),
                            F.concat(F.lit(prefix), F.col(content_col)).alias("content")))
    return df.withColumn("messages", msgs.cast(_MSG))


def first_reply(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, reply`` -- the first assistant message per conversation."""
    a = conversations.filter(F.col("role") == "assistant")
    return (a.groupBy("conv_id")
             .agg(F.min("turn").alias("turn"), F.min_by("text", "turn").alias("reply")))


_ITEM = rf"(?:{P.HEADING_PATTERN})|(?:{P.FENCE_PATTERN})"


def reply_sections_expr(message: Column, items: Column) -> Column:
    """G3 per row: ``array<struct<k, section, sql>>``: each fenced ```sql block
    with the nearest heading before it (``Unknown`` if none), then the whole
    message as ``FULL_MESSAGE``. ``items`` must be a column holding
    ``message_items(message)`` (computed once: expressions inside a lambda
    are not shared, so an inline regex would run again per item)."""
    idx = F.sequence(F.lit(0), F.size(items) - 1)

    def one(i):
        x = F.element_at(items, i + 1)
        before = F.filter(F.slice(items, 1, i), lambda h: h.startswith("##"))
        head = F.try_element_at(before, F.lit(-1))
        name = F.coalesce(strip_ws(F.regexp_extract(head, P.HEADING_PATTERN, 1)), F.lit(UNKNOWN))
        return F.struct(i.alias("k"), name.alias("section"),
                        strip_ws(F.regexp_extract(x, P.FENCE_PATTERN, 1)).alias("sql"),
                        (~x.startswith("##")).alias("fence"))

    blocks = F.filter(F.transform(F.when(F.size(items) > 0, idx).otherwise(F.array().cast("array<int>")), one),
                      lambda s: s["fence"])
    blocks = F.transform(blocks, lambda s: F.struct(s["k"], s["section"], s["sql"]))
    full = F.struct(F.size(items).alias("k"), F.lit(FULL_MESSAGE).alias("section"),
                    strip_ws(message).alias("sql"))
    return F.concat(blocks, F.array(full))


def message_items(message: Column) -> Column:
    """Headings and fenced blocks of a message, in order."""
    return F.regexp_extract_all(message, F.lit(_ITEM), 0)


def reply_sections(df: DataFrame, message_col: str, keys: list[str]) -> DataFrame:
    """One row per block: ``keys..., k, section, sql``."""
    it = df.select(*keys, F.col(message_col).alias("_msg"), message_items(F.col(message_col)).alias("_it"))
    return it.select(*keys, F.inline(reply_sections_expr(F.col("_msg"), F.col("_it"))))


def wrap_reply(conversations: DataFrame) -> DataFrame:
    """Fenced replies built from assistant turns (the test tables hold prose,
    no code fences): some start with an un-headed block."""
    t = F.col("text")
    reply = F.concat(
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit("```sql\n"), t, F.lit("\n```\n"))).otherwise(F.lit("")),
        F.lit("## Query as given:\n```sql\n"), t, F.lit("\n```\n"),
        F.lit("## Query for the new engine :\n```SQL\n"), t, F.lit("\n```\nDone."))
    return (conversations.filter(F.col("role") == "assistant")
            .select("conv_id", "turn", reply.alias("reply")))


def few_shot_text(log: DataFrame) -> DataFrame:
    """Per query, its converted subqueries formatted as examples, in
    order: ``query_id, n_examples, examples``."""
    num = F.regexp_extract("identifier", r"_(\d+)$", 1).try_cast("long")
    ex = log.filter((F.col("type") == "subquery") & (F.coalesce("converted_content", F.lit("")) != ""))
    item = F.struct("section_id", num.alias("n"), F.concat(
        F.lit("Oracle:\n"), F.col("content"), F.lit("\nSpark SQL:\n"), F.col("converted_content")).alias("t"))
    return (ex.groupBy("query_id")
              .agg(F.count(F.lit(1)).alias("n_examples"),
                   F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]),
                                "\n\n").alias("examples")))


def eval_messages(conversations: DataFrame) -> DataFrame:
    """G5, flat: ``conv_id, turn, role, content, expected_response`` -- one row
    per input message (the turns before the first assistant reply), each
    with that reply. A conversation is never gathered into one row, and the
    join to its reply is salted by turn, so a conversation holding a large share
    of all turns stays spread out."""
    first = first_reply(conversations).select("conv_id", F.col("turn").alias("_t"), "reply")
    return (salted_join(conversations, first, ["conv_id"], ["turn"])
            .filter(F.col("turn") < F.col("_t"))
            .select("conv_id", "turn", "role", F.col("text").alias("content"),
                    F.col("reply").alias("expected_response")))


def eval_rows(conversations: DataFrame) -> DataFrame:
    """G5, nested as the evaluation format wants it:
    ``conv_id, inputs struct<messages>, expected_response``. Use only where a
    conversation's prompt is known to be small (it becomes one row);
    ``eval_messages`` is the scalable form."""
    m = eval_messages(conversations)
    before = (m.groupBy("conv_id")
               .agg(F.first("expected_response").alias("reply"),
                    F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("_m")))
    msgs = F.transform("_m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return before.select("conv_id", F.struct(msgs.alias("messages")).alias("inputs"),
                         F.col("reply").alias("expected_response"))
