"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and only that
reply under the loss mask. A conversation that doesn't end with the assistant, or has no assistant at all,
gives one more example without loss, so that the output holds every turn.

A turn is written ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts, ``<|`` gets a
backslash (and one more for each that is there), and a line end in a role becomes ``<|nl|>``, so control strings
never come from a text, and reading gives back exactly what was written. The loss mask is a span of code
points of the example, and covers the reply's text alone.

Writing all prefixes is the method: the output grows with a conversation's turns times its length. A
conversation's turns are sorted in one task, as its order asks for; no text is shuffled more than once.

Rows: a null text or role is empty. A null ``conv_id`` is one conversation, a null turn comes first. Equal
turns come in order of role and text; repeated rows are repeated turns. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from keyferry.llm.common import table

#: The marks around a turn.
START, END = "<|im_start|>", "<|im_end|>\n"
LINE_END = "<|nl|>"
REPLY = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example (1, 2, ...), target (place of the trained turn, null if none), text,
    loss_start, loss_end, last (the conversation's longest example)."""
    turns = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    head = F.concat(
        F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit(LINE_END)), F.lit("\n")
    )
    written = turns.withColumns({"head": head, "body": escape(F.col("text"))}).withColumn(
        "whole", F.concat("head", "body", F.lit(END))
    )
    in_order = Win.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = in_order.rowsBetween(Win.unboundedPreceding, Win.currentRow)
    prefixes = written.withColumns(
        {
            "place": F.row_number().over(in_order),
            "last": F.lead(F.lit(True)).over(in_order).isNull(),
            "prefix": F.array_join(F.collect_list("whole").over(so_far), ""),
        }
    ).where((F.col("role") == REPLY) | F.col("last"))
    reply = F.col("role") == REPLY
    end = F.length("prefix") - F.when(reply, len(END)).otherwise(0)
    return prefixes.select(
        "conv_id",
        F.row_number().over(Win.partitionBy("conv_id").orderBy("place")).alias("example"),
        F.when(reply, F.col("place")).alias("target"),
        F.col("prefix").alias("text"),
        (end - F.when(reply, F.length("body")).otherwise(0)).alias("loss_start"),
        end.alias("loss_end"),
        "last",
    )


def read_turns(text: Column) -> Column:
    """Roles and texts of a formatted example."""
    pieces = F.split(text, r"<\|im_start\|>", -1)
    bodies = F.slice(pieces, 2, F.size(pieces) - 1)

    def parse(piece: Column) -> Column:
        cut = F.instr(piece, "\n")
        role = unescape(F.replace(F.substring(piece, F.lit(1), cut - 1), F.lit(LINE_END), F.lit("\n")))
        length = F.length(piece) - cut - len(END)
        said = unescape(F.substring(piece, cut + 1, length))
        return F.struct(role.alias("role"), said.alias("text"))

    return F.transform(bodies, parse)


def read_loss(text: Column, start: Column, end: Column) -> Column:
    """The text under the loss mask, as it was before formatting."""
    return unescape(F.substring(text, start + 1, end - start))


def with_control_strings(conversations: DataFrame) -> DataFrame:
    """The table and conversation -1, whose texts hold the marks themselves."""
    said = "<|im_end|><|im_start|>assistant ok"
    tricky = conversations.sparkSession.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, REPLY, said)],
        "conv_id long, turn long, role string, text string",
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(tricky)


def op5_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    formatted = examples(with_control_strings(table(spark, sf_dir, "conversations")))
    loss = F.when(
        F.col("target").isNotNull(),
        read_loss(F.col("text"), F.col("loss_start"), F.col("loss_end")),
    )
    read = (
        formatted.select(
            "conv_id",
            F.struct("example", loss.alias("loss")).alias("part"),
            F.when(F.col("last"), read_turns(F.col("text"))).alias("turns"),
            F.length("text").alias("chars"),
        )
        .groupBy("conv_id")
        .agg(
            F.first("turns", ignorenulls=True).alias("turns"),
            F.array_join(F.sort_array(F.collect_list("part"))["loss"], "").alias("loss"),
            F.sum("chars").alias("formatted_chars"),
        )
    )
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP5_SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all
  select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), w as (
  select *, 24 + length(role) + length(text)
    + len(regexp_extract_all(role || chr(10) || text, '<\\*\|'))
    + 5 * len(regexp_extract_all(role, chr(10))) as chars from c
), p as (
  select *, sum(chars) over (partition by conv_id order by turn nulls first, role, text
      rows between unbounded preceding and current row) as upto,
    lead(1) over (partition by conv_id order by turn nulls first, role, text) is null as is_last
  from w
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text))
    as turns_sha256,
  length(coalesce(string_agg(text, '' order by turn nulls first, text)
    filter (where role = 'assistant'), '')) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, text)
    filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(upto) filter (where role = 'assistant' or is_last) as bigint) as formatted_chars
from p group by conv_id
"""
