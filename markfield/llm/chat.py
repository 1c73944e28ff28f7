"""Operator 2: chat formatting by prefix-target expansion (DataFrame functions only).

Every assistant turn becomes an example of its own, a row: the formatted text of all turns before it as context and of
itself, of which only its reply is trainable (the loss mask is loss_start and loss_length).  The expansion is quadratic in
a conversation's turns by its nature.  The query expands every conversation whole.  A caller can have conversations of over
`segment` formatted characters split between examples into segments of about that size (prefix_examples does so by default,
at SEGMENT); an example's row then holds its segment up to itself only: `skipped` characters, which are the text of the
rows that close the segments before, precede it.  Rows are made from a conversation's own row and are not shuffled.

A turn is written `<|turn|>role<|body|>text<|end|>`.  Control strings inside roles and texts (this template's own and
those of common templates) get a backslash after their first character, and a string that already looks like that
gets one more; `unescape` takes one away, so the round trip is exact and no text can end a turn.

Defined cases: null role or text is empty; null conv_id is a conversation of its own; null turn sorts first; equal
turn numbers are ordered by role, then text, and repeated rows are all kept; turns after the last assistant turn (or a
conversation without one) form a last row without target; an empty table gives an empty result; other columns are
ignored, whatever their names.  A conversation is one row between the stages, so it has to fit in a row (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from markfield.llm.shared import let, table

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: Formatted characters up to which a conversation is expanded whole; beyond any conversation.
SEGMENT, WHOLE = 1 << 20, 1 << 62
#: Control strings after their first character; `<` or `[` stands before.
_TAIL = r"/?s>|/?INST\]|\|(?:turn|body|end|im_start|im_end|endoftext|startoftext)\|>"
ESCAPE = r"([<\[])(\\*)(" + _TAIL + ")"
UNESCAPE = r"([<\[])(\\*)\\(" + _TAIL + ")"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(ESCAPE), F.lit(r"$1$2\\$3"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(UNESCAPE), F.lit("$1$2$3"))


def prefix_examples(conversations: DataFrame, target_role: str = "assistant", segment: int = SEGMENT) -> DataFrame:
    """One row an example: conv_id, example int (from 0), text string (context and target), loss_start long and
    loss_length long (code points of text under the loss mask; null and 0 without a target), skipped long (formatted
    characters of earlier segments, 0 for conversations of one), closes boolean (the last row of its segment)."""
    turns = conversations.select(
        F.col("conv_id").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("said"),
    )
    place = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role"), F.col("said"))
    upto, before = (place.rowsBetween(Window.unboundedPreceding, x) for x in (Window.currentRow, -1))
    body = escape(F.col("said"))
    turns = turns.select("conv_id", "turn", "role", "said", (F.col("role") == target_role).alias("target"), F.char_length(body).cast("long").alias("body_chars"), F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY), body, F.lit(END)).alias("text"))
    opens = F.coalesce(F.lag("target").over(place), F.lit(True))  # the first turn of an example
    start = F.coalesce(F.sum(F.char_length("text").cast("long")).over(before), F.lit(0))
    turns = turns.select("*", F.row_number().over(place).alias("at"), start.alias("start"), F.when(opens, start).alias("opened"))
    turns = turns.select("*", F.floor(F.max("opened").over(upto) / segment).alias("seg"))
    new = ~F.lag("seg").over(place).eqNullSafe(F.col("seg"))
    turns = turns.select("*", F.max(F.when(new, F.col("at"))).over(upto).alias("first"), F.max(F.when(new, F.col("start"))).over(upto).alias("skipped"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "first", "skipped", "target", "body_chars", "text"))).alias("parts"))
    ends = F.filter("parts", lambda p: p["target"] | (p["at"] == F.size("parts")))
    ends = F.transform(ends, lambda p: F.struct(p["at"].alias("at"), p["first"].alias("first"), p["skipped"].alias("skipped"), p["target"].alias("target"), p["body_chars"].alias("chars")))
    closing = let(ends, lambda e: F.transform(e, lambda p, i: F.struct(p.alias("p"), (~F.get(e, i + 1)["first"].eqNullSafe(p["first"])).alias("closes"))))
    each = rows.select("conv_id", F.transform("parts", lambda p: p["text"]).alias("texts"), F.posexplode(closing).alias("example", "e"))
    each = each.select("conv_id", "example", F.array_join(F.slice("texts", F.col("e.p.first"), F.col("e.p.at") - F.col("e.p.first") + 1), "").alias("text"), "e.p.target", "e.p.chars", "e.p.skipped", "e.closes")
    return each.select(
        "conv_id", "example", "text",
        F.when(F.col("target"), F.char_length("text") - len(END) - F.col("chars")).alias("loss_start"),
        F.when(F.col("target"), F.col("chars")).otherwise(F.lit(0)).alias("loss_length"),
        "skipped", "closes",
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation: conv_id, turns array<struct<role, text>>, loss_text string, formatted_chars long (of the
    conversation), n_examples long, example_chars long (of all rows), all parsed from the formatted output."""
    masked = F.when(F.col("loss_start").isNotNull(), F.substring(F.col("text"), (F.col("loss_start") + 1).cast("int"), F.col("loss_length").cast("int")))
    each = examples.select("conv_id", "example", masked.alias("loss"), F.when(F.col("closes"), F.col("text")).alias("segment"), F.char_length("text").cast("long").alias("chars"))
    whole = each.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("example", "loss", "segment"))).alias("rows"), F.sum("chars").alias("example_chars"))
    text = F.array_join(F.transform("rows", lambda r: r["segment"]), "")
    blocks = let(F.split(text, F.lit(r"<\|end\|>")), lambda marked: F.slice(marked, F.lit(1), F.size(marked) - 1))

    def turn(block: Column) -> Column:
        role = F.substring_index(F.substring(block, len(TURN) + 1, 2**31 - 1), BODY, 1)
        said = F.substring(block, F.locate(BODY, block) + len(BODY), F.lit(2**31 - 1))
        return F.struct(unescape(role).alias("role"), unescape(said).alias("text"))

    masks = F.filter("rows", lambda r: r["loss"].isNotNull())
    return whole.select(
        "conv_id",
        F.transform(blocks, turn).alias("turns"),
        F.array_join(F.transform(masks, lambda r: unescape(r["loss"])), "").alias("loss_text"),
        F.char_length(text).cast("long").alias("formatted_chars"),
        F.size(masks).cast("long").alias("n_examples"),
        "example_chars",
    )


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.sql(
        "select -7L as conv_id, stack(2, 0L, 'user', '</s>[INST] ok [/INST]', 1L, 'assistant', '</s>[INST] ok [/INST]')"
        " as (turn, role, text)"
    )
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    back = read_back(prefix_examples(told, segment=WHOLE))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
        "example_chars",
    )


OP2_SQL = rf"""
with told as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
),
sized as (select *, role = 'assistant' as target, {len(TURN) + len(BODY) + len(END)} + length(regexp_replace(role, '{ESCAPE}', '\1\2\\\3', 'g')) + length(regexp_replace(text, '{ESCAPE}', '\1\2\\\3', 'g')) as chars from told),
run as (select *, sum(chars) over w as upto, row_number() over w = count(*) over (partition by conv_id) as last from sized window w as (partition by conv_id order by turn nulls first, role, text rows unbounded preceding))
select conv_id,
  count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (target), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (target), '')) as loss_sha256,
  cast(sum(chars) as bigint) as formatted_chars,
  count(*) filter (target) as n_examples,
  cast(sum(upto) filter (target or last) as bigint) as example_chars
from run group by conv_id
"""
