"""Chat formatting with DataFrame and SQL functions only.

A conversation's turn structs are collected and sorted, adjacent turns of one role become one block, and blocks are joined:

    <|im_start|>role<|im_sep|>text<|im_sep|>text of the next turn of that role<|im_end|>

Control strings inside roles and texts are escaped reversibly: between ``<`` and ``|`` stands one backslash more than in
the original, so ``<|`` never occurs but in the template's own marks. ``loss`` lists the code points (start, length) that
carry loss: the texts of assistant turns.

Defined cases: null text or role is empty; a null conv_id is a conversation of its own; turns sort by turn, role, text,
nulls first, so repeated rows and ties have one order. A conversation is one string, so it must fit a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, text (the formatted conversation) and loss (array of start, length)."""
    clean = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # null text sorts before empty text, which makes no difference to the output
    out = turns.select("conv_id", clean.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    out = out.withColumn("starts", F.expr("filter(sequence(0, size(turns) - 1), i -> i = 0 or get(turns, i).role <> get(turns, i - 1).role)"))
    block = F.expr("transform(starts, (s, k) -> struct(get(turns, s).role as role, slice(turns, s + 1, coalesce(get(starts, k + 1), size(turns)) - s) as turns))")
    out = out.select("conv_id", block.alias("blocks"))
    parts = F.transform("blocks", lambda b: F.struct((b["role"] == "assistant").alias("learn"), F.concat(F.lit(START), escape(b["role"]), F.lit(SEP)).alias("head"), F.transform(b["turns"], lambda t: escape(t["text"])).alias("texts")))
    out = out.select("conv_id", parts.alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], F.array_join(p["texts"], SEP), F.lit(END))), "")
    sep, end = len(SEP), len(END)
    loss = F.expr(f"""
        aggregate(parts, struct(cast(0 as bigint) as at, cast(array() as array<struct<start: bigint, length: bigint>>) as spans),
            (acc, p) -> aggregate(p.texts, struct(acc.at + char_length(p.head) as at, acc.spans as spans),
                (a, t) -> struct(a.at + char_length(t) + {sep} as at,
                                 if(p.learn, array_append(a.spans, struct(a.at as start, cast(char_length(t) as bigint) as length)), a.spans) as spans),
                a -> struct(a.at - {sep} + {end} as at, a.spans as spans)),
            acc -> acc.spans)""")
    return out.select("conv_id", text.alias("text"), loss.alias("loss"))


def parse_conversations(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) read back from the formatted text, loss_text read back through the loss mask."""
    blocks = F.slice(F.split("text", r"<\|im_start\|>", -1), 2, F.size(F.split("text", r"<\|im_start\|>", -1)))
    out = formatted.withColumn("blocks", blocks)
    fields = F.transform("blocks", lambda b: F.split(F.substring(b, F.lit(1), F.char_length(b) - len(END)), r"<\|im_sep\|>", -1))
    out = out.withColumn("fields", fields)
    turns = F.flatten(F.transform("fields", lambda f: F.transform(F.slice(f, F.lit(2), F.size(f) - 1), lambda t: F.struct(unescape(F.get(f, F.lit(0))).alias("role"), unescape(t).alias("text")))))
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"].cast("int") + 1, s["length"].cast("int")))), "")
    return out.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), "text")


def digest(parsed: DataFrame) -> DataFrame:
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parsed.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("text").cast("long").alias("formatted_chars"))


#: The same in DuckDB, from the rows themselves; {turns} is a relation conv_id, turn, role, text.
SQL = r"""
with rows_ as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from {turns}),
marked as (
  select *, length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) as text_chars,
    length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) as role_chars,
    lag(role) over (partition by conv_id order by turn nulls first, role, text) is distinct from role
      or row_number() over (partition by conv_id order by turn nulls first, role, text) = 1 as opens
  from rows_)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(10 + text_chars + case when opens then 12 + 10 + role_chars else 0 end) as bigint) as formatted_chars
from marked group by conv_id"""
