r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only its reply is under the
loss mask. A conversation that does not end with the assistant also gives an open example of all its turns without a
target, so no turn is lost.

Template: ``<|turn|>role<|text|>text<|end|>`` for each turn. Inside roles and texts a backslash is doubled, and a single
backslash is put behind the first character of any control string (``<|`` as well as ``<s> </s> [INST] [/INST]`` of
other templates); ``unescape`` takes both back exactly.

Defined cases: null text and null role are empty; a null conv_id is a conversation of its own; turns with the same (or a
null) number are ordered by role and text, nulls first; repeated rows are repeated turns; very long texts stay whole;
columns other than conv_id, turn, role and text are not looked at; an empty table gives no examples. An example is one row and so holds one conversation; that is its meaning, not a grouping choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmentry.llm.common import read, text_or_empty

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
_ANGLE, _SQUARE = r"\||/?s>", r"/?INST\]"


def escape(column: Column) -> Column:
    doubled = F.replace(column, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, rf"(<(?={_ANGLE})|\[(?={_SQUARE}))", r"$1\\")


def unescape(column: Column) -> Column:
    plain = F.regexp_replace(column, rf"(?<=<)\\(?={_ANGLE})|(?<=\[)\\(?={_SQUARE})", "")
    return F.replace(plain, F.lit("\\\\"), F.lit("\\"))


def examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_chars): code points, null where the example has no target."""
    text = escape(text_or_empty())
    turns = conversations.select(
        "conv_id",
        F.struct(
            "turn",
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("raw"),
            F.concat(F.lit(TURN), escape(F.coalesce("role", F.lit(""))), F.lit(TEXT), text, F.lit(END)).alias("piece"),
            F.length(text).alias("chars"),
        ).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    whole = whole.select("conv_id", F.col("t.piece").alias("pieces"), F.col("t.role").alias("roles"), F.col("t.chars").alias("chars"))
    place = F.explode(
        F.filter(F.sequence(F.lit(1), F.size("pieces")), lambda i: (F.get(F.col("roles"), i - 1) == "assistant") | (i == F.size("pieces")))
    )
    each = whole.select("conv_id", "pieces", "roles", "chars", place.alias("example"))
    target = F.get("roles", F.col("example") - 1) == "assistant"
    chars = F.when(target, F.get("chars", F.col("example") - 1))
    return each.select(
        "conv_id", "example", F.array_join(F.slice("pieces", F.lit(1), F.col("example")), "").alias("formatted"), chars.alias("loss_chars")
    ).select(
        "conv_id", "example", "formatted",
        (F.length("formatted") - len(END) - F.col("loss_chars")).alias("loss_start"), "loss_chars",
    )


def parse(formatted: Column) -> Column:
    """An example's turns, as an array of (role, text)."""
    parts = F.filter(F.split(formatted, r"<\|end\|>"), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substring_index(F.substring(p, len(TURN) + 1, 2**31 - 1), TEXT, 1)).alias("role"),
            unescape(F.substring_index(p, TEXT, -1)).alias("text"),
        ),
    )


def op2_chat_format(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ok = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", ok), (-7, 1, "assistant", ok)], rows.schema))
    made = examples(rows)
    loss = unescape(F.col("formatted").substr(F.col("loss_start") + 1, F.col("loss_chars")))
    told = made.select(
        "conv_id",
        "example",
        F.length("formatted").cast("long").alias("chars"),
        F.when(F.col("loss_start").isNotNull(), F.struct("example", loss.alias("text"))).alias("loss"),
        "formatted",
    )
    # the longest example holds every turn; max_by keeps one example a conversation in each task
    read_back = told.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("formatted"),
        F.array_join(F.transform(F.array_sort(F.collect_list("loss")), lambda x: x["text"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    turns = read_back.select("*", parse(F.col("formatted")).alias("turns"))
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(line, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


ORACLE = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e as (select *, length(role) + length(text) + 23 + length(role || text) - length(replace(role || text, '\', ''))
             + len(regexp_extract_all(role, '<\||</?s>|\[/?INST\]')) + len(regexp_extract_all(text, '<\||</?s>|\[/?INST\]')) as chars
      from c),
p as (select *, sum(chars) over (partition by conv_id order by turn, role, text rows unbounded preceding) as upto,
             row_number() over (partition by conv_id order by turn desc, role desc, text desc) as back from e)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       coalesce(sum(upto) filter (role = 'assistant' or back = 1), 0)::bigint as formatted_chars
from p group by conv_id
"""
