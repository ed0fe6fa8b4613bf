"""Chat formatting by prefix-target expansion: one training example for every assistant turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prefix_targets(turns: DataFrame) -> DataFrame:
    """(conv_id, target_turn, example_no, n_context, prompt, completion, train_from, train_to) of every assistant turn.

    The prompt holds all turns before the target in order, each as ``<|role|>`` line, text and a line end, and then the assistant's
    header; only the characters [train_from, train_to) of prompt || completion, the reply, are trainable. Turns are ordered by (turn, role,
    text), nulls first; repeated rows count once; rows without conversation or turn number are left out; a null text is
    empty and a null role is written as empty. An assistant turn without text gives no example but stays in the context of later ones.
    Other columns are ignored. One shuffle by conversation; a conversation is held in one row.
    """
    turn = F.struct(F.col("turn").alias("turn"), F.col("role").alias("role"), F.col("text").alias("text"))
    whole = turns.where("conv_id is not null and turn is not null").groupBy("conv_id").agg(F.sort_array(F.collect_set(turn)).alias("turns"))
    each = whole.select("conv_id", "turns", F.posexplode("turns").alias("at", "target")).where("target.role = 'assistant' and target.text <> ''")
    said = lambda t: F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("")), F.lit("|>\n"), F.coalesce(t["text"], F.lit("")), F.lit("\n"))
    prompt = F.concat(F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("at")), said), ""), F.lit("<|assistant|>\n"))
    made = each.select("conv_id", F.col("target.turn").alias("target_turn"), F.col("at").alias("example_no"), F.col("at").alias("n_context"), prompt.alias("prompt"), F.col("target.text").alias("completion"))
    return made.withColumns({"train_from": F.length("prompt"), "train_to": F.length("prompt") + F.length("completion")})


PREFIX_TARGETS_SQL = r"""
with turns as (
  select distinct conv_id, turn, role, text from conversations where conv_id is not null and turn is not null
), placed as (
  select *, row_number() over w - 1 as place,
         '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) as said
  from turns window w as (partition by conv_id order by turn, role nulls first, text nulls first)
), examples as (
  select conv_id, turn as target_turn, cast(place as int) as example_no, cast(place as int) as n_context, role, text as completion,
         coalesce(string_agg(said, '' order by place) over (partition by conv_id order by place rows between unbounded preceding and 1 preceding), '')
           || '<|assistant|>' || chr(10) as prompt
  from placed
)
select conv_id, target_turn, example_no, n_context, prompt, completion,
       cast(length(prompt) as int) as train_from, cast(length(prompt) + length(completion) as int) as train_to
from examples where role = 'assistant' and completion <> ''
"""
