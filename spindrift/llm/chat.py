"""Preference formatting of chat turns (DataFrame functions only).

Chosen and rejected conversations of a pair share their first turns. Those are
rendered once as the prompt; what follows is rendered as two completions, with the
character spans on which a loss is taken (the assistant's turns).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Every turn is OPEN, role, NEWLINE, text, CLOSE.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def rendered(turn: Column) -> Column:
    """One turn; a null role or text renders as empty."""
    return F.concat(F.lit(OPEN), F.coalesce(turn["role"], F.lit("")), F.lit("\n"), F.coalesce(turn["text"], F.lit("")), F.lit(CLOSE))


def _joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def _loss_spans(turns: Column) -> Column:
    """``start, end`` (code points, end exclusive) of the assistant's text with its end mark, in order."""
    none = F.from_json(F.lit("[]"), "array<struct<start:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def step(acc, t):
        head = F.length(F.lit(OPEN)) + F.length(F.coalesce(t["role"], F.lit(""))) + 1
        end = acc["at"] + F.length(rendered(t))
        span = F.struct((acc["at"] + head).cast("int").alias("start"), end.cast("int").alias("end"))
        taken = F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(end.cast("int").alias("at"), taken.alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def _conversations(turns: DataFrame, key: str, name: str) -> DataFrame:
    """One row per conversation with its turns in order (ties of the turn number: by role and text)."""
    turn = F.struct("turn", "role", "text")
    rows = turns.groupBy(F.col(key).alias("pair_id")).agg(F.array_sort(F.collect_list(turn)).alias(name))
    return rows.withColumn(name, F.transform(name, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


def format_preferences(chosen: DataFrame, rejected: DataFrame, key: str = "conv_id") -> DataFrame:
    """Pair two tables of turns (``key, turn, role, text``) by ``key`` and format each pair.

    Returns ``pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_loss, rejected_loss``.
    The prompt is the longest run of first turns that both sides have with equal role and
    text (nulls equal nulls); one side may be all prompt, and then its completion is empty.
    Keys that only one side has, and null keys, have no pair and are left out. Repeated rows
    are repeated turns. Other columns are not read. A row holds one pair: memory is bounded
    by the longest conversation, not by the number of conversations.
    """
    both = _conversations(chosen, key, "c").join(_conversations(rejected, key, "r"), "pair_id")
    shared = F.zip_with("c", "r", lambda a, b: a.eqNullSafe(b))
    at = F.array_position(shared, False)  # a side that has ended gives null, which differs from any turn
    n = F.when(at > 0, at - 1).otherwise(F.size("c")).cast("int")
    both = both.withColumn("n", n)
    rest = lambda side: F.slice(F.col(side), F.col("n") + 1, F.greatest(F.size(side) - F.col("n"), F.lit(0)))
    return both.select(
        "pair_id",
        F.col("n").alias("n_prompt_turns"),
        _joined(F.slice("c", F.lit(1), F.col("n"))).alias("prompt"),
        _joined(rest("c")).alias("chosen"),
        _joined(rest("r")).alias("rejected"),
        _loss_spans(rest("c")).alias("chosen_loss"),
        _loss_spans(rest("r")).alias("rejected_loss"),
    )


def swapped_answers(turns: DataFrame) -> DataFrame:
    """Rejected sides for the conversations at hand: the last assistant turn says what the next conversation's last one says.

    The next conversation is that of the following id; where there is none, the answer is
    empty. Conversations without an assistant turn come back as they are, and so do turns of a null id. Of assistant turns with the
    same, last number all are swapped, for the greatest text of the next; a null text is an empty answer. Repeated rows come back
    repeated; an empty table gives no rows; other columns are not read.
    """
    answers = turns.filter("role = 'assistant' and conv_id is not null").groupBy("conv_id").agg(
        F.max(F.struct("turn", "text")).alias("last")
    )
    mine = answers.select(F.col("conv_id").alias("m_id"), F.col("last.turn").alias("m_turn"))
    next_ = answers.select((F.col("conv_id") - 1).alias("n_id"), F.col("last.text").alias("n_text"))
    mine = mine.join(next_, F.col("m_id") == F.col("n_id"), "left").select("m_id", "m_turn", "n_text")
    joined = turns.select("conv_id", "turn", "role", "text").join(mine, F.col("conv_id") == F.col("m_id"), "left")
    swap = (F.col("turn") == F.col("m_turn")) & (F.col("role") == "assistant")
    return joined.select(
        "conv_id", "turn", "role", F.when(swap, F.coalesce("n_text", F.lit(""))).otherwise(F.col("text")).alias("text")
    )
