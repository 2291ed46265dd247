"""Conversation tables: one row per message (conversation, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.operators.positions import with_next


def latest_prompt(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last message of each conversation, whatever its role."""
    return messages.groupBy(conversation).agg(
        F.coalesce(F.max_by("text", turn), F.lit("")).alias("question"),
        F.max(turn).alias("turn"),
    )


def history_pairs(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Messages paired by position, (0,1), (2,3) and so on; an odd last one is left out."""
    followed = with_next(messages, conversation, turn, ["text"])
    return followed.filter("position % 2 = 0 and next is not null").select(
        conversation,
        F.floor(F.col("position") / 2).alias("pair"),
        F.col("text").alias("question"),
        F.col("next.text").alias("answer"),
    )


def answered_turns(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Each user message that the assistant answers in the very next message."""
    followed = with_next(messages, conversation, turn, ["role", "text"])
    return followed.filter("role = 'user' and next.role = 'assistant'").select(
        conversation, turn, F.col("text").alias("question"), F.col("next.text").alias("answer")
    )


def reply_rows(
    answers: DataFrame, conversation: str = "conv_id", turn: str = "turn", answer: str = "answer"
) -> DataFrame:
    """Assistant messages that answer the given turns; the id is the same on every run."""
    key = F.concat_ws("/", F.col(conversation).cast("string"), F.col(turn).cast("string"))
    return answers.select(
        F.sha2(key, 256).alias("id"),
        conversation,
        (F.col(turn) + 1).alias("turn"),
        F.lit("assistant").alias("role"),
        F.col(answer).alias("content"),
    )
