"""Chat formatting: multi-party perspective rotation.

Every participant of a conversation gets a rendering in which it is the assistant, all others are named users
and only its own words carry loss. A rendering is a set of segments, one row per perspective and turn, in turn
order: a conversation of any length is never gathered in one task.

A mark is set apart by ``<|`` and ``|>``; where a name or a text holds one of these, a zero-width space goes between
its two characters, so that nobody's words can open or close a turn.

Defined cases: the speaker ``system`` is no participant and keeps its role in every rendering; a null speaker
is no participant and speaks as the user ``unknown``; a null text is empty and a null conversation id is a
conversation of its own; repeated rows stay repeated; turns of equal order keep that order, as in the input;
texts of any length are rendered whole; a conversation without participants has no rendering.
Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYSTEM = "system"
UNKNOWN = "unknown"


def _harmless(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<|"), F.lit("<\u200b|")), F.lit("|>"), F.lit("|\u200b>"))


def rotate_perspectives(turns: DataFrame, conversation: str = "conv_id", order: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """(conversation, perspective, order, chat_role, name, rendered, mask_start, mask_end, trained).

    ``rendered`` is the segment with its markup; [mask_start, mask_end) are the characters of it that carry
    loss: the content and the end mark of the assistant's segments, nothing of the others.
    """
    said = turns.select(
        F.col(conversation).alias("conversation"),
        F.col(order).alias("position"),
        F.coalesce(F.col(speaker), F.lit(UNKNOWN)).alias("speaker"),
        F.col(speaker).isNull().alias("anonymous"),
        F.coalesce(F.col(text), F.lit("")).alias("content"),
    )
    people = (
        said.where(~F.col("anonymous") & (F.col("speaker") != SYSTEM))
        .select(F.col("conversation").alias("of"), F.col("speaker").alias("perspective"))
        .distinct()
    )
    said = said.withColumn("content", _harmless(F.col("content"))).withColumn("shown", _harmless(F.regexp_replace("speaker", r"[\r\n]+", " ")))
    both = said.join(people, F.col("conversation").eqNullSafe(F.col("of")))
    own = ~F.col("anonymous") & (F.col("speaker") == F.col("perspective"))
    rules = (~F.col("anonymous")) & (F.col("speaker") == SYSTEM)
    role = F.when(own, "assistant").when(rules, SYSTEM).otherwise("user")
    head = F.when(own, "<|assistant|>\n").when(rules, "<|system|>\n").otherwise(F.concat(F.lit("<|user name="), F.col("shown"), F.lit("|>\n")))
    mark = "<|end|>"
    return both.select(
        F.col("conversation").alias(conversation),
        "perspective",
        F.col("position").alias(order),
        role.alias("chat_role"),
        F.when(~own & ~rules, F.col("speaker")).alias("name"),
        F.concat(head, F.col("content"), F.lit(mark + "\n")).alias("rendered"),
        F.when(own, F.length(head)).otherwise(0).cast("long").alias("mask_start"),
        F.when(own, F.length(head) + F.length("content") + len(mark)).otherwise(0).cast("long").alias("mask_end"),
        own.alias("trained"),
    )
