"""Graphs of dialogs: what an answer's reference has is what was said before it.

The context of an answer is all earlier turns of its conversation, and the
first entities of that text are those that appear first in the conversation. So
a conversation has one list of first occurrences, of ``cap`` entities with the
turn of each, and the context's graph at a turn is that list up to the turn
before: a filter, and no text of earlier turns is put together again. What moves
of a turn is its own first entities, so the work is linear in turns.

Null texts say nothing; a conversation without an assistant's turn gives nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.text import first_tokens
from plumbline.operators.graph import MAX_ENTITIES, chained

#: Turns of a conversation that are numbered together.
PART_TURNS = 1024


def _own(text: Column, cap: int) -> Column:
    return first_tokens(F.coalesce(text, F.lit("")), cap)


def first_occurrences(turns: DataFrame, cap: int = MAX_ENTITIES) -> DataFrame:
    """(conv_id, heads): the ``cap`` entities that appear first in a conversation, in order, with their turn."""
    each = turns.select("conv_id", "turn", F.posexplode("own").alias("pos", "entity"))
    first = each.groupBy("conv_id", "entity").agg(F.min(F.struct("turn", "pos")).alias("at"))
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("at"))
    top = first.withColumn("rank", rank).filter(F.col("rank") <= cap)
    return top.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at.turn", "at.pos", "entity"))).alias("heads"))


def before(turns: DataFrame, value: Column, name: str, part_turns: int = PART_TURNS) -> DataFrame:
    """``turns`` with the last value that is not null of earlier turns, found within parts of
    a conversation, and carried on from part to part."""
    parted = turns.withColumns({"_value": value, "_part": F.floor(F.col("turn") / part_turns)})
    earlier = (Window.unboundedPreceding, -1)
    ends = parted.groupBy("conv_id", "_part").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("turn"))).alias("_end"))
    over = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(*earlier)
    carried = ends.select("conv_id", "_part", F.last("_end", ignorenulls=True).over(over).alias("_carried"))
    own = F.last("_value", ignorenulls=True).over(Window.partitionBy("conv_id", "_part").orderBy("turn").rowsBetween(*earlier))
    joined = parted.withColumn("_own", own).join(carried, ["conv_id", "_part"])
    return joined.withColumn(name, F.coalesce("_own", "_carried")).drop("_value", "_part", "_own", "_carried")


def dialog_graphs(turns: DataFrame, cap: int = MAX_ENTITIES) -> tuple[DataFrame, DataFrame]:
    """From (conv_id, turn, role, text): graphs of references (source_id, kind, entities, relations)
    and of the assistant's answers (response_id, source_id, entities, relations)."""
    said = turns.select("conv_id", "turn", "role", F.col("text").isNotNull().alias("said"), _own(F.col("text"), cap).alias("own"))
    asked = before(said, F.when((F.col("role") == "user") & F.col("said"), F.col("own")), "query")
    answers = asked.filter("role = 'assistant'").join(first_occurrences(said, cap), "conv_id", "left")
    none = F.array().cast("array<string>")
    context = F.transform(F.filter("heads", lambda h: h["turn"] < F.col("turn")), lambda h: h["entity"])
    named = answers.select(F.concat_ws("-", "conv_id", "turn").alias("source_id"), "own", F.coalesce(context, none).alias("context"), F.coalesce("query", none).alias("query"))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("entities")) for k in ("context", "query")))
    sources = named.select("source_id", F.explode(kinds).alias("x")).select("source_id", "x.kind", "x.entities")
    return sources.withColumn("relations", chained("entities")), named.select(F.col("source_id").alias("response_id"), "source_id", F.col("own").alias("entities"), chained("own").alias("relations"))
