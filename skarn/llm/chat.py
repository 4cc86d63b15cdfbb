"""Chat formatting: cumulative snapshots of a conversation collapse into the longest, which is rendered.

Logs often hold a conversation again after every turn. A conversation is dropped if its turns are
the first turns of a longer one, or if it equals one with a smaller conv_id. Every turn gets a rolling hash
of the conversation up to it (two running sums of position-salted hashes, 128 bits); a conversation whose
hash at its last turn is found among the hashes before other conversations' last turns is a prefix of one, so an
anti-join keeps the maximal ones. Only hashes are shuffled for this; the texts of the kept
conversations are shuffled once, to be rendered. Everything is DataFrame functions.

Defined results: turns are ordered by turn (nulls first), then by hash; a null role renders as ``unknown``, a null
text as empty, yet for collapsing they differ from those; rows with a null conv_id form one conversation;
markup in a text is broken with a space, so that it can't open or close a turn; repeated rows are turns of
their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed markers of a rendered turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _turn_hash(salt: int) -> Column:
    return F.xxhash64(F.lit(salt), F.col("role").isNull(), "role", F.col("text").isNull(), "text")


def _rendered() -> Column:
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("<|im_"), F.lit("<| im_"))
    return F.concat(F.lit(OPEN), F.coalesce("role", F.lit("unknown")), F.lit("\n"), text, F.lit(CLOSE + "\n"))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies): one of each conversation that is no proper prefix of another."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "a", "b")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hashed = turns.select("conv_id", "turn", _turn_hash(1).alias("a"), _turn_hash(2).alias("b"))
    placed = hashed.withColumns({"k": F.row_number().over(order).cast("long"), "last": F.lead(F.lit(1)).over(order).isNull()})
    rolled = placed.select("conv_id", "k", "last", *(F.sum(F.xxhash64("k", x).cast("decimal(20,0)")).over(so_far).alias(f"h{x}") for x in "ab"))
    whole = rolled.where("last").groupBy("k", "ha", "hb").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    begun = rolled.where("not last").select("k", "ha", "hb").distinct()
    return whole.join(begun, ["k", "ha", "hb"], "left_anti").select("conv_id", F.col("k").alias("n_turns"), "copies")


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies, rendered) of the maximal conversations."""
    kept = maximal_conversations(turns)
    row = F.struct(F.col("turn").alias("turn"), _turn_hash(1).alias("a"), _turn_hash(2).alias("b"), _rendered().alias("said"))
    shown = turns.select(F.col("conv_id").alias("of"), row.alias("row")).join(kept, F.col("of").eqNullSafe(F.col("conv_id")))
    lines = F.transform(F.array_sort(F.collect_list("row")), lambda x: x["said"])
    return shown.groupBy("conv_id", "n_turns", "copies").agg(F.array_join(lines, "").alias("rendered"))


ORACLE = r"""
WITH shown AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg('<|im_start|>' || role || chr(10) || replace(text, '<|im_', '<| im_') || '<|im_end|>' || chr(10), '' ORDER BY turn) AS rendered
  FROM conversations GROUP BY conv_id
), one AS (
  SELECT min(conv_id) AS conv_id, any_value(n_turns) AS n_turns, count(*) AS copies, rendered FROM shown GROUP BY rendered
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, CAST(copies AS BIGINT) AS copies, rendered FROM one a
WHERE NOT EXISTS (SELECT 1 FROM one b WHERE b.n_turns > a.n_turns AND starts_with(b.rendered, a.rendered))
"""
