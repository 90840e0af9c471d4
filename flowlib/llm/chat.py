"""Chat formatting by rotating the perspective: every participant once as the assistant, all others as named users.

A conversation with p participants gives p renderings of the same turns. In each, the turns of the chosen speaker
are the assistant's and carry the loss mask; every other speaker is a user with a name; turns of context roles
(``system``) stay as they are in every rendering. A turn is ``<|role|>`` or ``<|user name=NAME|>``, a line break, the
text, ``<|end|>`` and a line break. ``<|`` inside a text or name becomes ``< |``, so that no turn can forge a marker.
The mask is a list of character spans ``start-end`` that cover the assistant's texts with their end markers.

Conversations of any length: turns are rendered in parts of ``part_turns`` turn numbers, a row per (conversation,
perspective, part). A part is bounded in turn numbers, not in turns: those that tie are in one part, and so in one row. Rows that are the same in conv_id, turn, role and text are
one turn, whatever their number.

Defined results: a null role is the speaker ``unknown``, a null text is empty, a null turn comes last and is in a part
of its own (null); turns of equal number are ordered by role, then text; null is a conversation id like any other;
a conversation of context turns alone has no perspective and so no row; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT_ROLES = ("system",)
PART_TURNS = 256


def _safe(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def perspectives(conversations: DataFrame, context_roles: tuple[str, ...] = CONTEXT_ROLES, part_turns: int = PART_TURNS) -> DataFrame:
    """Rows (conv_id, perspective, part, n_turns, n_masked_turns, rendered, mask, n_masked_chars)."""
    role = F.coalesce(F.col("role"), F.lit("unknown"))
    turns = conversations.select("conv_id", "turn", role.alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    part = F.floor(F.col("turn") / part_turns).cast("bigint")
    ordered = F.array_sort(F.collect_list(F.struct(F.col("turn"), F.col("role"), F.col("text"))))
    parts = turns.groupBy("conv_id", part.alias("part")).agg(ordered.alias("turns"))
    speakers = turns.where(~F.col("role").isin(*context_roles)).select(F.col("conv_id").alias("c"), F.col("role").alias("perspective")).distinct()
    rows = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("c")))

    def piece(turn: Column) -> Column:
        who = turn["role"]
        own = who == F.col("perspective")
        head = (
            F.when(own, F.lit("<|assistant|>\n"))
            .when(who.isin(*context_roles), F.concat(F.lit("<|"), who, F.lit("|>\n")))
            .otherwise(F.concat(F.lit("<|user name="), _safe(who), F.lit("|>\n")))
        )
        body = F.concat(_safe(turn["text"]), F.lit("<|end|>\n"))
        return F.struct(own.alias("own"), head.alias("head"), body.alias("body"))

    def place(state: Column, turn: Column) -> Column:
        start = state["at"] + F.length(turn["head"])
        end = start + F.length(turn["body"])
        # The line break after the end marker isn't the speaker's.
        span = F.struct(start.alias("start"), (end - 1).alias("end"))
        return F.struct(end.alias("at"), F.when(turn["own"], F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    nothing = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))
    rendered = rows.withColumn("pieces", F.transform("turns", piece))
    rendered = rendered.withColumn("spans", F.aggregate("pieces", nothing, place)["spans"])
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "")
    mask = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    masked = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + (s["end"] - s["start"]))
    return rendered.select(
        "conv_id",
        "perspective",
        "part",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.size("spans").cast("bigint").alias("n_masked_turns"),
        text.alias("rendered"),
        mask.alias("mask"),
        masked.alias("n_masked_chars"),
    )


SQL = """
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, CAST(floor(turn / 256) AS BIGINT) AS part
  FROM conversations),
speakers AS (
  SELECT DISTINCT conv_id, role AS perspective FROM turns WHERE role <> 'system'),
pieces AS (
  SELECT t.conv_id, s.perspective, t.part, t.turn, t.role, t.text, t.role = s.perspective AS own,
         CASE WHEN t.role = s.perspective THEN '<|assistant|>' || chr(10) WHEN t.role = 'system' THEN '<|system|>' || chr(10)
              ELSE '<|user name=' || replace(t.role, '<|', '< |') || '|>' || chr(10) END AS head,
         replace(t.text, '<|', '< |') || '<|end|>' || chr(10) AS body
  FROM turns t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
placed AS (
  SELECT *, CAST(coalesce(sum(length(head) + length(body)) OVER (
             PARTITION BY conv_id, perspective, part ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) + length(head) AS start
  FROM pieces)
SELECT conv_id, perspective, part, count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_masked_turns,
       string_agg(head || body, '' ORDER BY turn, role, text) AS rendered,
       coalesce(string_agg(start || '-' || (start + length(body) - 1), ',' ORDER BY turn, role, text) FILTER (WHERE own), '') AS mask,
       CAST(coalesce(sum(length(body) - 1) FILTER (WHERE own), 0) AS BIGINT) AS n_masked_chars
FROM placed GROUP BY conv_id, perspective, part
"""
