"""Chat rendering of maximal conversations (DataFrame functions only).

A conversation that was logged again after each turn leaves snapshots, each a prefix
of the next.  Rolling hashes of turn prefixes find them: a conversation whose whole
hash is a proper prefix's hash of another one is left out by an anti-join, and so are
all but the smallest conv_id of equal ones.  The rest are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Markers around each rendered turn.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def _turn(role: Column, text: Column) -> Column:
    """A turn's text with its role's length before it, so that no two turns read the same."""
    return F.concat(F.length(role).cast("string"), F.lit(":"), role, text)


def _rolling(turns: Column) -> Column:
    """Hash of each prefix: the hash of the hash before it and the turn."""
    step = lambda done, turn: F.concat(done, F.array(F.sha2(F.concat(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")), turn), 256)))
    return F.aggregate(turns, F.array().cast("array<string>"), step)


def conversations_of(rows: DataFrame) -> DataFrame:
    """conv_id, turns (role, text; by turn, then role and text) and prefixes (rolling hashes) of each conversation."""
    clean = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
    ).filter(F.col("conv_id").isNotNull())
    return (
        clean.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
        .withColumn("prefixes", _rolling(F.transform("turns", lambda t: _turn(t["role"], t["text"]))))
    )


def render_maximal(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns and rendered text of each maximal conversation.

    ``rows``: conv_id, turn, role, text; other columns are not read.  Turns without a
    conv_id belong to no conversation.  Null roles and texts are empty; a null turn
    comes first; equal turn numbers are ordered by role and text, repeated rows stay
    twice.  Of equal conversations the smallest conv_id stays.  Empty in, empty out.
    A rendered conversation is one row, so its turns meet in one task; prefixes and
    copies are matched by hashes alone, counted before they are moved.
    """
    hashed = conversations_of(rows).withColumn("whole", F.element_at("prefixes", -1))
    longer = hashed.select(F.explode(F.slice("prefixes", F.lit(1), F.size("prefixes") - 1)).alias("whole")).distinct()
    first = hashed.groupBy("whole").agg(F.min("conv_id").alias("conv_id"))
    kept = first.join(longer, "whole", "left_anti").select("conv_id")
    body = F.transform("turns", lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE)))
    return hashed.join(kept, "conv_id", "left_semi").select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join(body, "").alias("rendered"))


#: DuckDB: prefixes are compared as texts, not hashes.
ORACLE = f"""
WITH turns AS (
  SELECT conv_id, role, text, row_number() OVER w AS n,
         string_agg(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') || chr(1), '') OVER (w ROWS UNBOUNDED PRECEDING) AS prefix
  FROM conversations WHERE conv_id IS NOT NULL
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, ''))
), whole AS (
  SELECT conv_id, max(n) AS n_turns, arg_max(prefix, n) AS prefix,
         string_agg('{OPEN}' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY n) AS rendered
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, rendered FROM whole w
WHERE NOT EXISTS (SELECT 1 FROM turns t JOIN whole o USING (conv_id) WHERE t.prefix = w.prefix AND t.n < o.n_turns)
  AND NOT EXISTS (SELECT 1 FROM whole e WHERE e.prefix = w.prefix AND e.conv_id < w.conv_id)
"""
