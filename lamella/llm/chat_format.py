"""Chat formatting after cumulative-snapshot collapse (DataFrame operations only).

Chat logs often hold one row set per snapshot: the same conversation is logged
again each time it grows. Every turn gets a rolling hash of the conversation up
to that turn; a conversation whose whole hash occurs as a proper prefix hash
elsewhere is a snapshot of a longer one and is dropped by an anti-join. What
remains is rendered with the template.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.llm._shared import read


@dataclass(frozen=True)
class Template:
    """How a turn is written. ``guard`` replaces the opening of control marks inside texts."""

    before_role: str = "<|im_start|>"
    after_role: str = "\n"
    after_text: str = "<|im_end|>\n"
    mark: str = "<|"
    guard: str = "< |"
    trained_role: str = "assistant"


CHATML = Template()


def prefix_hashes(df: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """Turns in order with ``pos`` (from 1), ``n_turns`` and the rolling hash (``h1, h2``) of turns 1..pos.

    Each turn is hashed with its position; the running XOR over two independent
    64-bit lanes identifies the ordered prefix in 128 bits.
    """
    role = F.coalesce(F.col(role_col), F.lit(""))
    text = F.coalesce(F.col(text_col), F.lit(""))
    turns = df.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")
    )
    ordered = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = turns.withColumn("pos", F.row_number().over(ordered))
    running = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lanes = [
        F.bit_xor(F.xxhash64("pos", "role", "text")).over(running).alias("h1"),
        F.bit_xor(F.xxhash64("text", F.lit("lane two"), "role", "pos")).over(running).alias("h2"),
    ]
    count = F.count(F.lit(1)).over(Window.partitionBy("conv_id")).cast("int").alias("n_turns")
    return placed.select("conv_id", "pos", count, "role", "text", *lanes)


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, n_copies`` of the conversations that no longer one extends.

    Of identical conversations the smallest id stays. Grouping before the anti-join
    turns any number of copies, or of conversations with one common opening, into
    one row per map task.
    """
    whole = turns.filter("pos = n_turns").groupBy("pos", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    proper = turns.filter("pos < n_turns").select("pos", "h1", "h2").distinct()
    return whole.join(proper, ["pos", "h1", "h2"], "left_anti").select("conv_id", "n_copies")


def render(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """``conv_id, n_turns, rendered, trained_chars``: one text per conversation, turns in order."""
    safe = F.replace("text", F.lit(template.mark), F.lit(template.guard))
    role = F.replace("role", F.lit(template.mark), F.lit(template.guard))
    line = F.concat(F.lit(template.before_role), role, F.lit(template.after_role), safe, F.lit(template.after_text))
    trained = F.when(F.col("role") == template.trained_role, F.length(safe)).otherwise(0)
    grouped = turns.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines"),
        F.sum(trained).alias("trained_chars"),
    )
    return grouped.select("conv_id", "n_turns", F.array_join("lines.line", "").alias("rendered"), "trained_chars")


def chat_format(df: DataFrame, template: Template = CHATML, **columns: str) -> DataFrame:
    """Collapse snapshots, then render: ``conv_id, n_turns, n_copies, rendered, trained_chars``.

    Null roles and texts count as empty; rows without a conversation id belong to
    none and are left out. Turns are ordered by (turn, role, text), nulls first, so
    ties have one order and repeated rows are repeated turns. A conversation must
    fit in one row, since its rendering is one text. Extra columns are not read.
    """
    turns = prefix_hashes(df, **columns)
    keep = maximal_conversations(turns)
    kept = turns.select("conv_id", "pos", "role", "text").join(keep, "conv_id", "left_semi")
    return render(kept, template).join(keep, "conv_id").select("conv_id", "n_turns", "n_copies", "rendered", "trained_chars")


def op5(spark, sf_dir):
    return chat_format(read(spark, sf_dir, "conversations"))


QUERIES = {"op5_chat_format": op5}
ORACLE = {
    "op5_chat_format": r"""
    WITH turns AS (
      SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
      FROM conversations WHERE conv_id IS NOT NULL),
    whole AS (SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY pos) AS body FROM turns GROUP BY conv_id),
    once AS (SELECT min(conv_id) AS conv_id, count(*) AS n_copies, any_value(n) AS n, body FROM whole GROUP BY body),
    proper AS (SELECT DISTINCT body[1:k] AS body FROM (SELECT body, unnest(range(1, n)) AS k FROM once)),
    keep AS (SELECT * FROM once ANTI JOIN proper USING (body))
    SELECT k.conv_id, count(*) AS n_turns, any_value(k.n_copies) AS n_copies,
           string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS rendered,
           CAST(sum(CASE WHEN role = 'assistant' THEN length(replace(text, '<|', '< |')) ELSE 0 END) AS BIGINT) AS trained_chars
    FROM keep k JOIN turns USING (conv_id) GROUP BY k.conv_id"""
}
