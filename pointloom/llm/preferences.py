"""Preference formatting: one prompt for the turns that two conversations begin with, and two masked completions.

Built from DataFrame functions alone. Equal turns of both sides meet in one grouped row (partial aggregation, so a turn
that very many conversations share gathers nowhere), which says whether the chosen, the rejected or both conversations
have it. The first turn number at which they differ cuts the pair: turns before it are rendered once as prompt, the
rest on each side as completion. A mask lists the stretches (in characters of the completion) that are to be learnt:
what assistants say, with the end mark, but not the header.

Rows that repeat a turn count once; several rows of one turn number are ordered by role and text. Null role or text
counts as empty. Turns without a number come after all others. Rows without pair id belong to no pair and yield nothing,
so that they do not gather as one. A pair of which one side is missing has an empty prompt and `complete` false. If one conversation
begins the other, its completion is empty. The grouped row of a pair is as large as its two conversations. Other columns
of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.common import table

HEAD, TAIL, END = "<|", "|>\n", "<|end|>\n"


def preference_pairs(turns: DataFrame, learnt_role: str = "assistant") -> DataFrame:
    """From (pair_id, chosen boolean, turn, role, text) to rows (pair_id, complete, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask)."""
    empty = F.lit("")
    last = F.lit(2**63 - 1)
    rows = turns.where("pair_id is not null").select("pair_id", F.coalesce("chosen", F.lit(False)).alias("side"), F.coalesce(F.col("turn").cast("long"), last).alias("turn"), F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text").cast("string"), empty).alias("text"))
    met = rows.groupBy("pair_id", "turn", "role", "text").agg(F.max("side").alias("in_chosen"), F.max(~F.col("side")).alias("in_rejected"))
    pairs = met.groupBy("pair_id").agg(
        F.min(F.when(~(F.col("in_chosen") & F.col("in_rejected")), F.col("turn"))).alias("cut"),
        (F.max("in_chosen") & F.max("in_rejected")).alias("complete"),
        F.array_sort(F.collect_list(F.struct("turn", "role", "text", "in_chosen", "in_rejected"))).alias("turns"),
    )

    def render(t: Column) -> Column:
        return F.concat(F.lit(HEAD), t["role"], F.lit(TAIL), t["text"], F.lit(END))

    def text_of(part: Column) -> Column:
        return F.array_join(F.transform(part, render), "")

    def mask_of(part: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

        def step(acc: Column, t: Column) -> Column:
            begin = acc["at"] + F.length(t["role"]) + len(HEAD) + len(TAIL)
            end = begin + F.length(t["text"]) + len(END)
            own = F.array(F.struct(begin.alias("start"), end.alias("end")))
            return F.struct(end.alias("at"), F.when(t["role"] == learnt_role, F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(part, start, step, lambda acc: acc["spans"])

    before = F.filter("turns", lambda t: F.col("cut").isNull() | (t["turn"] < F.col("cut")))
    chosen = F.filter("turns", lambda t: (t["turn"] >= F.col("cut")) & t["in_chosen"])
    rejected = F.filter("turns", lambda t: (t["turn"] >= F.col("cut")) & t["in_rejected"])
    parts = pairs.select("pair_id", "complete", before.alias("p"), chosen.alias("c"), rejected.alias("r"))
    return parts.select(
        "pair_id", "complete", F.size("p").alias("n_prompt_turns"), text_of(F.col("p")).alias("prompt"), text_of(F.col("c")).alias("chosen"), text_of(F.col("r")).alias("rejected"), mask_of(F.col("c")).alias("chosen_mask"), mask_of(F.col("r")).alias("rejected_mask")
    )


def _digits(mask: str) -> Column:
    return F.array_join(F.transform(mask, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")


def op6_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs conversation 2k (chosen) with 2k + 1 (rejected); the table names no pairs of its own."""
    turns = table(spark, sf_dir, "conversations")
    turns = turns.select(F.expr("conv_id div 2").alias("pair_id"), (F.col("conv_id") % 2 == 0).alias("chosen"), "turn", "role", "text")
    return preference_pairs(turns).withColumns({"chosen_mask": _digits("chosen_mask"), "rejected_mask": _digits("rejected_mask")})


OP6_SQL = """
WITH met AS (
  SELECT conv_id // 2 AS pair_id, coalesce(turn, 9223372036854775807) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         bool_or(conv_id % 2 = 0) AS in_c, bool_or(conv_id % 2 <> 0) AS in_r
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1, 2, 3, 4),
cuts AS (
  SELECT pair_id, min(turn) FILTER (WHERE NOT (in_c AND in_r)) AS cut, bool_or(in_c) AND bool_or(in_r) AS complete
  FROM met GROUP BY 1),
pieces AS (
  SELECT m.*, cut, complete, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS piece
  FROM met m JOIN cuts USING (pair_id)),
sides AS (
  SELECT pair_id, 'c' AS side, turn, role, text, piece FROM pieces WHERE turn >= cut AND in_c
  UNION ALL SELECT pair_id, 'r', turn, role, text, piece FROM pieces WHERE turn >= cut AND in_r),
placed AS (
  SELECT *, CAST(sum(length(piece)) OVER (PARTITION BY pair_id, side ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM sides),
done AS (
  SELECT pair_id, side, string_agg(piece, '' ORDER BY turn, role, text) AS body,
         string_agg(CAST(stop - length(text) - 8 AS VARCHAR) || '-' || CAST(stop AS VARCHAR), ',' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant') AS mask
  FROM placed GROUP BY 1, 2),
prompts AS (
  SELECT pair_id, complete, CAST(count(*) FILTER (WHERE cut IS NULL OR turn < cut) AS INTEGER) AS n_prompt_turns,
         coalesce(string_agg(piece, '' ORDER BY turn, role, text) FILTER (WHERE cut IS NULL OR turn < cut), '') AS prompt
  FROM pieces GROUP BY 1, 2)
SELECT p.pair_id, complete, n_prompt_turns, prompt, coalesce(c.body, '') AS chosen, coalesce(r.body, '') AS rejected,
       coalesce(c.mask, '') AS chosen_mask, coalesce(r.mask, '') AS rejected_mask
FROM prompts p LEFT JOIN done c ON c.pair_id = p.pair_id AND c.side = 'c' LEFT JOIN done r ON r.pair_id = p.pair_id AND r.side = 'r'
"""
