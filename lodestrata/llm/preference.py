"""Preference formatting: chosen and rejected conversations as one prompt and two masked completions.

The longest common prefix of turns (same role and text) is rendered once as the prompt; what follows in
each conversation is its completion. A mask is a list of spans [start, end) of characters of the
completion: those of assistant turns, with their end mark, are trained on.

A turn is rendered as `<|role|>\\n`, its text, `<|end|>\\n`. Turns stand in the order of turn, role, text.

Defined results: a null role counts as empty, a null text too, a null turn comes first. Rows without a
conversation id are one conversation, which counts as chosen. A pair with one side only has an empty prefix, complete is false.
Repeated rows are turns of their own. A pair's turns meet in one task, as its result is one row.
Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

END = "<|end|>\n"


def rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit(END))


def _joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def _mask(turns: Column) -> Column:
    """Spans of assistant texts with their end mark, from running lengths."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc, t):
        end = acc["at"] + F.length(rendered(t))
        span = F.struct((acc["at"] + F.length(t["role"]) + 5).cast("int").alias("start"), (end - 1).cast("int").alias("end"))
        return F.struct(end.cast("int").alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_preferences(turns: DataFrame, pair: str = "pair_id", rejected: str = "is_rejected") -> DataFrame:
    """From rows (pair, rejected or not, turn, role, text): pair, complete, prefix_turns, prompt, and for each side completion and mask."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    one = turns.select(F.col(pair).alias("pair"), F.coalesce(F.col(rejected), F.lit(False)).alias("side"), F.struct("turn", text("role").alias("role"), text("text").alias("text")).alias("t"))
    both = one.groupBy("pair").agg(F.array_sort(F.collect_list(F.when(~F.col("side"), F.col("t")))).alias("c"), F.array_sort(F.collect_list(F.when(F.col("side"), F.col("t")))).alias("r"))
    shared = F.least(F.size("c"), F.size("r"))
    differs = F.filter(F.sequence(F.lit(1), shared), lambda i: (F.element_at("c", i)["role"] != F.element_at("r", i)["role"]) | (F.element_at("c", i)["text"] != F.element_at("r", i)["text"]))
    n = F.when(shared == 0, 0).otherwise(F.coalesce(F.try_element_at(differs, F.lit(1)) - 1, shared))
    cut = both.withColumn("n", n).select("pair", "n", (shared > 0).alias("complete"), F.slice("c", 1, F.col("n")).alias("p"), F.slice("c", F.col("n") + 1, F.greatest(F.size("c") - F.col("n"), F.lit(0))).alias("c"), F.slice("r", F.col("n") + 1, F.greatest(F.size("r") - F.col("n"), F.lit(0))).alias("r"))
    return cut.select(F.col("pair").alias(pair), "complete", F.col("n").alias("prefix_turns"), _joined(F.col("p")).alias("prompt"), _joined(F.col("c")).alias("chosen"), _mask(F.col("c")).alias("chosen_mask"), _joined(F.col("r")).alias("rejected"), _mask(F.col("r")).alias("rejected_mask"))


def op6_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k and 2k + 1 as chosen and rejected; texts as digests."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    out = format_preferences(rows.select(F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"), (F.pmod("conv_id", F.lit(2)) == 1).alias("is_rejected"), "turn", "role", "text"))
    trained = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("pair_id", "complete", F.col("prefix_turns").cast("int").alias("prefix_turns"), *[F.sha2(c, 256).alias(f"{c}_sha256") for c in ("prompt", "chosen", "rejected")], trained("chosen_mask").alias("chosen_trained"), trained("rejected_mask").alias("rejected_trained"))


OP6_SQL = r"""
WITH t AS (SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations),
s AS (SELECT pair_id, k, max(CASE WHEN side = 0 THEN role || chr(0) || text END) AS c, max(CASE WHEN side = 1 THEN role || chr(0) || text END) AS r FROM t GROUP BY ALL),
n AS (SELECT pair_id, count(c) > 0 AND count(r) > 0 AS complete, CAST(coalesce(min(CASE WHEN c IS DISTINCT FROM r THEN k END), max(k) + 1) - 1 AS INT) AS prefix_turns FROM s GROUP BY pair_id),
m AS (SELECT t.*, n.complete, n.prefix_turns, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown FROM t JOIN n USING (pair_id))
SELECT pair_id, complete, prefix_turns,
 sha256(coalesce(string_agg(shown, '' ORDER BY k) FILTER (WHERE side = 0 AND k <= prefix_turns), '')) AS prompt_sha256,
 sha256(coalesce(string_agg(shown, '' ORDER BY k) FILTER (WHERE side = 0 AND k > prefix_turns), '')) AS chosen_sha256,
 sha256(coalesce(string_agg(shown, '' ORDER BY k) FILTER (WHERE side = 1 AND k > prefix_turns), '')) AS rejected_sha256,
 CAST(coalesce(sum(length(text) + 7) FILTER (WHERE side = 0 AND k > prefix_turns AND role = 'assistant'), 0) AS BIGINT) AS chosen_trained,
 CAST(coalesce(sum(length(text) + 7) FILTER (WHERE side = 1 AND k > prefix_turns AND role = 'assistant'), 0) AS BIGINT) AS rejected_trained
FROM m GROUP BY ALL
"""
