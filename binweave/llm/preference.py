"""Preference formatting, in DataFrame functions alone: a chosen and a rejected conversation become one prompt and two masked completions.

The prompt is the longest common prefix of whole turns (equal role and text), rendered once; each completion is the rest of its side.
A completion's mask lists the character ranges [start, stop) to train on: the text and end mark of assistant turns, never headers or
other roles' turns.

Work is by rows of turns and linear in them: one shuffle by key, sorts that can spill, and only the rendered texts gathered at the end.
Null roles and texts count as empty; turns come in the order of their number (nulls first), then role and text; rows repeated exactly
count once. Equal sides have empty completions, sides without a common turn an empty prompt; a key that only one side has is a pair with an
empty side. Null keys are one conversation. Nothing is cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How a turn is rendered: before the role, between role and text, and behind the text.
BEFORE, BETWEEN, AFTER = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"


def numbered(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, i, role, text): distinct turns, numbered from 1 in each conversation."""
    rows = turns.select(F.col(f"`{key}`").alias("key"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.repartition("key").distinct()
    order = Window.partitionBy("key").orderBy("turn", "role", "text")
    return rows.select("key", F.row_number().over(order).alias("i"), "role", "text")


def stale_answer(chosen: DataFrame) -> DataFrame:
    """A rejected side for each conversation of numbered(): its last assistant turn gives the assistant's answer before that again ('' if
    there is none)."""
    spoken = F.col("role") == TRAINED
    whole = Window.partitionBy("key")
    before = whole.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    rows = chosen.select("*", F.max(F.when(spoken, F.col("i"))).over(whole).alias("at"), F.last(F.when(spoken, F.col("text")), ignorenulls=True).over(before).alias("said"))
    return rows.select("key", "i", "role", F.when(F.col("i") == F.col("at"), F.coalesce("said", F.lit(""))).otherwise(F.col("text")).alias("text"))


def rendered(role: Column, text: Column) -> Column:
    """A turn as text."""
    return F.concat(F.lit(BEFORE), role, F.lit(BETWEEN), text, F.lit(AFTER))


def format_pairs(chosen: DataFrame, rejected: DataFrame, key: str = "key") -> DataFrame:
    """(key, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask) of two sides as numbered() gives them."""
    side = lambda df, name: df.select("key", "i", F.struct("role", "text").alias("t"), F.lit(name).alias("side"))
    both = side(chosen, "a").unionByName(side(rejected, "b")).repartition("key")
    pairs = both.groupBy("key", "i").agg(F.max(F.when(F.col("side") == "a", F.col("t"))).alias("a"), F.max(F.when(F.col("side") == "b", F.col("t"))).alias("b"))
    whole = Window.partitionBy("key")
    first = F.min(F.when(~F.col("a").eqNullSafe(F.col("b")), F.col("i"))).over(whole)
    rows = pairs.select("*", (F.coalesce(first - 1, F.count(F.lit(1)).over(whole))).cast("long").alias("n_common"))
    upto = whole.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for s in ("a", "b"):
        text = F.when(F.col(s).isNotNull(), rendered(F.col(s)["role"], F.col(s)["text"]))
        rows = rows.withColumn(f"r{s}", text)
        stop = F.sum(F.when(F.col("i") > F.col("n_common"), F.length(f"r{s}")).otherwise(0)).over(upto)
        rows = rows.withColumn(f"stop{s}", stop.cast("long"))
    later = F.col("i") > F.col("n_common")

    def joined(s: str, when: Column) -> Column:
        kept = F.collect_list(F.when(when & F.col(f"r{s}").isNotNull(), F.struct("i", F.col(f"r{s}").alias("r"))))
        return F.array_join(F.sort_array(kept)["r"], "")

    def mask(s: str) -> Column:
        start = F.col(f"stop{s}") - F.length(f"r{s}") + F.length(F.col(s)["role"]) + len(BEFORE) + len(BETWEEN)
        span = F.struct(start.cast("long").alias("start"), F.col(f"stop{s}").alias("stop"))
        return F.sort_array(F.collect_list(F.when(later & (F.col(s)["role"] == TRAINED), span)))

    return rows.groupBy("key").agg(
        F.max("n_common").alias("n_common"), joined("a", ~later).alias("prompt"), joined("a", later).alias("chosen"), joined("b", later).alias("rejected"), mask("a").alias("chosen_mask"), mask("b").alias("rejected_mask")
    ).withColumnRenamed("key", key)


#: DuckDB SQL for format_pairs(conversations with their stale_answer), masks written as "start-stop" joined by commas.
ORACLE_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM t),
m AS (SELECT *, max(CASE WHEN role = 'assistant' THEN i END) OVER (PARTITION BY conv_id) AS last_i,
        last_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS said FROM n),
b AS (SELECT conv_id, i, role, text AS a, CASE WHEN i = last_i THEN coalesce(said, '') ELSE text END AS b FROM m),
p AS (SELECT *, coalesce(min(CASE WHEN a <> b THEN i END) OVER (PARTITION BY conv_id) - 1, count(*) OVER (PARTITION BY conv_id)) AS n_common FROM b),
s AS (SELECT conv_id, i, role, n_common, side, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS r, length(role) + 5 AS head
      FROM (SELECT conv_id, i, role, n_common, 'a' AS side, a AS text FROM p UNION ALL SELECT conv_id, i, role, n_common, 'b', b FROM p)),
o AS (SELECT *, sum(CASE WHEN i > n_common THEN length(r) ELSE 0 END) OVER (PARTITION BY conv_id, side ORDER BY i) AS stop FROM s)
SELECT conv_id, CAST(any_value(n_common) AS BIGINT) AS n_common,
  coalesce(string_agg(r, '' ORDER BY i) FILTER (WHERE side = 'a' AND i <= n_common), '') AS prompt,
  coalesce(string_agg(r, '' ORDER BY i) FILTER (WHERE side = 'a' AND i > n_common), '') AS chosen,
  coalesce(string_agg(r, '' ORDER BY i) FILTER (WHERE side = 'b' AND i > n_common), '') AS rejected,
  coalesce(string_agg(CAST(stop - length(r) + head AS BIGINT) || '-' || CAST(stop AS BIGINT), ',' ORDER BY i) FILTER (WHERE side = 'a' AND i > n_common AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(CAST(stop - length(r) + head AS BIGINT) || '-' || CAST(stop AS BIGINT), ',' ORDER BY i) FILTER (WHERE side = 'b' AND i > n_common AND role = 'assistant'), '') AS rejected_mask
FROM o GROUP BY conv_id
"""
