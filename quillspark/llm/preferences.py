"""Preference formatting: chosen and rejected conversations as one prompt and
two masked completions.

The longest common prefix of turns (same role, same text) is rendered once as
the prompt. The turns after it are the completions. A completion's mask names
the character spans that training counts: what assistants say, with the closing
mark, but not the headings or other roles' turns.

All of it is DataFrame functions. A turn's null role or text counts as ''. A
null conversation has no turns; two of the same turns have empty completions.
Repeated rows of a conversation's turn count once; turns are ordered by number,
role and text. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pinned

TURNS = "array<struct<role:string,text:string>>"


def turns_of(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """conv_id and its ordered turns."""
    rows = conversations.select(F.col(id_col).alias("conv_id"), F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    ordered = F.array_sort(F.collect_set("t"))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns."""
    least = F.least(F.size(a), F.size(b))
    same = F.transform(F.sequence(F.lit(0), F.greatest(least - 1, F.lit(0))), lambda i: F.get(a, i).eqNullSafe(F.get(b, i)))
    stop = F.array_position(same, False).cast("int")
    return F.when(least == 0, 0).when(stop == 0, least).otherwise(stop - 1)


def heading(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(heading(t), t["text"], F.lit("<|end|>\n"))), "")


def mask_of(turns: Column, roles: tuple[str, ...] = ("assistant",)) -> Column:
    """Spans, as starts and ends in characters, of what the given roles say."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc, t):
        start = acc["at"] + F.length(heading(t))
        end = start + F.length(t["text"]) + len("<|end|>")
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(t["role"].isin(*roles), F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def format_preferences(pairs: DataFrame, id_col: str = "pair_id", chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """pair_id, n_common, prompt, and for chosen and rejected the completion and
    its mask. chosen and rejected are arrays of structs with role and text."""

    def clean(name: str) -> Column:
        turns = F.coalesce(F.col(name), F.array().cast(TURNS))
        return F.transform(turns, lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))

    p = pinned(pinned(pairs.select(F.col(id_col).alias("pair_id"), F.col(chosen).alias(chosen), F.col(rejected).alias(rejected)), "a", clean(chosen)), "b", clean(rejected))
    p = pinned(p, "n_common", common_turns(F.col("a"), F.col("b")))
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.greatest(F.size(c) - F.col("n_common"), F.lit(0)))
    p = pinned(pinned(p.select("pair_id", "n_common", F.slice("a", F.lit(1), F.col("n_common")).alias("prefix"), "a", "b"), "ra", rest(F.col("a"))), "rb", rest(F.col("b")))
    return p.select(
        "pair_id",
        "n_common",
        rendered(F.col("prefix")).alias("prompt"),
        rendered(F.col("ra")).alias("chosen"),
        mask_of(F.col("ra")).alias("chosen_mask"),
        rendered(F.col("rb")).alias("rejected"),
        mask_of(F.col("rb")).alias("rejected_mask"),
    )


def partner_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs for a table without preferences: each conversation is chosen, and
    rejected is the same with its last turn replaced by the last turn of the
    conversation whose id differs in the lowest bit (left out if there is none).
    Ids are unique on both sides of the join, so no id gathers rows."""
    t = turns_of(conversations.where("conv_id is not null"))
    last = t.select(F.expr("conv_id ^ 1").alias("conv_id"), F.slice("turns", -1, 1).alias("other"))
    joined = t.join(last, "conv_id", "left")
    own = F.slice("turns", F.lit(1), F.greatest(F.size("turns") - 1, F.lit(0)))
    return joined.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), F.concat(own, F.coalesce("other", F.array().cast(TURNS))).alias("rejected"))


def op2_preference_format(spark, sf_dir: str) -> DataFrame:
    out = format_preferences(partner_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    flat = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"], s["end"])), " ")
    return out.select("pair_id", F.col("n_common").cast("long").alias("n_common"), "prompt", "chosen", flat("chosen_mask").alias("chosen_mask"), "rejected", flat("rejected_mask").alias("rejected_mask"))


ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
a AS (SELECT conv_id AS id, pos, role, text, n FROM t),
b AS (
  SELECT conv_id AS id, pos, role, text FROM t WHERE pos < n
  UNION ALL
  SELECT o.id, o.n, p.role, p.text FROM (SELECT DISTINCT id, n FROM a) o JOIN t p ON p.conv_id = xor(o.id, 1) AND p.pos = p.n),
k AS (
  SELECT coalesce(a.id, b.id) AS id, coalesce(min(coalesce(a.pos, b.pos)) FILTER (WHERE NOT (a.role IS NOT DISTINCT FROM b.role AND a.text IS NOT DISTINCT FROM b.text)) - 1, count(*)) AS k
  FROM a FULL JOIN b ON a.id = b.id AND a.pos = b.pos GROUP BY 1),
sides AS (SELECT 'a' AS side, id, pos, role, text FROM a UNION ALL SELECT 'b', id, pos, role, text FROM b),
r AS (
  SELECT side, id, pos, k, role, length('<|' || role || '|>' || chr(10)) AS head, length(text) + 7 AS body, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS line
  FROM sides JOIN k USING (id)),
m AS (
  SELECT *, coalesce(sum(head + body + 1) FILTER (WHERE pos > k) OVER (PARTITION BY side, id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + head AS start FROM r)
SELECT id AS pair_id, k AS n_common,
  coalesce(string_agg(line, '' ORDER BY pos) FILTER (WHERE side = 'a' AND pos <= k), '') AS prompt,
  coalesce(string_agg(line, '' ORDER BY pos) FILTER (WHERE side = 'a' AND pos > k), '') AS chosen,
  coalesce(string_agg(CAST(start AS BIGINT) || ':' || CAST(start + body AS BIGINT), ' ' ORDER BY pos) FILTER (WHERE side = 'a' AND pos > k AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(line, '' ORDER BY pos) FILTER (WHERE side = 'b' AND pos > k), '') AS rejected,
  coalesce(string_agg(CAST(start AS BIGINT) || ':' || CAST(start + body AS BIGINT), ' ' ORDER BY pos) FILTER (WHERE side = 'b' AND pos > k AND role = 'assistant'), '') AS rejected_mask
FROM m GROUP BY id, k"""
