"""Operator 1, chat formatting: collapse cumulative snapshots, then render conversations.

A logged conversation that equals the first turns of a longer one is a snapshot of it and
goes; of equal conversations the smallest id stays. Every turn gets a hash of (position,
role, text); the running sum of two such hashes names a turn prefix, whatever block of the
conversation it was summed in. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm.common import read_table

START, END = "<|im_start|>", "<|im_end|>"
#: Hashes keep 40 bits, so that sums over the 2**23 rows of a block stay within a long; two of them name a prefix.
MASK = (1 << 40) - 1
#: Sums over whole conversations are kept modulo this prime.
PRIME = (1 << 61) - 1


def _running(df: DataFrame, values: list[str]) -> DataFrame:
    """Inclusive running sums of ``values`` within a conversation, block by block: a sum
    within (conversation, block), plus the totals of the blocks before it. A conversation
    with very many turns is thus spread over tasks."""
    inner = Window.partitionBy("__conv", "__block").orderBy("__turn", "__role", "__text").rowsBetween(
        Window.unboundedPreceding, 0)
    before = Window.partitionBy("__conv").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("__conv")
    totals = df.groupBy("__conv", "__block").agg(*[F.sum(v).alias(v) for v in values]).select(
        "__conv", "__block", F.max("__block").over(every).alias("__last_block"),
        *[F.coalesce(F.sum(F.col(v).cast("decimal(28,0)")).over(before) % F.lit(PRIME), F.lit(0)).cast("long").alias(f"__before_{v}") for v in values])
    sums = df.select("*", *[F.sum(v).over(inner).alias(f"__in_{v}") for v in values])
    return sums.join(totals, ["__conv", "__block"]).select(
        *df.columns, "__last_block", *[((F.col(f"__in_{v}") % F.lit(PRIME) + F.col(f"__before_{v}")) % F.lit(PRIME)).alias(f"__run_{v}") for v in values])


def turn_prefixes(turns: DataFrame, conv: str, turn: str, role: str, text: str, block_turns: int) -> DataFrame:
    """One row per distinct logged turn: its position, prefix hashes and whether it is the last."""
    rows = turns.filter(F.col(conv).isNotNull()).select(
        F.col(conv).alias("__conv"), F.col(turn).cast("long").alias("__turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("unknown")).alias("__role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    rows = rows.withColumn("__block", F.coalesce(F.floor(F.col("__turn") / block_turns), F.lit(-(1 << 62))))
    order = Window.partitionBy("__conv", "__block").orderBy("__turn", "__role", "__text")
    this = F.struct("__turn", "__role", "__text")
    rows = rows.withColumn("__dup", this.eqNullSafe(F.lag(this).over(order))).filter("not __dup").drop("__dup")
    rows = _running(rows.withColumn("one", F.lit(1).cast("long")), ["one"])
    rows = rows.withColumnRenamed("__run_one", "__pos").drop("one", "__last_block")
    rows = rows.withColumns({
        "h1": F.xxhash64("__pos", "__role", "__text").bitwiseAND(F.lit(MASK)),
        "h2": F.xxhash64(F.lit("b"), "__text", "__pos", "__role").bitwiseAND(F.lit(MASK))})
    rows = _running(rows, ["h1", "h2"]).drop("h1", "h2")
    last = F.lead(F.lit(1)).over(order).isNull() & (F.col("__block") == F.col("__last_block"))
    return rows.withColumn("__last", last)


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """(__conv, __n): conversations that are a prefix of no longer one; of equals the smallest id."""
    key = ["__pos", "__run_h1", "__run_h2"]
    ends = prefixes.filter("__last").groupBy(*key).agg(F.min("__conv").alias("__conv"))
    extended = prefixes.filter("not __last").select(*key).distinct()
    return ends.join(extended, key, "left_anti").select("__conv", F.col("__pos").alias("__n"))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text", block_turns: int = 512) -> DataFrame:
    """(conv_id, part, n_turns, text): the maximal conversations, rendered.

    A part holds up to ``block_turns`` turns, so all but very long conversations are one
    row (part 0); the parts joined in order are the whole rendering. Turns are ordered by
    (turn, role, text), null turns first; a turn logged twice alike counts once. Null role:
    ``unknown``; null text: empty; rows without a conversation id belong to none and are
    left out. Markers that a text or role holds lose their ``|``. Other columns are ignored.
    """
    p = turn_prefixes(turns, conv, turn, role, text, block_turns)
    kept = p.join(maximal_conversations(p), "__conv")

    def plain(c):
        return F.replace(F.replace(F.col(c), F.lit(START), F.lit("<im_start>")), F.lit(END), F.lit("<im_end>"))

    line = F.concat(F.lit(START), plain("__role"), F.lit("\n"), plain("__text"), F.lit(END + "\n"))
    parts = kept.groupBy(
        F.col("__conv").alias("conv_id"), F.floor((F.col("__pos") - 1) / block_turns).alias("part")).agg(
        F.max("__n").alias("n_turns"), F.sort_array(F.collect_list(F.struct("__pos", line.alias("s")))).alias("a"))
    return parts.select("conv_id", "part", "n_turns", F.array_join(F.col("a.s"), "").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(read_table(spark, sf_dir, "conversations"))


SQL = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM t),
c AS (SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY pos) AS turns FROM p GROUP BY conv_id),
gone AS (
  SELECT DISTINCT a.conv_id FROM c a JOIN c b
  ON a.turns[1] = b.turns[1] AND a.conv_id <> b.conv_id AND b.n >= a.n
     AND list_slice(b.turns, 1, a.n) = a.turns AND (b.n > a.n OR b.conv_id < a.conv_id))
SELECT p.conv_id, CAST(floor((pos - 1) / 512) AS BIGINT) AS part, c.n AS n_turns,
  string_agg('<|im_start|>' || replace(replace(role, '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>') || chr(10)
    || replace(replace(text, '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text
FROM p JOIN c USING (conv_id) WHERE p.conv_id NOT IN (SELECT conv_id FROM gone)
GROUP BY 1, 2, 3
"""
