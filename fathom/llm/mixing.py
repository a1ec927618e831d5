"""Operator 6, mixing sources to target weights along a time-varying curriculum.

Every source has a target (its share of the words of the mix) and a schedule w(t) over
training time t in [0, 1]. The schedule's integral up to t is the part of the target that
is due by then; inverting it turns a document's place in its source's stream of words into
a training position, and the mix is the documents in order of position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm.common import WORD, read_table, stage

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MAX_REPEATS = 1.5, 2
#: Slope of each source's linear schedule w(t) = 1 + s (2 t - 1), repeating like the weights.
SLOPES = (0.5, -0.5, 0.0)


def _nth(values, n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(n - 1, F.lit(len(values))) + 1).cast("int"))


def targets(sized: DataFrame, weights=WEIGHTS, slopes=SLOPES, share: float = SHARE,
            max_repeats: float = MAX_REPEATS) -> DataFrame:
    """(source, source_size, weight, slope, target) from (source, size) rows.

    Sources in code-point order, null last, take the weights in turn. Sharing the excess of
    capped sources again and again ends at min(cap, level * weight) with one common level;
    the level is found by running sums over the sources in order of cap / weight. This table
    has one row a source."""
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = Window.partitionBy(F.lit(0))
    s = s.withColumn("n", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumns({"weight": _nth(weights, F.col("n")), "slope": _nth(slopes, F.col("n"))})
    s = s.withColumn("cap", (F.col("source_size") * F.lit(max_repeats)).cast("double"))
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    asc = one.orderBy("ratio", "n").rowsBetween(Window.unboundedPreceding, -1)
    rest = one.orderBy("ratio", "n").rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumns({"below": F.coalesce(F.sum("cap").over(asc), F.lit(0.0)), "left": F.sum("weight").over(rest),
                       "total": F.sum("source_size").over(one) * F.lit(float(share))})
    # the level if all sources before this one in the order are capped and this one is not
    s = s.withColumn("level", (F.col("total") - F.col("below")) / F.col("left"))
    s = s.withColumn("fits", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "n", "level"))).over(one))
    return s.select("source", "source_size", "weight", "slope", F.when(
        F.col("fits").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("fits.level") * F.col("weight"))).alias("target"))


def position(done: Column, slope: Column) -> Column:
    """The t at which the part ``done`` in [0, 1] of a source is due: the inverse of
    the schedule's integral (1 - s) t + s t**2."""
    b = 1 - slope
    root = (F.sqrt(b * b + 4 * slope * done) - b) / (2 * slope)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(slope == 0, done).otherwise(root)))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 6,
        digits: int = 3, **plan) -> DataFrame:
    """(doc_id, source, __text_hash, size, source_size, target, slope, before, taken, position) per row.

    Within a source the documents stand in order of md5(seed:doc_id); a pass over them may be
    repeated. ``before``: words of the source's stream ahead of the document.
    The words up to the target are taken, so only the last document taken in a pass may be
    cut, and a source's taken words are within one word of its target. The cumulative sizes
    come in two steps, within buckets of the md5's first ``digits`` digits and over bucket totals, so that no
    source is held by one task. ``position`` is where a document is first trained on (null if it isn't).
    Null text: size 0; null source: a source of its own; equal rows share one place."""
    sized = stage(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.xxhash64(F.col(text)).alias("__text_hash"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    plan_t = targets(sized, **plan)
    h = sized.withColumn("__h", F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))))
    h = h.withColumn("__bucket", F.substring("__h", 1, digits))
    w = Window.partitionBy("source", "__bucket").orderBy("__h", "__text_hash").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    tot = h.groupBy("source", "__bucket").agg(F.sum("size").alias("s")).select(
        F.col("source").alias("__src"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("s").over(over), F.lit(0)).alias("__base"))
    tot = tot.join(plan_t, tot["__src"].eqNullSafe(plan_t["source"])).drop("source")
    rows = h.withColumn("__in", F.coalesce(F.sum("size").over(w), F.lit(0)))
    rows = rows.join(tot, (rows["__bucket"] == tot["__b"]) & rows["source"].eqNullSafe(tot["__src"]))
    goal = F.bround("target").cast("long")
    at = F.col("__base") + F.col("__in")

    def taken_in(p: int) -> Column:  # words of pass p that lie before the goal
        return F.greatest(F.lit(0), F.least(F.col("size"), goal - p * F.col("source_size") - at))

    taken = taken_in(0)
    for p in range(1, int(plan.get("max_repeats", MAX_REPEATS))):
        taken = taken + taken_in(p)
    rows = rows.withColumn("taken", taken.cast("long"))
    return rows.select("doc_id", "source", "__text_hash", "size", "source_size", "target", "slope", at.alias("before"), "taken", F.when(
        F.col("taken") > 0, position(at / F.col("target"), F.col("slope"))).alias("position"))


def training_rows(docs: DataFrame, mixed: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  source: str = "source") -> DataFrame:
    """``docs`` in training order, each as often as the mix takes it; the last copy of a
    document that the mix takes in part holds its first words only. Rows alike in id, source
    and text share evenly what was taken of them. Columns stay as they are; a column
    ``n_chars`` is brought up to date."""
    one = mixed.groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__src"), F.col("__text_hash").alias("__th")).agg(
        *[F.first(c).alias(f"__{c}") for c in ("size", "source_size", "target", "slope")],
        F.ceil(F.sum("taken") / F.count(F.lit(1))).alias("__taken"), F.min("before").alias("__before"))
    d = docs.withColumn("__hash", F.xxhash64(F.col(text)))
    j = d.join(one.filter("__taken > 0"), d[doc_id].eqNullSafe(one["__id"]) & d[source].eqNullSafe(one["__src"]) & (d["__hash"] == one["__th"]))
    j = j.withColumn("__pass", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("__taken") / F.col("__size")) - 1).cast("int"))))
    left = F.col("__taken") - F.col("__pass") * F.col("__size")
    words = F.regexp_extract_all(F.col(text), F.lit(f"({WORD})"), 1)
    cut = F.when(left >= F.col("__size"), F.col(text)).otherwise(F.array_join(F.slice(words, 1, left.cast("int")), " "))
    at = position((F.col("__before") + F.col("__pass") * F.col("__source_size")) / F.col("__target"), F.col("__slope"))
    j = j.withColumns({"__pos": at, text: cut})
    return j.repartitionByRange("__pos", doc_id).sortWithinPartitions("__pos", doc_id).select(
        *[F.length(text).cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(read_table(spark, sf_dir, "documents"))
    out = out.select("doc_id", "size", "source_size", "target", "taken", "position")
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


SQL = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
                  md5(concat_ws(':', 6, doc_id)) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM s),
w AS (SELECT *, [3, 1, 2][(n - 1) % 3 + 1]::DOUBLE AS weight, [0.5, -0.5, 0.0][(n - 1) % 3 + 1]::DOUBLE AS slope,
             (source_size * 2)::DOUBLE AS cap FROM n),
r AS (SELECT *, cap / weight AS ratio, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM w),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY ratio, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
f AS (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, n LIMIT 1),
t AS (SELECT source, source_size, slope, least(cap, coalesce((SELECT level FROM f), 1e300::DOUBLE) * weight) AS target FROM l),
c AS (SELECT d.*, t.source_size, t.slope, t.target, round_even(t.target, 0)::BIGINT AS goal,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, greatest(0, least(size, goal - before)) + greatest(0, least(size, goal - source_size - before)) AS taken FROM c)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken,
  CASE WHEN taken > 0 THEN greatest(0::DOUBLE, least(1::DOUBLE, CASE WHEN slope = 0 THEN before / target
    ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * (before / target)) - (1 - slope)) / (2 * slope) END)) END AS position
FROM k
"""
