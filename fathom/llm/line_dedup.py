"""Operator 3, line dedup: drop lines that too many pages of the same site carry.

Per host, the share of its pages that contain a line decides; a line over the boilerplate
ratio goes from every page of that host and stays on other hosts. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.common import read_table, stage

RATIO, MIN_PAGES = 0.05, 3
#: Line hashes of all hosts that may be sent to every task (8 bytes each).
BROADCAST_LINES = 1 << 20


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float, min_pages: int) -> DataFrame:
    """(__host, __drop): per host the hashes of its boilerplate lines.

    Lines are told apart by 64 bits of (line, host). A host's list has at most
    (distinct lines of its mean page) / ratio entries, however many pages the host has."""
    lines = F.array_distinct(F.transform(F.split(F.col(text), "\n"), F.trim))
    seen = pages.select(F.col(host).alias("__host"), F.explode(lines).alias("l")).filter("l <> ''").groupBy(
        "__host", F.xxhash64("l").alias("__line")).count().filter(F.col("count") >= min_pages)
    total = pages.groupBy(F.col(host).alias("__h")).agg(F.count(F.lit(1)).alias("__pages"))
    hit = seen.join(total, seen["__host"].eqNullSafe(total["__h"])).filter(F.col("count") > ratio * F.col("__pages"))
    return hit.groupBy("__host").agg(F.collect_set("__line").alias("__drop"))


def drop_site_lines(pages: DataFrame, host: str = "source", text: str = "text",
                    ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """All rows and columns of ``pages`` with ``text`` less its host's boilerplate lines,
    plus ``n_lines`` and ``n_dropped``.

    A line is a stretch between newlines, compared without outer spaces; blank lines always
    stay. It is boilerplate if over ``ratio`` of the host's pages and at least ``min_pages``
    hold it. A null host is a host of its own; a null text stays null and has no lines; a
    text of boilerplate alone becomes empty, its row stays. Repeated rows count as pages.
    """
    drop = stage(boilerplate(pages, host, text, ratio, min_pages))
    lines = drop.agg(F.sum(F.size("__drop") + 8)).first()[0] or 0
    if lines <= BROADCAST_LINES:  # else the pages are shuffled to the lists, and a hot host's pages are split
        drop = F.broadcast(drop)
    joined = pages.join(drop, pages[host].eqNullSafe(drop["__host"]), "left")
    lines = F.split(F.col(text), "\n")
    kept = F.when(F.col("__drop").isNull(), lines).otherwise(F.filter(
        lines, lambda l: (F.trim(l) == "") | ~F.array_contains(F.col("__drop"), F.xxhash64(F.trim(l)))))
    out = joined.withColumns({"__kept": kept, "__n": F.coalesce(F.size(lines), F.lit(0))})
    own = [c for c in pages.columns if c not in ("n_lines", "n_dropped")]
    return out.select(
        *[F.array_join("__kept", "\n").alias(c) if c == text else F.col(c) for c in own],
        F.when(F.col(text).isNull(), 0).otherwise(F.col("__n")).alias("n_lines"),
        F.when(F.col(text).isNull(), 0).otherwise(F.col("__n") - F.size("__kept")).alias("n_dropped"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_site_lines(docs)


SQL = f"""
WITH l AS (
  SELECT source, rid, doc_id, i, line FROM (
    SELECT source, doc_id, rid, unnest(string_split(text, chr(10))) AS line,
           generate_subscripts(string_split(text, chr(10)), 1) AS i
    FROM (SELECT *, row_number() OVER () AS rid FROM documents))),
d AS (SELECT *, row_number() OVER () AS rid FROM documents),
tot AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
seen AS (SELECT source, trim(line, ' ') AS t, count(DISTINCT rid) AS c FROM l WHERE trim(line, ' ') <> '' GROUP BY 1, 2),
bad AS (SELECT s.source, s.t FROM seen s JOIN tot ON s.source IS NOT DISTINCT FROM tot.source
        WHERE c >= {MIN_PAGES} AND c > {RATIO}::DOUBLE * pages),
m AS (SELECT l.*, bad.t IS NOT NULL AS gone FROM l LEFT JOIN bad
      ON l.source IS NOT DISTINCT FROM bad.source AND trim(l.line, ' ') = bad.t)
SELECT doc_id, source, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text,
  count(*)::INTEGER AS n_lines, (count(*) FILTER (WHERE gone))::INTEGER AS n_dropped
FROM m GROUP BY rid, doc_id, source
UNION ALL SELECT doc_id, source, NULL, 0, 0 FROM d WHERE text IS NULL
"""
