"""Literal and generated tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: dive-log concept -> taxonomic group lookup (22 rows, the study's own
# table, spelling "Actinpterygii" included as published) ---
PREY_GROUPS = [
    ("Actinpterygii", "Small mesopelagics"),
    ("Bathylagidae", "Small mesopelagics"),
    ("Chiroteuthis calyx", "Squid"),
    ("Cranchiidae", "Squid"),
    ("Cyclothone", "Small mesopelagics"),
    ("Gonatus", "Squid"),
    ("Histioteuthis heteropsis", "Squid"),
    ("Idiacanthus", "Small mesopelagics"),
    ("Idiacanthus antrostomus", "Small mesopelagics"),
    ("Lanceolidae", "Small mesopelagics"),
    ("Leuroglossus stilbius", "Small mesopelagics"),
    ("Melanostigma pammelas", "Small mesopelagics"),
    ("Merluccius productus", "Hake"),
    ("Myctophidae", "Small mesopelagics"),
    ("Octopoteuthis deletron", "Squid"),
    ("Parvilux ingens", "Small mesopelagics"),
    ("Pleuronectiformes 2", "Small mesopelagics"),
    ("Sebastes", "Rockfish"),
    ("Sternoptychidae", "Small mesopelagics"),
    ("Sternoptyx diaphana", "Small mesopelagics"),
    ("Stomiidae", "Small mesopelagics"),
    ("Teuthoidea", "Squid"),
]

_LOOKUP_SCHEMA = T.StructType([T.StructField("concept", T.StringType(), False),
                               T.StructField("Group", T.StringType(), False)])


def lookup(spark: SparkSession, rows: Sequence[tuple[str, str]] = PREY_GROUPS) -> DataFrame:
    """Literal lookup table (broadcast it at the join; its size is the literal's)."""
    return spark.createDataFrame(list(rows), _LOOKUP_SCHEMA)


def brand_group_rows() -> list[tuple[str, str]]:
    """Analogue lookup for the test tables: 22 of the 25 part brands get a group by rule,
    three stay unmatched so the left join produces NULL groups."""
    def grp(k: int) -> str:
        if k <= 10:
            return "Small mesopelagics"
        if k <= 15:
            return "Squid"
        if k <= 18:
            return "Hake"
        return "Rockfish"
    return [(f"Brand#{k}", grp(k)) for k in range(1, 23)]


def brand_groups(spark: SparkSession) -> DataFrame:
    return lookup(spark, brand_group_rows())


def brand_groups_sql() -> str:
    return ", ".join(f"('{c}', '{g}')" for c, g in brand_group_rows())


def series_from(bounds: DataFrame, lo: int, hi_col: str, name: str, step: int = 1) -> DataFrame:
    """Integer series lo..hi where ``hi`` comes from a one-row frame derived from data."""
    return bounds.select(F.explode(F.sequence(F.lit(lo).cast("long"), F.col(hi_col).cast("long"),
                                              F.lit(step).cast("long"))).alias(name))


def date_spine(df: DataFrame, col: str, name: str = "date") -> DataFrame:
    """Every day from the first to the last date in ``col``.

    The spine's size is the day span, not the row count; it is generated from a
    one-row min/max aggregate."""
    rng = df.agg(F.min(F.to_date(col)).alias("__d0"), F.max(F.to_date(col)).alias("__d1"))
    return rng.select(F.explode(F.sequence("__d0", "__d1", F.expr("INTERVAL 1 DAY"))).alias(name))


def intervals(spark: SparkSession, rows: Sequence[Sequence], names=("outer_start", "inner_start",
                                                                     "inner_end", "outer_end")) -> DataFrame:
    """Literal table of nested interval bounds (one row per window)."""
    schema = T.StructType([T.StructField(n, T.TimestampNTZType(), False) for n in names])
    return spark.createDataFrame([tuple(r) for r in rows], schema)
