"""Dive-log counts and depth-binned profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.operators import aggregates as A
from fathom.operators import relational as R
from fathom.plans.catalog import query
from fathom.sources import literals as L
from fathom.sources.views import table, v_obs, with_views

TRANSECT, DESCEND = "N", "R"          # activity codes standing for 'transect' / 'descend'
PROFILE_VARS = {"temperature": "temperature_celsius", "salinity": "salinity",
                "oxygen": "oxygen_ml_per_l", "transmission": "light_transmission"}
LOOKUP_DATE, LOOKUP_DEPTHS = "1997-07-01", (150.0, 250.0)


def profiles(obs):
    """Q10: descents with light > 0, depth rounded half-even to tens, strict means."""
    d = obs.filter((F.col("activity") == DESCEND) & (F.col("light_transmission") > 0))
    return (d.groupBy("date", F.bround("depth_meters", -1).alias("depth"))
            .agg(*[A.mean_strict(src).alias(dst) for dst, src in PROFILE_VARS.items()])
            .orderBy("depth"))


def grouped_counts(spark, obs):
    """Q9 (second half): lookup groups joined on, prey only, counts by 10 m bin and group."""
    lk = L.brand_groups(spark)
    joined = R.natural_left_join(obs, F.broadcast(lk))
    prey = [c for c, _ in L.brand_group_rows()]
    sel = joined.filter((F.col("activity") == TRANSECT) & F.col("concept").isin(*prey))
    return A.binned_counts(sel, ["date", "Group"], -1, "depth_meters")


_PROFILES_SQL = f"""
    profiles AS (SELECT date, round_even(depth_meters, -1) AS depth,
                        {", ".join(f"CASE WHEN count({s}) = count(*) THEN avg({s}) END AS {d}" for d, s in PROFILE_VARS.items())}
                 FROM v_obs WHERE activity = '{DESCEND}' AND light_transmission > 0 GROUP BY 1, 2)"""


@query("binned_counts", ops="Q9 P7 M5 A19", sql=with_views(f"""
    SELECT date, round_even(depth_meters, -2) AS depth_meters, concept, count(*) AS n
    FROM v_obs WHERE activity = '{TRANSECT}' GROUP BY 1, 2, 3""", "v_obs"))
def q_binned_counts(spark, sf):
    t = v_obs(spark, sf).filter(F.col("activity") == TRANSECT)
    return A.binned_counts(t, ["date", "concept"], -2, "depth_meters")


@query("group_binned_counts", ops="Q9 S7 J6 P8 M5 A19", sql=with_views(f"""
    WITH lk(concept, "Group") AS (VALUES {L.brand_groups_sql()})
    SELECT o.date, lk."Group" AS "Group", round_even(o.depth_meters, -1) AS depth_meters, count(*) AS n
    FROM v_obs o LEFT JOIN lk ON o.concept = lk.concept
    WHERE o.activity = '{TRANSECT}' AND o.concept IN (SELECT concept FROM lk)
    GROUP BY 1, 2, 3""", "v_obs"))
def q_group_binned_counts(spark, sf):
    return grouped_counts(spark, v_obs(spark, sf))


@query("profiles", ops="Q10 P6 P7 M5 A3 O1", sql=with_views(
    f"WITH {_PROFILES_SQL}\nSELECT * FROM profiles ORDER BY depth", "v_obs"))
def q_profiles(spark, sf):
    return profiles(v_obs(spark, sf))


@query("profiles_long", ops="Q10 A21", sql=with_views(f"""
    WITH {_PROFILES_SQL}
    SELECT date, depth, name, value FROM profiles
    UNPIVOT INCLUDE NULLS (value FOR name IN ({", ".join(PROFILE_VARS)}))""", "v_obs"))
def q_profiles_long(spark, sf):
    return A.unpivot_long(profiles(v_obs(spark, sf)), ["date", "depth"])


@query("profile_lookup", ops="Q10 P7 P8", sql=with_views(f"""
    WITH {_PROFILES_SQL}
    SELECT * FROM profiles WHERE date = DATE '{LOOKUP_DATE}' AND depth IN {LOOKUP_DEPTHS}""", "v_obs"))
def q_profile_lookup(spark, sf):
    p = profiles(v_obs(spark, sf))
    return p.filter((F.col("date") == F.lit(LOOKUP_DATE).cast("date")) & F.col("depth").isin(*LOOKUP_DEPTHS))


# The log's concepts, dealt over the parts: the real lookup's names, and some that it lacks.
CONCEPTS = [c for c, _ in L.PREY_GROUPS] + ["Nanomia bijuga", "Solmissus", "Aegina"]
_CONCEPTS_SQL = "[" + ", ".join(f"'{c}'" for c in CONCEPTS) + "]"


@query("prey_groups", ops="S7 Q9 J6 P8 A19", sql=f"""
    WITH lk(concept, "Group") AS (VALUES {", ".join(f"('{c}', '{g}')" for c, g in L.PREY_GROUPS)}),
      log AS (SELECT {_CONCEPTS_SQL}[l_partkey % {len(CONCEPTS)} + 1] AS concept, l_extendedprice / 100 AS depth_meters FROM lineitem)
    SELECT lk."Group" AS "Group", log.concept, round_even(depth_meters, -2) AS depth_meters, count(*) AS n
    FROM log LEFT JOIN lk ON log.concept = lk.concept GROUP BY 1, 2, 3""")
def q_prey_groups(spark, sf):
    """Counts by the study's own prey groups; concepts without one have a null group."""
    names = F.array(*[F.lit(c) for c in CONCEPTS])
    log = table(spark, sf, "lineitem").select(
        F.element_at(names, (F.col("l_partkey") % len(CONCEPTS) + 1).cast("int")).alias("concept"), (F.col("l_extendedprice") / 100).alias("depth_meters"))
    return A.binned_counts(R.natural_left_join(log, F.broadcast(L.lookup(spark))), ["Group", "concept"], -2, "depth_meters")
