"""Queries over zones: ids, land-use shares, values and distances of pairs, components' spatial and functional features.

Zones are nations; a component is a supplier region, its loadings the quantity shipped between nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from odresil.config import CATEGORIES, DOMINANT, EPSILON
from odresil.functions import geo
from odresil.operators import features as op
from odresil.plans.curves import rounded
from odresil.plans.registry import query
from odresil.sources.testdata import LAND_USE, NATIONS, ZONE_VALUES, land_use, nation_flows, table, zone_values

C = CATEGORIES
IWF = f"""{LAND_USE}, cl AS (SELECT zone, {", ".join(f"greatest({c}, 0.0) AS {c}" for c in C)} FROM lu),
tt AS (SELECT {", ".join(f"sum({c}) AS {c}" for c in C)}, {" + ".join(f"sum({c})" for c in C)} AS total FROM cl),
iw AS (SELECT {", ".join(f"power(ln(total / ({c} + {EPSILON})), 2) AS {c}" for c in C)} FROM tt)"""
SHARES = f"""{IWF}, rw AS (SELECT zone, {", ".join(f"cl.{c} * iw.{c} AS {c}" for c in C)} FROM cl, iw),
sh AS (SELECT zone, {" + ".join(C)} AS total, {", ".join(f"coalesce({c} / nullif({' + '.join(C)}, 0), 0.0) AS {c}" for c in C)} FROM rw),
lb AS (SELECT *, CASE WHEN total <= 0 THEN 'Unknown' WHEN greatest({", ".join(C)}) <= {DOMINANT} THEN 'Mix' {" ".join(f"WHEN {c} = greatest({', '.join(C)}) THEN '{c}'" for c in C)} END AS label FROM sh)"""
LOADS = f"{NATIONS}, h AS (SELECT unit AS component, origin, dest, sum(flow) AS value FROM nf GROUP BY 1, 2, 3)"
PLACE = "(zone * 37 % 360 - 180.0)", "(zone * 13 % 120 - 60.0)"
CENTRES = f"ce AS (SELECT n_nationkey AS zone, radians({PLACE[0]}) * 6378137 AS cx, ln(tan(pi() / 4 + radians({PLACE[1]}) / 2)) * 6378137 AS cy FROM (SELECT n_nationkey, n_nationkey AS zone FROM nation))"
KM = f"{CENTRES}, km AS (SELECT a.zone AS origin, b.zone AS dest, sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) / 1000 AS km FROM ce a, ce b)"


def shares(spark, sf_dir):
    masses = land_use(spark, sf_dir)
    return op.tf_iwf_shares(masses, op.iwf_weights(masses))


def loads(spark, sf_dir):
    return nation_flows(spark, sf_dir).groupBy(F.col("unit").alias("component"), "origin", "dest").agg(F.sum("flow").alias("value"))


def centres(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("zone"))
    n = n.withColumn("lon", F.col("zone") * 37 % 360 - 180.0).withColumn("lat", F.col("zone") * 13 % 120 - 60.0)
    return n.select("zone", geo.mercator_x("lon").alias("cx"), geo.mercator_y("lat").alias("cy"))


def distances(spark, sf_dir):
    pairs = loads(spark, sf_dir).select("origin", "dest").distinct()
    return geo.od_distance(pairs, centres(spark, sf_dir))


@query("""WITH z(id) AS (VALUES ('US.TX.201.1234.1'), ('US.FL.086.000100.2'), ('US.TX.201.1234'), ('US.ZZ.001.000001.1'), ('CA.TX.001.000001.1')), s AS (SELECT id, string_split(id, '.') AS p FROM z)
SELECT id, CASE WHEN len(p) = 5 AND p[1] = 'US' AND p[2] IN ('TX', 'FL') THEN (CASE p[2] WHEN 'TX' THEN '48' ELSE '12' END) || lpad(p[3], 3, '0') || lpad(p[4], 6, '0') || p[5] END AS geoid,
  CASE WHEN len(p) = 5 AND p[1] = 'US' AND p[2] IN ('TX', 'FL') THEN (CASE p[2] WHEN 'TX' THEN '48' ELSE '12' END) || lpad(p[3], 3, '0') END AS county FROM s""")
def geoid_convert(spark, sf_dir):
    ids = spark.createDataFrame([(x,) for x in ("US.TX.201.1234.1", "US.FL.086.000100.2", "US.TX.201.1234", "US.ZZ.001.000001.1", "CA.TX.001.000001.1")], "id string")
    return ids.withColumn("geoid", geo.fips(F.col("id"))).withColumn("county", F.substring("geoid", 1, 5))


@query(f"WITH {IWF} SELECT {', '.join(f'round({c}, 6) AS {c}' for c in C)} FROM iw")
def iwf_weights(spark, sf_dir):
    return rounded(op.iwf_weights(land_use(spark, sf_dir)), *C)


@query(f"WITH {SHARES} SELECT zone, {', '.join(f'round({c}, 6) AS {c}' for c in C)}, label FROM lb")
def tf_iwf_shares(spark, sf_dir):
    return shares(spark, sf_dir).select("zone", *[F.round(F.get("share", F.lit(k)), 6).alias(c) for k, c in enumerate(C)], "label")


@query(f"WITH {SHARES} SELECT label, count(*) AS n FROM lb GROUP BY 1")
def dominant_label_counts(spark, sf_dir):
    return shares(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))


@query(f"""WITH {IWF}, ci AS (SELECT n_regionkey AS unit, {", ".join(f"sum(cl.{c}) AS {c}" for c in C)} FROM cl JOIN nation ON n_nationkey = zone GROUP BY 1),
rw AS (SELECT unit, {", ".join(f"ci.{c} * iw.{c} AS {c}" for c in C)} FROM ci, iw)
SELECT unit, {", ".join(f"round(coalesce({c} / nullif({' + '.join(C)}, 0), 0.0), 6) AS {c}" for c in C)} FROM rw""")
def city_poi_share(spark, sf_dir):
    masses = land_use(spark, sf_dir)
    region = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("zone"), F.col("n_regionkey").alias("unit"))
    city = masses.join(region, "zone").groupBy("unit").agg(*[F.sum(op.clamped(F.col(c))).alias(c) for c in C])
    return op.tf_iwf_shares(city, op.iwf_weights(masses)).select("unit", *[F.round(F.get("share", F.lit(k)), 6).alias(c) for k, c in enumerate(C)])


@query(f"WITH {SHARES} SELECT zone, round({' + '.join(C)}, 6) AS mass FROM sh WHERE total > 0")
def share_lookup(spark, sf_dir):
    total = F.aggregate("share", F.lit(0.0), lambda a, x: a + x)
    return shares(spark, sf_dir).withColumn("mass", total).where("mass > 0").select("zone", F.round("mass", 6).alias("mass"))


@query(f"""WITH {SHARES}, {LOADS}, p AS (SELECT DISTINCT origin, dest FROM h),
v AS (SELECT origin, dest, {", ".join(f"o.{c} + d.{c} AS {c}" for c in C)} FROM p JOIN sh o ON o.zone = origin JOIN sh d ON d.zone = dest WHERE o.total > 0 AND d.total > 0)
SELECT origin, dest, {", ".join(f"round({c} / sqrt({' + '.join(f'{k} * {k}' for k in C)}), 6) AS {c}" for c in C)} FROM v""")
def flow_context_features(spark, sf_dir):
    s = shares(spark, sf_dir).where(F.aggregate("share", F.lit(0.0), lambda a, x: a + x) > 0)
    pairs = loads(spark, sf_dir).select("origin", "dest").distinct()
    rows = pairs.join(s.select(F.col("zone").alias("origin"), F.col("share").alias("a")), "origin").join(s.select(F.col("zone").alias("dest"), F.col("share").alias("b")), "dest")
    rows = rows.withColumn("y", F.zip_with("a", "b", lambda a, b: a + b)).withColumn("n", F.sqrt(F.aggregate("y", F.lit(0.0), lambda a, x: a + x * x)))
    return rows.select("origin", "dest", *[F.round(F.get("y", F.lit(k)) / F.col("n"), 6).alias(c) for k, c in enumerate(C)])


@query(f"WITH {LOADS}, {KM} SELECT DISTINCT origin, dest, round(km, 6) AS km FROM h JOIN km USING (origin, dest)")
def od_distance(spark, sf_dir):
    return rounded(distances(spark, sf_dir), "km")


VALUED = f"{LOADS}, {ZONE_VALUES}, vv AS (SELECT h.*, o.value AS vo, d.value AS vd FROM h LEFT JOIN zv o ON o.zone = origin LEFT JOIN zv d ON d.zone = dest)"


@query(f"WITH {VALUED} SELECT DISTINCT origin, dest, round(coalesce((vo + vd) / 2, vo, vd), 6) AS value FROM vv")
def od_value_combined(spark, sf_dir):
    return rounded(op.od_values(loads(spark, sf_dir).select("origin", "dest").distinct(), zone_values(spark, sf_dir), "combined"), "value")


@query(f"WITH {VALUED} SELECT DISTINCT origin, dest, round(vo, 6) AS value FROM vv")
def od_value_origin(spark, sf_dir):
    return rounded(op.od_values(loads(spark, sf_dir).select("origin", "dest").distinct(), zone_values(spark, sf_dir), "origin"), "value")


@query(f"WITH {VALUED}, w AS (SELECT component, value, coalesce((vo + vd) / 2, vo, vd) AS v FROM vv) SELECT component, round(sum(value * v) / nullif(sum(value) FILTER (v IS NOT NULL), 0), 6) AS mean_value FROM w GROUP BY 1")
def weighted_value_feature(spark, sf_dir):
    rows = op.od_values(loads(spark, sf_dir).withColumnRenamed("value", "h"), zone_values(spark, sf_dir), "combined")
    return rows.groupBy("component").agg(F.round(op.weighted_mean(F.col("h"), F.col("value")), 6).alias("mean_value"))


@query(f"""WITH {LOADS}, {KM}, j AS (SELECT component, value, km FROM h JOIN km USING (origin, dest)), m AS (SELECT component, sum(value * km) / sum(value) AS mean_distance FROM j GROUP BY 1)
SELECT component, round(mean_distance, 6) AS mean_distance, round(sqrt(sum(value * (km - mean_distance) ** 2) / sum(value)), 6) AS std_distance FROM j JOIN m USING (component) GROUP BY component, mean_distance""")
def spatial_features(spark, sf_dir):
    return rounded(op.spatial_features(loads(spark, sf_dir), distances(spark, sf_dir), ["component"]), "mean_distance", "std_distance")


LONG = f"{SHARES}, ls AS ({' UNION ALL '.join(f'''SELECT zone, '{c}' AS cat, {c} AS p FROM sh WHERE total > 0''' for c in C)})"
MATRIX = f"""{LONG}, {LOADS}, mx AS (SELECT component, o.cat AS origin_cat, d.cat AS dest_cat, sum(value * o.p * d.p) AS m FROM h JOIN ls o ON o.zone = origin JOIN ls d ON d.zone = dest GROUP BY 1, 2, 3),
mp AS (SELECT component, origin_cat, dest_cat, m / nullif(sum(m) OVER (PARTITION BY component), 0) AS proportion FROM mx),
fs AS (SELECT component, cat, a AS share_from, b AS share_to FROM (SELECT component, origin_cat AS cat, sum(proportion) AS a FROM mp GROUP BY 1, 2) JOIN (SELECT component, dest_cat AS cat, sum(proportion) AS b FROM mp GROUP BY 1, 2) USING (component, cat))"""


def matrix(spark, sf_dir):
    return op.od_function_matrix(loads(spark, sf_dir), shares(spark, sf_dir), ["component"])


@query(f"WITH {MATRIX} SELECT component, origin_cat, dest_cat, round(proportion, 6) AS proportion FROM mp")
def od_function_matrix(spark, sf_dir):
    return rounded(matrix(spark, sf_dir), "proportion")


@query(f"WITH {MATRIX} SELECT component, cat, round(share_from, 6) AS share_from, round(share_to, 6) AS share_to FROM fs")
def functional_features(spark, sf_dir):
    return rounded(op.functional_shares(matrix(spark, sf_dir), ["component"]), "share_from", "share_to")


@query(f"WITH {MATRIX}, p AS (SELECT component, (share_from + share_to) / 2 AS p FROM fs) SELECT component, round(-sum(p * ln(p)), 6) AS entropy FROM p WHERE p > 0 GROUP BY 1")
def function_entropy(spark, sf_dir):
    return rounded(op.function_entropy(op.functional_shares(matrix(spark, sf_dir), ["component"]), ["component"]), "entropy")


PAIRS = [(a, b) for k, a in enumerate(C) for b in C[k + 1 :]]


@query(f"""WITH {MATRIX}, w AS (SELECT component, {", ".join(f"sum(share_from + share_to) FILTER (cat = '{c}') AS {c}" for c in C)} FROM fs GROUP BY 1)
SELECT component, {", ".join(f"round({a} * {b}, 6) AS {a}_x_{b}" for a, b in PAIRS)} FROM w""")
def interaction_features(spark, sf_dir):
    s = op.functional_shares(matrix(spark, sf_dir), ["component"])
    wide = s.groupBy("component").agg(*[F.sum(F.when(F.col("cat") == c, F.col("share_from") + F.col("share_to"))).alias(c) for c in C])
    return rounded(op.interactions(wide, list(C)), *[f"{a}_x_{b}" for a, b in PAIRS]).drop(*C)


@query(f"""WITH {LOADS}, n AS (SELECT component, sqrt(sum(value * value)) AS norm FROM h GROUP BY 1)
SELECT component, origin, dest, round(value / CASE WHEN norm > 0 THEN norm ELSE 1 END, 6) AS w, round(value * CASE WHEN norm > 0 THEN norm ELSE 1 END, 2) AS h FROM h JOIN n USING (component)""")
def normalize_factors(spark, sf_dir):
    h = loads(spark, sf_dir)
    a, b = op.normalised_factors(h, h, ["component"])
    keys = ["component", "origin", "dest"]
    return a.select(*keys, F.round("value", 6).alias("w")).join(b.select(*keys, F.round("value", 2).alias("h")), keys)


WEIGHT = f"{LOADS}, dw AS (SELECT unit AS component, sum(flow) AS w FROM nf WHERE day_idx < 1200 GROUP BY 1), wn AS (SELECT component, w * value AS weight FROM dw JOIN (SELECT component, sum(value) AS value FROM h GROUP BY 1) USING (component))"


def weights(spark, sf_dir):
    nf = nation_flows(spark, sf_dir)
    w = nf.where("day_idx < 1200").groupBy(F.col("unit").alias("component")).agg(F.sum("flow").alias("w"))
    return w.join(loads(spark, sf_dir).groupBy("component").agg(F.sum("value").alias("v")), "component").select("component", (F.col("w") * F.col("v")).alias("weight"))


@query(f"WITH {WEIGHT} SELECT component, round(weight, 2) AS weight FROM wn")
def weight_normal(spark, sf_dir):
    return weights(spark, sf_dir).select("component", F.round("weight", 2).alias("weight"))


@query(f"""WITH {WEIGHT}, t AS (SELECT component, max(value) / nullif(sum(value), 0) AS top_flow FROM h GROUP BY 1),
k AS (SELECT component, weight * count(*) OVER () / nullif(sum(weight) OVER (), 0) AS share_k, top_flow FROM wn LEFT JOIN t USING (component)),
f AS (SELECT *, NOT coalesce(share_k < 0.9 AND top_flow >= 0.004, false) AS kept FROM k)
SELECT component, round(share_k, 6) AS share_k, round(top_flow, 6) AS top_flow, kept, CASE WHEN kept THEN row_number() OVER (PARTITION BY kept ORDER BY component) - 1 END::INT AS new_component FROM f""")
def component_filter(spark, sf_dir):
    rows = op.component_filter(loads(spark, sf_dir), weights(spark, sf_dir), [], 0.9, 0.004)
    return rounded(rows, "share_k", "top_flow").drop("weight")
