"""The feature table of all units' components, its gates and correlations.

Units are supplier regions and components the nations their goods leave from; periods of 100 days stand for days: the first
13 are normal, the next five a buffer, the rest the disaster."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from odresil.config import CATEGORIES as C
from odresil.operators import features as op
from odresil.operators import stats
from odresil.plans.curves import rounded
from odresil.plans.registry import query
from odresil.plans import storm
from odresil.plans.zones import KM, SHARES, centres, shares
from odresil.functions import geo
from odresil.operators import storm as tracks
from odresil.scratch import written
from odresil.sources.testdata import NATIONS, ZONE_VALUES, nation_flows, zone_values

PERIOD, NORMAL, LANDFALL = 100, 13, 18
KEYS = ["unit", "component"]
SIDES = [f"share_{side}_{c}" for side in ("from", "to") for c in C]
MEASURES = ["weight", "weight_normal", "mean_distance", "std_distance", "income_combined", "income_origin", "r0", "cum_loss", "drop_depth", "pre_cumloss", "track_km", "wind"]


def periods(spark, sf_dir):
    """(unit, component, origin, dest, t, flow): flows by period; a component is the nation its goods leave from."""
    t = F.floor(F.col("day_idx") / PERIOD).cast("int")
    flows = nation_flows(spark, sf_dir).groupBy("unit", F.col("origin").alias("component"), "origin", "dest", t.alias("t"))
    return flows.agg(F.sum("flow").alias("flow"))


def exposures(spark, sf_dir):
    """(component, track_km, wind): how near the storm's centre came, and the strongest wind, at each nation."""
    places, track = storm.places(spark, sf_dir), storm.track(spark)
    near = tracks.at_place(places, tracks.interpolate(track)).groupBy(F.col("place").alias("component")).agg(F.min("km").alias("track_km"))
    wind = tracks.wind_at(places, track).groupBy(F.col("place").alias("component")).agg(F.max("wind").alias("wind"))
    return near.join(wind, "component", "full")


def resilience(flows):
    """(unit, component, base, weight, r0, cum_loss, drop_depth, pre_cumloss) from flows by period.

    Losses are linear in the flows, so sums of flows, divided by the base at the end, give them in one pass."""
    sums = flows.groupBy(*KEYS, "t").agg(F.sum("flow").alias("flow"))
    when = lambda some, value=F.col("flow"): F.when(some, value)
    after, before = F.col("t") >= LANDFALL, F.col("t").between(NORMAL, LANDFALL - 1)
    first = sums.groupBy(*KEYS).agg(
        F.avg(when(F.col("t") < NORMAL)).alias("base"),
        F.sum(when(F.col("t") < NORMAL)).alias("weight"),
        F.max(when(F.col("t") == LANDFALL)).alias("_start"),
        F.min(when(after)).alias("_least"),
        *(f.alias(n) for n, some in (("_after", after), ("_before", before)) for f, n in ((F.count(when(some)), n), (F.sum(when(some)), f"{n}_flow"))),
    )
    loss = lambda n: F.col(n) - F.try_divide(F.col(f"{n}_flow"), F.col("base"))
    rows = first.where("base is not null")
    ratio = lambda c: F.try_divide(F.col(c), F.col("base"))
    return rows.select(*KEYS, "weight", ratio("_start").alias("r0"), loss("_after").alias("cum_loss"), (1 - ratio("_least")).alias("drop_depth"), loss("_before").alias("pre_cumloss"))


def disaster_curves(spark, sf_dir):
    """(unit, component, day, r): relative flow of each period from landfall on."""
    sums = periods(spark, sf_dir).groupBy(*KEYS, "t").agg(F.sum("flow").alias("flow"))
    base = sums.where(F.col("t") < NORMAL).groupBy(*KEYS).agg(F.avg("flow").alias("base"))
    rows = sums.where(F.col("t") >= LANDFALL).join(base, KEYS).withColumn("r", F.try_divide("flow", "base")).where("r is not null")
    return rows.select(*KEYS, (F.col("t") - LANDFALL).cast("int").alias("day"), "r")


def feature_table(spark, sf_dir, flows=None):
    """(unit, component, measures, shares at both ends): every component of every unit, with nulls where something is missing.

    Nine steps read the flows by period, so these are written first: the large tables are read and joined once."""
    flows = written(periods(spark, sf_dir), "periods") if flows is None else flows
    loads = flows.where(F.col("t") < NORMAL).groupBy(*KEYS, "origin", "dest").agg(F.sum("flow").alias("h"))
    km = geo.od_distance(loads.select("origin", "dest").distinct(), centres(spark, sf_dir))
    rows = op.od_values(op.od_values(loads.join(km, ["origin", "dest"], "left"), zone_values(spark, sf_dir), "combined").withColumnRenamed("value", "_both"), zone_values(spark, sf_dir), "origin")
    purposes = shares(spark, sf_dir).where(F.aggregate("share", F.lit(0.0), lambda a, x: a + x) > 0)
    for side, end in (("_from", "origin"), ("_to", "dest")):
        rows = rows.join(purposes.select(F.col("zone").alias(end), F.col("share").alias(side)), end, "left")
    load, known = F.col("h"), F.col("_from").isNotNull() & F.col("_to").isNotNull()
    square = op.weighted_mean(load, F.col("km") * F.col("km"))
    mean = op.weighted_mean(load, F.col("km"))
    sides = [F.try_divide(F.sum(F.when(known, load * F.get(f"_{s}", F.lit(k)))), F.sum(F.when(known, load))).alias(f"share_{s}_{c}") for s in ("from", "to") for k, c in enumerate(C)]
    # every moment of the loadings in one aggregation
    moments = rows.groupBy(*KEYS).agg(
        mean.alias("mean_distance"),
        F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std_distance"),
        op.weighted_mean(load, F.col("_both")).alias("income_combined"),
        op.weighted_mean(load, F.col("value")).alias("income_origin"),
        *sides,
    )
    out = resilience(flows).withColumn("weight_normal", F.col("weight") / F.sum("weight").over(Window.partitionBy("unit"))).join(moments, KEYS, "left")
    out = out.join(exposures(spark, sf_dir), "component", "left")
    return out.select(*KEYS, *MEASURES, *SIDES)


PERIODS = f"{NATIONS}, pf AS (SELECT unit, origin AS component, origin, dest, day_idx // {PERIOD} AS t, flow FROM nf)"
RESILIENCE = f"""{PERIODS}, ps AS (SELECT unit, component, t, sum(flow) AS flow FROM pf GROUP BY 1, 2, 3),
pb AS (SELECT unit, component, avg(flow) AS base, sum(flow) AS weight FROM ps WHERE t < {NORMAL} GROUP BY 1, 2),
pr AS (SELECT unit, component, t, weight, flow / nullif(base, 0) AS r FROM ps JOIN pb USING (unit, component)),
rs AS (SELECT unit, component, weight, max(r) FILTER (t = {LANDFALL}) AS r0, sum(1 - r) FILTER (t >= {LANDFALL}) AS cum_loss, 1 - min(r) FILTER (t >= {LANDFALL}) AS drop_depth,
  sum(1 - r) FILTER (t BETWEEN {NORMAL} AND {LANDFALL - 1}) AS pre_cumloss FROM pr GROUP BY 1, 2, 3)"""
EXPOSED = f"""{storm.SEGS}, {storm.PLACES}, tk AS (SELECT place AS component, min({storm.KM.format(b="")}) AS track_km FROM pl JOIN ip USING (basin_id) GROUP BY 1),
j AS (SELECT place, plat, plon, tr.*, {storm.KM.format(b="")} AS km, {storm.QUAD.format(b="")} AS q FROM pl JOIN tr USING (basin_id)), {storm.PROFILED},
wn AS (SELECT place AS component, max(wind)::DOUBLE AS wind FROM wd GROUP BY 1)"""
TABLE = f"""{RESILIENCE}, {SHARES}, {KM}, {ZONE_VALUES}, {EXPOSED},
ld AS (SELECT unit, component, origin, dest, sum(flow) AS h FROM pf WHERE t < {NORMAL} GROUP BY 1, 2, 3, 4),
sd0 AS (SELECT unit, component, sum(h * km) / sum(h) AS mean_distance FROM ld JOIN km USING (origin, dest) GROUP BY 1, 2),
sd1 AS (SELECT unit, component, mean_distance, sqrt(sum(h * (km - mean_distance) ** 2) / sum(h)) AS std_distance FROM ld JOIN km USING (origin, dest) JOIN sd0 USING (unit, component) GROUP BY 1, 2, 3),
vl AS (SELECT ld.*, o.value AS vo, coalesce((o.value + d.value) / 2, o.value, d.value) AS vc FROM ld LEFT JOIN zv o ON o.zone = origin LEFT JOIN zv d ON d.zone = dest),
ic AS (SELECT unit, component, sum(h * vc) / sum(h) FILTER (vc IS NOT NULL) AS income_combined, sum(h * vo) / sum(h) FILTER (vo IS NOT NULL) AS income_origin FROM vl GROUP BY 1, 2),
ft AS (SELECT unit, component, sum(h) AS mass, {", ".join(f"sum(h * o.{c}) AS f_{c}" for c in C)}, {", ".join(f"sum(h * d.{c}) AS t_{c}" for c in C)}
  FROM ld JOIN sh o ON o.zone = origin AND o.total > 0 JOIN sh d ON d.zone = dest AND d.total > 0 GROUP BY 1, 2),
tb AS (SELECT rs.*, weight / sum(weight) OVER (PARTITION BY unit) AS weight_normal, mean_distance, std_distance, income_combined, income_origin,
  track_km, wind, {", ".join(f"f_{c} / mass AS share_from_{c}" for c in C)}, {", ".join(f"t_{c} / mass AS share_to_{c}" for c in C)}
  FROM rs LEFT JOIN sd1 USING (unit, component) LEFT JOIN ic USING (unit, component) LEFT JOIN ft USING (unit, component)
  LEFT JOIN tk USING (component) LEFT JOIN wn USING (component))"""


@query(f"WITH {TABLE} SELECT unit, component, {', '.join(f'round({c}, 6) AS {c}' for c in MEASURES + SIDES)} FROM tb")
def cross_unit_features(spark, sf_dir):
    return rounded(feature_table(spark, sf_dir), *MEASURES, *SIDES)


MERGED = [f"func_{c}" for c in C]
PRODUCTS = [(a, b) for i, a in enumerate(MERGED) for b in MERGED[i + 1 :]]


def merged_table(spark, sf_dir, flows=None):
    """The feature table with merged shares func_<category> and their products, taken before any ranking."""
    rows = feature_table(spark, sf_dir, flows)
    rows = rows.withColumns({f"func_{c}": F.col(f"share_from_{c}") + F.col(f"share_to_{c}") for c in C})
    return op.interactions(rows, MERGED)


@query(f"""WITH {TABLE}, mg AS (SELECT unit, component, {", ".join(f"share_from_{c} + share_to_{c} AS func_{c}" for c in C)} FROM tb)
SELECT unit, component, {", ".join(f"round({c}, 6) AS {c}" for c in MERGED)}, {", ".join(f"round({a} * {b}, 6) AS {a}_x_{b}" for a, b in PRODUCTS)} FROM mg""")
def rank_channel_features(spark, sf_dir):
    names = [*MERGED, *(f"{a}_x_{b}" for a, b in PRODUCTS)]
    return rounded(merged_table(spark, sf_dir), *names).select(*KEYS, *names)


#: The 24 features of the rank channel: merged shares, three scalars, products of the shares.
RANK = [*MERGED, "mean_distance", "track_km", "pre_cumloss", *(f"{a}_x_{b}" for a, b in PRODUCTS)]
#: Of these, the one that keeps its scale between units.
LEVEL = "pre_cumloss"

#: Columns a component must have to enter the transfer stages.
NEEDED = ["mean_distance", "income_combined", "r0", "pre_cumloss", "track_km", *MERGED]


@query(f"""WITH {TABLE}, kept AS (SELECT * FROM tb WHERE {" AND ".join(f"{c} IS NOT NULL" for c in ["cum_loss", "mean_distance", "income_combined", "r0", "pre_cumloss", "track_km", *SIDES])})
SELECT unit, component, round(cum_loss, 6) AS cum_loss FROM kept WHERE unit IN (SELECT unit FROM kept GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT cum_loss) >= 2)""")
def listwise_gate(spark, sf_dir):
    rows = op.usable(merged_table(spark, sf_dir), ["unit"], NEEDED, "cum_loss", 3)
    return rounded(rows.select(*KEYS, "cum_loss"), "cum_loss")


PAIRED = ["mean_distance", "income_combined", "r0", "pre_cumloss"]
LONG = f"lg AS ({' UNION ALL '.join(f'''SELECT unit, component, '{c}' AS name, {c} AS x, cum_loss AS y FROM tb''' for c in PAIRED)}), lp AS (SELECT * FROM lg WHERE x IS NOT NULL AND y IS NOT NULL)"


@query(f"""WITH {TABLE}, {LONG}, rk AS (SELECT name, rank() OVER (PARTITION BY name ORDER BY x) + (count(*) OVER (PARTITION BY name, x) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY name ORDER BY y) + (count(*) OVER (PARTITION BY name, y) - 1) / 2.0 AS b FROM lp)
SELECT name, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(corr(a, b), 6) END AS rho FROM rk GROUP BY 1""")
def loss_correlations(spark, sf_dir):
    """Rank correlation of features with the loss over all components; the p-values come beside it in ``loss_correlation_p``."""
    return correlations(spark, sf_dir).select("name", "n", F.round("rho", 6).alias("rho"))


def correlations(spark, sf_dir):
    rows = feature_table(spark, sf_dir)
    long = None
    for c in PAIRED:
        one = rows.select(F.lit(c).alias("name"), F.col(c).alias("x"), F.col("cum_loss").alias("y"))
        long = one if long is None else long.unionAll(one)
    return stats.correlation(long, ["name"], "x", "y", "spearman")


@query()
def loss_correlation_p(spark, sf_dir):
    return stats.with_p_values(correlations(spark, sf_dir))


@query(f"""WITH {TABLE}, {LONG}, rk AS (SELECT unit, name, rank() OVER (PARTITION BY name, unit ORDER BY x) + (count(*) OVER (PARTITION BY name, unit, x) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY name, unit ORDER BY y) + (count(*) OVER (PARTITION BY name, unit, y) - 1) / 2.0 AS b, count(*) OVER (PARTITION BY name, unit) AS n FROM lp),
sh2 AS (SELECT name, (a - 0.5) / n AS a, (b - 0.5) / n AS b FROM rk)
SELECT name, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(corr(ra, rb), 6) END AS rho FROM (SELECT name, rank() OVER (PARTITION BY name ORDER BY a) + (count(*) OVER (PARTITION BY name, a) - 1) / 2.0 AS ra,
  rank() OVER (PARTITION BY name ORDER BY b) + (count(*) OVER (PARTITION BY name, b) - 1) / 2.0 AS rb FROM sh2) GROUP BY 1""")
def pooled_rank_correlations(spark, sf_dir):
    """The same on rank shares within units, pooled over all units."""
    rows = feature_table(spark, sf_dir)
    long = None
    for c in PAIRED:
        one = rows.select("unit", F.lit(c).alias("name"), F.col(c).alias("x"), F.col("cum_loss").alias("y"))
        long = one if long is None else long.unionAll(one)
    long = long.where("x is not null and y is not null")
    long = long.withColumns({v: F.round(stats.rank_share(v, ["name", "unit"]), 12) for v in ("x", "y")})
    out = stats.correlation(long, ["name"], "x", "y", "spearman")
    return out.select("name", "n", F.round("rho", 6).alias("rho"))
