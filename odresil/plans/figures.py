"""The tables behind figures: exposure against loss, distributions, lines, purposes, context features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from odresil.config import CATEGORIES as C
from odresil.functions import geo
from odresil.operators import stats
from odresil.operators.features import flow_context
from odresil.plans import cities
from odresil.plans.curves import rounded
from odresil.plans.registry import query
from odresil.plans.zones import LOADS, SHARES, loads, shares
from odresil.sources.testdata import table

#: Definitions of exposure, each a column of the feature table.
EXPOSURES = ("track_km", "wind", "pre_cumloss", "r0")


def exposures(spark, sf_dir):
    rows, out = cities.feature_table(spark, sf_dir), None
    for c in EXPOSURES:
        one = rows.select("unit", "component", F.lit(c).alias("exposure"), F.col(c).alias("x"), F.col("cum_loss").alias("y"), F.col("weight_normal").alias("w"))
        out = one if out is None else out.unionAll(one)
    return out.where("x is not null and y is not null")


LONG = f"xl AS ({' UNION ALL '.join(f'''SELECT unit, component, '{c}' AS exposure, {c} AS x, cum_loss AS y, weight_normal AS w FROM tb''' for c in EXPOSURES)}), xs AS (SELECT * FROM xl WHERE x IS NOT NULL AND y IS NOT NULL)"
RANKED = """rk AS (SELECT exposure, w, rank() OVER (PARTITION BY exposure ORDER BY x) + (count(*) OVER (PARTITION BY exposure, x) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY exposure ORDER BY y) + (count(*) OVER (PARTITION BY exposure, y) - 1) / 2.0 AS b FROM xs),
mo AS (SELECT exposure, sum(w) AS sw, sum(w * a) / sum(w) AS ma, sum(w * b) / sum(w) AS mb FROM rk GROUP BY 1)"""


@query(f"""WITH {cities.TABLE}, {LONG}, {RANKED}
SELECT exposure, round(sum(w * (a - ma) * (b - mb)) / nullif(sqrt(sum(w * (a - ma) ** 2) * sum(w * (b - mb) ** 2)), 0), 6) AS rho FROM rk JOIN mo USING (exposure) GROUP BY 1""")
def exposure_vs_loss(spark, sf_dir):
    """Weighted rank correlation of every definition of exposure with the loss."""
    return rounded(stats.weighted_spearman(exposures(spark, sf_dir), ["exposure"], "x", "y", "w"), "rho")


def _quantile_sql(p: float) -> str:
    return f"""(SELECT unit, CASE WHEN max(v) FILTER (c <= {p}) IS NULL THEN min(v) WHEN max(v) FILTER (c >= {p}) IS NULL THEN max(v) ELSE
  arg_max(v, c) FILTER (c <= {p}) + (arg_min(v, c) FILTER (c >= {p}) - arg_max(v, c) FILTER (c <= {p})) * coalesce(({p} - max(c) FILTER (c <= {p})) / nullif(min(c) FILTER (c >= {p}) - max(c) FILTER (c <= {p}), 0), 0) END AS q FROM cm GROUP BY 1)"""


@query(f"""WITH {cities.TABLE}, cm AS (SELECT unit, cum_loss AS v, (sum(weight_normal) OVER (PARTITION BY unit ORDER BY cum_loss, weight_normal ROWS UNBOUNDED PRECEDING) - weight_normal / 2) / sum(weight_normal) OVER (PARTITION BY unit) AS c FROM tb WHERE cum_loss IS NOT NULL)
SELECT unit, round(a.q, 6) AS q25, round(b.q, 6) AS q50, round(d.q, 6) AS q75 FROM {_quantile_sql(0.25)} a JOIN {_quantile_sql(0.5)} b USING (unit) JOIN {_quantile_sql(0.75)} d USING (unit)""")
def weighted_loss_quantiles(spark, sf_dir):
    """Median and quartiles of the losses of each unit, by weight."""
    rows, out = cities.feature_table(spark, sf_dir).where("cum_loss is not null").select("unit", "cum_loss", "weight_normal"), None
    for name, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
        one = stats.weighted_quantile(rows, ["unit"], "cum_loss", "weight_normal", p).withColumnRenamed("q", name)
        out = one if out is None else out.join(one, "unit")
    return rounded(out, "q25", "q50", "q75")


BINS = 8


@query(f"""WITH {cities.TABLE}, b AS (SELECT min(cum_loss) AS lo, max(cum_loss) AS hi FROM tb), h AS (SELECT least(floor((cum_loss - lo) / nullif(hi - lo, 0) * {BINS}), {BINS - 1})::INT AS bin, lo, hi FROM tb, b WHERE cum_loss IS NOT NULL)
SELECT coalesce(bin, 0) AS bin, count(*) AS n, round(any_value(lo + (hi - lo) * coalesce(bin, 0) / {BINS}), 6) AS left_edge FROM h GROUP BY 1""")
def loss_histogram(spark, sf_dir):
    rows = cities.feature_table(spark, sf_dir).where("cum_loss is not null").select("cum_loss")
    both = rows.crossJoin(F.broadcast(rows.agg(F.min("cum_loss").alias("lo"), F.max("cum_loss").alias("hi"))))  # one row
    place = F.try_divide(F.col("cum_loss") - F.col("lo"), F.col("hi") - F.col("lo")) * BINS
    both = both.withColumn("bin", F.coalesce(F.least(F.floor(place), F.lit(BINS - 1)), F.lit(0)).cast("int"))
    left = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("bin") / BINS
    return both.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.first(left), 6).alias("left_edge"))


POINTS = 21


@query(f"""WITH {cities.TABLE}, v AS (SELECT cum_loss AS x FROM tb WHERE cum_loss IS NOT NULL), m AS (SELECT min(x) AS lo, max(x) AS hi, stddev_samp(x) * power(count(*), -0.2) AS h, count(*) AS n FROM v),
g AS (SELECT k, lo + (hi - lo) * k / {POINTS - 1} AS pt FROM m, (SELECT unnest(range(0, {POINTS}))::INT AS k))
SELECT k, round(any_value(pt), 6) AS point, round(sum(exp(-0.5 * ((pt - x) / h) ** 2)) / any_value(n * h * sqrt(2 * pi())), 6) AS density FROM g, v, m GROUP BY k""")
def loss_density(spark, sf_dir):
    """Kernel density of the losses at evenly spaced points, a grid of fixed size."""
    rows = cities.feature_table(spark, sf_dir).where("cum_loss is not null").select(F.col("cum_loss").alias("x"))
    m = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), (F.stddev_samp("x") * F.pow(F.count("*"), F.lit(-0.2))).alias("h"), F.count("*").alias("n"))
    both = rows.crossJoin(F.broadcast(m)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(POINTS - 1))))  # one row
    both = both.withColumn("at", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("k") / (POINTS - 1))
    density = F.sum(F.exp(-F.pow((F.col("at") - F.col("x")) / F.col("h"), 2) / 2)) / F.first(F.col("n") * F.col("h") * F.sqrt(2 * F.pi()))
    return both.groupBy("k").agg(F.round(F.first("at"), 6).alias("point"), F.round(density, 6).alias("density"))


@query(f"WITH {cities.TABLE} SELECT unit, round(regr_slope(cum_loss, mean_distance), 6) AS slope, round(regr_intercept(cum_loss, mean_distance), 6) AS intercept, round(regr_r2(cum_loss, mean_distance), 6) AS r2 FROM tb WHERE cum_loss IS NOT NULL AND mean_distance IS NOT NULL GROUP BY 1 HAVING count(*) >= 3")
def loss_distance_lines(spark, sf_dir):
    rows = cities.feature_table(spark, sf_dir).where("cum_loss is not null and mean_distance is not null")
    line = {"slope": F.regr_slope, "intercept": F.regr_intercept, "r2": F.regr_r2}
    out = rows.groupBy("unit").agg(F.count("*").alias("_n"), *[F.round(f("cum_loss", "mean_distance"), 6).alias(n) for n, f in line.items()])
    return out.where("_n >= 3").drop("_n")


CURVES = """cv AS (SELECT unit, component, t - 18 AS day, r FROM pr WHERE t >= 18 AND r IS NOT NULL),
pw0 AS (SELECT unit, component, cat, greatest(s - avg(s) OVER (PARTITION BY unit, cat), 0) AS e FROM fl),
pw AS (SELECT unit, component, cat, e / nullif(sum(e) OVER (PARTITION BY unit, cat), 0) AS w FROM pw0),
pc AS (SELECT unit, cat, day, sum(w * r) AS r FROM cv JOIN pw USING (unit, component) WHERE w IS NOT NULL GROUP BY 1, 2, 3),
lo AS (SELECT unit, cat, sum(1 - r) AS loss FROM pc GROUP BY 1, 2)"""


@query(f"""WITH {cities.TABLE}, fl AS ({' UNION ALL '.join(f'''SELECT unit, component, '{c}' AS cat, share_from_{c} + share_to_{c} AS s FROM tb WHERE share_from_{c} IS NOT NULL''' for c in C)}), {CURVES}
SELECT cat AS purpose, count(*) AS n_units, round(avg(loss), 6) AS cum_loss, round(stddev_samp(loss) / sqrt(count(*)), 6) AS cum_loss_se, row_number() OVER (ORDER BY avg(loss), cat)::INT AS place FROM lo GROUP BY 1""")
def purpose_summary(spark, sf_dir):
    """Loss by trip purpose: a unit's curve weights its components by their excess share of the purpose; units count the same."""
    loss = purpose_curves(spark, sf_dir).groupBy("unit", "purpose").agg(F.sum(1 - F.col("r")).alias("loss"))
    out = loss.groupBy("purpose").agg(F.count("*").alias("n_units"), F.avg("loss").alias("cum_loss"), (F.stddev_samp("loss") / F.sqrt(F.count("*"))).alias("cum_loss_se"))
    out = out.withColumn("place", F.row_number().over(Window.orderBy("cum_loss", "purpose")))  # a row for each purpose
    return rounded(out, "cum_loss", "cum_loss_se")


def purpose_curves(spark, sf_dir):
    """(unit, purpose, day, r)."""
    rows = cities.feature_table(spark, sf_dir)
    pairs = [F.struct(F.lit(c).alias("purpose"), (F.col(f"share_from_{c}") + F.col(f"share_to_{c}")).alias("s")) for c in C]
    shares_of = rows.select("unit", "component", F.explode(F.array(*pairs)).alias("p")).select("unit", "component", "p.*").where("s is not null")
    by = Window.partitionBy("unit", "purpose")
    excess = shares_of.withColumn("e", F.greatest(F.col("s") - F.avg("s").over(by), F.lit(0.0)))
    weights = excess.withColumn("w", F.try_divide("e", F.sum("e").over(by))).where("w is not null")
    return cities.disaster_curves(spark, sf_dir).join(weights, ["unit", "component"]).groupBy("unit", "purpose", "day").agg(F.sum(F.col("w") * F.col("r")).alias("r"))


@query(f"""WITH {cities.TABLE}, fl AS ({' UNION ALL '.join(f'''SELECT unit, component, '{c}' AS cat, share_from_{c} + share_to_{c} AS s FROM tb WHERE share_from_{c} IS NOT NULL''' for c in C)}), {CURVES}
SELECT cat AS purpose, day::INT AS day, count(*) AS n_units, round(avg(r), 6) AS r, round(stddev_samp(r) / sqrt(count(*)), 6) AS se FROM pc GROUP BY 1, 2""")
def purpose_curves_pooled(spark, sf_dir):
    out = purpose_curves(spark, sf_dir).groupBy("purpose", "day")
    out = out.agg(F.count("*").alias("n_units"), F.avg("r").alias("r"), (F.stddev_samp("r") / F.sqrt(F.count("*"))).alias("se"))
    return rounded(out, "r", "se")


OUTER = [(a, b) for a in C for b in C]


@query(f"""WITH {SHARES}, {LOADS}, p AS (SELECT origin, dest, sqrt(sum(value * value)) AS scale FROM h GROUP BY 1, 2),
v AS (SELECT origin, dest, scale, coalesce(o.total > 0 AND d.total > 0, false) AS constrained, {", ".join(f"o.{a} * d.{b} AS {a}_{b}" for a, b in OUTER)} FROM p LEFT JOIN sh o ON o.zone = origin LEFT JOIN sh d ON d.zone = dest)
SELECT origin, dest, constrained, {", ".join(f"round(CASE WHEN constrained THEN scale * {a}_{b} / sqrt({' + '.join(f'{x}_{y} * {x}_{y}' for x, y in OUTER)}) ELSE 0 END, 6) AS {a}_{b}" for a, b in OUTER)} FROM v""")
def flow_context_outer(spark, sf_dir):
    """Context vectors of the pairs in outer mode, as long as the pair's flow is large: 36 cells."""
    scale = loads(spark, sf_dir).groupBy("origin", "dest").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("scale"))
    rows = flow_context(scale, shares(spark, sf_dir), "outer", "scale")
    return rows.select("origin", "dest", "constrained", *[F.round(F.get("context", F.lit(k)), 6).alias(f"{a}_{b}") for k, (a, b) in enumerate(OUTER)])


@query("""WITH c AS (SELECT 'US.' || CASE c_nationkey % 2 WHEN 0 THEN 'TX' ELSE 'FL' END || '.' || (c_custkey % 300) || '.' || (c_custkey % 9000) || '.' || (c_custkey % 5) AS id, c_acctbal AS v FROM customer),
g AS (SELECT CASE split_part(id, '.', 2) WHEN 'TX' THEN '48' ELSE '12' END || lpad(split_part(id, '.', 3), 3, '0') || lpad(split_part(id, '.', 4), 6, '0') || split_part(id, '.', 5) AS geoid, v FROM c)
SELECT substr(geoid, 1, 5) AS county, count(*) AS n, round(avg(v), 4) AS mean FROM g GROUP BY 1""")
def geoid_join(spark, sf_dir):
    """Values that carry a dotted zone id, joined by geoid with a table that has counties."""
    c = table(spark, sf_dir, "customer")
    state = F.when(F.col("c_nationkey") % 2 == 0, "TX").otherwise("FL")
    part = lambda n: (F.col("c_custkey") % n).cast("string")
    rows = c.select(F.concat_ws(".", F.lit("US"), state, part(300), part(9000), part(5)).alias("id"), "c_acctbal")
    zones = rows.select("id").distinct().withColumn("geoid", geo.fips(F.col("id"))).withColumn("county", F.substring("geoid", 1, 5))
    return rows.join(zones, "id").groupBy("county").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"))
