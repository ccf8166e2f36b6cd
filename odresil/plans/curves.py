"""Queries over component curves: a component is an event type, its activity the flow that leaves it."""

from __future__ import annotations

from pyspark.sql import functions as F

from odresil.config import BANDS
from odresil.config import EVENTS as W
from odresil.operators import curves as op
from odresil.operators import flows
from odresil.plans.flows import ACTIVE, active
from odresil.plans.registry import query
from odresil.sources.testdata import TRANSITIONS, transitions

KEYS = ["component"]
DAILY = f"""{TRANSITIONS}, {ACTIVE}, dd AS (SELECT component, day_idx, coalesce(flow, 0.0) AS flow FROM
  (SELECT component, unnest(range(0, {W.days}))::INT AS day_idx FROM (SELECT DISTINCT origin AS component FROM act))
  LEFT JOIN (SELECT origin AS component, day_idx, sum(flow) AS flow FROM act GROUP BY 1, 2) USING (component, day_idx)),
bs AS (SELECT component, day_idx % 7 < 5 AS weekday, avg(flow) AS base FROM dd WHERE day_idx < {W.normal} GROUP BY 1, 2),
rc AS (SELECT component, (day_idx - {W.disaster_start})::INT AS day, flow AS activity, base, CASE WHEN base > 0 THEN flow / base END AS r
  FROM dd LEFT JOIN bs ON bs.component = dd.component AND bs.weekday = (dd.day_idx % 7 < 5) WHERE day_idx >= {W.disaster_start})""".replace("SELECT component, (day_idx", "SELECT dd.component, (day_idx")
SMOOTH = DAILY + """, sm AS (SELECT component, day, activity, base, sum(activity) OVER w / nullif(sum(base) OVER w, 0) AS r FROM rc
  WINDOW w AS (PARTITION BY component ORDER BY day ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))"""
HS = ", hs AS (SELECT origin AS component, sum(flow) / 1000 AS h FROM act GROUP BY 1)"
#: The city's own flow and its baselines, apart from the components'.
CITY = f""", cd AS (SELECT d AS day_idx, coalesce(flow, 0.0) AS flow FROM (SELECT unnest(range(0, {W.days}))::INT AS d) LEFT JOIN (SELECT day_idx AS d, sum(flow) AS flow FROM od GROUP BY 1) USING (d)),
cb AS (SELECT day_idx % 7 < 5 AS weekday, avg(flow) AS b FROM cd WHERE day_idx < {W.normal} GROUP BY 1),
cy AS (SELECT (day_idx - {W.disaster_start})::INT AS day, b AS city_base FROM cd JOIN cb ON cb.weekday = (day_idx % 7 < 5) WHERE day_idx >= {W.disaster_start})"""
COHERENT = SMOOTH + HS + CITY + """, ct AS (SELECT day, sum(activity * h) AS a, sum(r * base * h) AS p FROM sm JOIN hs USING (component) GROUP BY 1),
cf AS (SELECT day, (sum(a) OVER w / sum(city_base) OVER w) / (p / city_base) AS factor FROM ct JOIN cy USING (day) WINDOW w AS (ORDER BY day ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))"""


def daily(spark, sf_dir):
    rows = flows.dense_totals(active(spark, sf_dir).withColumnRenamed("origin", "component"), KEYS, "day_idx", W.days)
    return rows


def smoothed(spark, sf_dir):
    return op.smooth_ratio_of_sums(op.relative_curve(daily(spark, sf_dir), KEYS, W), KEYS)


def rounded(df, *names):
    return df.withColumns({c: F.round(c, 6) for c in names})


@query(f"WITH {SMOOTH} SELECT component, round(sum(1 - r), 6) AS cum_loss FROM sm GROUP BY 1")
def cum_loss_slice(spark, sf_dir):
    return smoothed(spark, sf_dir).groupBy("component").agg(F.round(F.sum(1 - F.col("r")), 6).alias("cum_loss"))


@query(f"WITH {DAILY} SELECT component, weekday, round(base, 6) AS base FROM bs")
def daily_baselines(spark, sf_dir):
    return rounded(op.baselines(daily(spark, sf_dir), KEYS, W), "base")


@query(f"WITH {DAILY} SELECT component, day, round(activity, 6) AS activity, round(base, 6) AS base, round(r, 6) AS r FROM rc")
def relative_curve(spark, sf_dir):
    return rounded(op.relative_curve(daily(spark, sf_dir), KEYS, W), "activity", "base", "r")


@query(f"WITH {SMOOTH} SELECT component, day, round(r, 6) AS r FROM sm")
def smooth_ratio_of_sums(spark, sf_dir):
    return rounded(smoothed(spark, sf_dir), "r").select("component", "day", "r")


@query(f"WITH {DAILY} SELECT component, day, round(avg(r) OVER (PARTITION BY component ORDER BY day ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS r FROM rc")
def smooth_mean_of_ratios(spark, sf_dir):
    return rounded(op.smooth_mean_of_ratios(op.relative_curve(daily(spark, sf_dir), KEYS, W), KEYS), "r").select("component", "day", "r")


def loadings(spark, sf_dir):
    return active(spark, sf_dir).groupBy(F.col("origin").alias("component")).agg((F.sum("flow") / 1000).alias("h"))


def city_base(spark, sf_dir):
    """Baselines of all flow, night slots included: the city's own series, not the components' sum."""
    return op.city_baselines(flows.dense_totals(transitions(spark, sf_dir), [], "day_idx", W.days), [], W)


def coherent(spark, sf_dir):
    return op.coherent(smoothed(spark, sf_dir).join(loadings(spark, sf_dir), "component"), KEYS, [], city_base(spark, sf_dir))


@query(f"WITH {COHERENT} SELECT component, day, round(r * factor, 6) AS r FROM sm JOIN cf USING (day)")
def coherent_curve(spark, sf_dir):
    return rounded(coherent(spark, sf_dir), "r").select("component", "day", "r")


@query(f"""WITH {SMOOTH}, mn AS (SELECT component, min(r) AS m FROM sm GROUP BY 1)
SELECT component, round(1 - min(r), 6) AS drop_depth, ({W.disaster - 1} - min(day) FILTER (r = m))::INT AS early_collapse,
  coalesce(1 + max(day) FILTER (r < 0.9), 0)::INT AS recovery_day, round(1 - avg(r) FILTER (day > {W.disaster - 4}), 6) AS recovery_deficit, round(sum(1 - r), 6) AS cum_loss
FROM sm JOIN mn USING (component) GROUP BY 1""")
def resilience_features(spark, sf_dir):
    return rounded(op.resilience(smoothed(spark, sf_dir), KEYS), "drop_depth", "recovery_deficit", "cum_loss")


@query(f"""WITH {DAILY}, rl AS (SELECT dd.component, day_idx, flow / base AS rel FROM dd JOIN bs ON bs.component = dd.component AND bs.weekday = (dd.day_idx % 7 < 5)
  WHERE day_idx BETWEEN {W.normal} AND {W.disaster_start - 1} AND base > 0),
pk AS (SELECT component, day_idx AS peak FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY rel DESC, day_idx) AS k FROM rl) WHERE k = 1)
SELECT component, round(sum(1 - rel), 6) AS pre_cumloss FROM rl JOIN pk USING (component) WHERE day_idx >= peak GROUP BY 1""")
def pre_landfall_loss(spark, sf_dir):
    return rounded(op.pre_landfall_loss(daily(spark, sf_dir), KEYS, W), "pre_cumloss")


@query(f"WITH {DAILY} SELECT component, round(sum(1 - r), 6) AS raw_loss FROM rc GROUP BY 1")
def raw_component_loss(spark, sf_dir):
    return op.relative_curve(daily(spark, sf_dir), KEYS, W).groupBy("component").agg(F.round(F.sum(1 - F.col("r")), 6).alias("raw_loss"))


SLOTS = range(W.first_slot, W.last_slot + 1)
BAND_NAMES = "[" + ", ".join(f"'{n}'" for n in BANDS) + "]"


@query(f"""WITH {TRANSITIONS}, {ACTIVE}, nd AS (SELECT component, day_idx, slot_of_day, coalesce(flow, 0.0) AS flow FROM
  (SELECT component, d AS day_idx, s AS slot_of_day FROM (SELECT DISTINCT origin AS component FROM act), (SELECT unnest(range(0, {W.normal}))::INT AS d), (SELECT unnest(range(3, 11))::INT AS s))
  LEFT JOIN (SELECT origin AS component, day_idx, slot_of_day, sum(flow) AS flow FROM act GROUP BY 1, 2, 3) USING (component, day_idx, slot_of_day)),
dt AS (SELECT component, day_idx, sum(flow) AS flow FROM nd GROUP BY 1, 2),
wr AS (SELECT component, avg(flow) FILTER (day_idx % 7 < 5) / nullif(avg(flow) FILTER (day_idx % 7 >= 5), 0) AS weekday_ratio FROM dt GROUP BY 1),
pf AS (SELECT component, slot_of_day, avg(flow) AS m FROM nd WHERE day_idx % 7 < 5 GROUP BY 1, 2),
sh AS (SELECT component, slot_of_day, coalesce(m / nullif(sum(m) OVER (PARTITION BY component), 0), 0) AS share FROM pf),
pk AS (SELECT component, slot_of_day AS top FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY share DESC, slot_of_day) AS k FROM sh) WHERE k = 1),
bd AS (SELECT component, {", ".join(f"coalesce(avg(share) FILTER (slot_of_day * 2 >= {a} AND slot_of_day * 2 + 2 <= {b}), 0) AS {n}" for n, (a, b) in BANDS.items())},
  {", ".join(f"sum(share) FILTER (slot_of_day = {s}) AS share_{2 * s}_{2 * s + 2}h" for s in SLOTS)} FROM sh GROUP BY 1),
bp AS (SELECT *, list_position([{", ".join(BANDS)}], greatest({", ".join(BANDS)})) - 1 AS band FROM bd)
SELECT component, round(weekday_ratio, 6) AS weekday_ratio, CASE WHEN weekday_ratio < 1 THEN {len(SLOTS)} ELSE top - {W.first_slot} END::INT AS peak_slot,
  CASE WHEN weekday_ratio < 1 THEN 'weekend' ELSE (top * 2) || '-' || (top * 2 + 2) || 'h' END AS peak_slot_label,
  CASE WHEN weekday_ratio < 1 THEN {len(BANDS)} ELSE band END::INT AS peak_period, CASE WHEN weekday_ratio < 1 THEN 'weekend' ELSE {BAND_NAMES}[band + 1] END AS peak_period_label,
  {", ".join(f"round({n}, 6) AS {n}" for n in BANDS)}, {", ".join(f"round(share_{2 * s}_{2 * s + 2}h, 6) AS share_{2 * s}_{2 * s + 2}h" for s in SLOTS)}
FROM wr JOIN bp USING (component) JOIN pk USING (component)""")
def temporal_features(spark, sf_dir):
    from odresil.operators.features import temporal_features as features

    out = features(active(spark, sf_dir).withColumnRenamed("origin", "component"), KEYS, W)
    return rounded(out, "weekday_ratio", *BANDS, *[f"share_{2 * s}_{2 * s + 2}h" for s in SLOTS])


@query(f"""WITH {SMOOTH}, tr AS (SELECT component, day, r AS truth FROM rc), gs AS (SELECT component, day, r AS guess FROM sm)
SELECT component, count(*) AS n, round(avg(abs(guess - truth)), 6) AS mae, round(avg(abs(guess - truth) / nullif(abs(truth), 0)), 6) AS mape,
  round(sqrt(avg((guess - truth) ** 2)) / nullif(stddev_pop(truth), 0), 6) AS nrmse, round(1 - avg((guess - truth) ** 2) / nullif(var_pop(truth), 0), 6) AS r2
FROM tr JOIN gs USING (component, day) WHERE day >= 1 GROUP BY 1""")
def curve_metrics(spark, sf_dir):
    curve = op.relative_curve(daily(spark, sf_dir), KEYS, W)
    pairs = curve.select("component", "day", F.col("r").alias("truth")).join(op.smooth_ratio_of_sums(curve, KEYS).select("component", "day", F.col("r").alias("guess")), ["component", "day"])
    return rounded(op.curve_metrics(pairs.where("day >= 1"), KEYS, "truth", "guess"), "mae", "mape", "nrmse", "r2")


@query(f"""WITH {SMOOTH}{HS}{CITY} SELECT day, round(sum(r * base * h) / any_value(city_base), 6) AS r_city FROM sm JOIN hs USING (component) JOIN cy USING (day) GROUP BY day""")
def city_reconstruction(spark, sf_dir):
    rows = smoothed(spark, sf_dir).join(loadings(spark, sf_dir), "component")
    return rounded(op.city_curve(rows, [], city_base(spark, sf_dir)), "r_city")


ARCS = 600


@query(f"""WITH {SMOOTH}, hh AS (SELECT origin AS component, origin, dest, sum(flow) / sum(sum(flow)) OVER (PARTITION BY origin) AS h FROM act WHERE day_idx < {W.normal} GROUP BY 1, 2, 3),
fc AS (SELECT day, origin, dest, sum(r * base * h) AS flow FROM sm JOIN hh USING (component) GROUP BY 1, 2, 3)
SELECT day, origin, dest, round(flow, 6) AS flow, k::INT AS k FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY abs(flow) DESC, origin, dest) AS k FROM fc WHERE abs(flow) > 1e-9) WHERE k <= {ARCS}""")
def od_forecast_topk(spark, sf_dir):
    from pyspark.sql import Window

    a = active(spark, sf_dir).where(F.col("day_idx") < W.normal)
    pairs = a.groupBy(F.col("origin").alias("component"), "origin", "dest").agg(F.sum("flow").alias("f"))
    h = pairs.withColumn("h", F.col("f") / F.sum("f").over(Window.partitionBy("component")))
    flow = smoothed(spark, sf_dir).join(h, "component").groupBy("day", "origin", "dest").agg(F.sum(F.expr("r * base * h")).alias("flow")).where("abs(flow) > 1e-9")
    rank = F.row_number().over(Window.partitionBy("day").orderBy(F.abs("flow").desc(), "origin", "dest"))
    return rounded(flow.withColumn("k", rank).where(f"k <= {ARCS}"), "flow").select("day", "origin", "dest", "flow", "k")


@query("""WITH p(component, r0, alpha, lev, strength, rate) AS (VALUES (0, 0.4, 0.3, 1.0, 0.1, 0.5), (1, 0.9, 0.8, 1.1, -0.2, 0.7), (2, 0.2, 0.1, 0.8, 0.0, 0.1)), d AS (SELECT unnest(range(0, 15))::INT AS day)
SELECT component, day, round((lev / (1 + (lev / r0 - 1) * exp(-alpha * day)) + strength * day * exp(-rate * day))::DOUBLE, 6) AS r FROM p, d""")
def curve_synthesis(spark, sf_dir):
    p = spark.createDataFrame([(0, 0.4, 0.3, 1.0, 0.1, 0.5), (1, 0.9, 0.8, 1.1, -0.2, 0.7), (2, 0.2, 0.1, 0.8, 0.0, 0.1)], "component int, r0 double, alpha double, lev double, strength double, rate double")
    rows = p.withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(14))))
    c = F.col
    return rows.select("component", "day", F.round(op.logistic(c("day"), c("r0"), c("alpha"), c("lev")) + op.pulse(c("day"), c("strength"), c("rate")), 6).alias("r"))


@query(f"""WITH {SMOOTH}, r0 AS (SELECT component, r AS r0 FROM sm WHERE day = 0),
l AS (SELECT component, sum(1 - 1 / (1 + (1 / r0 - 1) * exp(-0.35 * d))) AS loss FROM r0, (SELECT unnest(range(0, 15)) AS d) WHERE r0 > 1e-6 GROUP BY 1)
SELECT count(*) AS n, round(avg(loss), 6) AS mean_loss, round(CASE WHEN count(*) >= 2 THEN stddev_pop(loss) END, 6) AS spread FROM l""")
def backbone_spread(spark, sf_dir):
    r0 = smoothed(spark, sf_dir).where("day = 0 and r > 1e-6").select("component", F.col("r").alias("r0"))
    rows = r0.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(14))))
    loss = rows.groupBy("component").agg(F.sum(1 - op.logistic(F.col("d"), F.col("r0"), F.lit(0.35), F.lit(1.0))).alias("loss"))
    return loss.agg(F.count("*").alias("n"), F.round(F.avg("loss"), 6).alias("mean_loss"), F.round(F.when(F.count("*") >= 2, F.stddev_pop("loss")), 6).alias("spread"))


@query(f"WITH {DAILY}, ro AS (SELECT component, day_idx, CASE WHEN count(flow) OVER w = 3 THEN avg(flow) OVER w END AS m FROM dd WINDOW w AS (PARTITION BY component ORDER BY day_idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) SELECT component, day_idx, round(m, 6) AS rolling FROM ro")
def rolling_full(spark, sf_dir):
    d = daily(spark, sf_dir)
    return d.select("component", "day_idx", F.round(op.rolling_full(d, KEYS, "day_idx", "flow", 3), 6).alias("rolling"))
