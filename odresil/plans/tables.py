"""Queries of the small relational steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from odresil.config import CATEGORIES as C
from odresil.config import EVENTS as W
from odresil.operators import features as feat
from odresil.operators import flows
from odresil.operators import tables as op
from odresil.plans import cities
from odresil.plans.curves import SMOOTH, rounded, smoothed
from odresil.plans.flows import ACTIVE, active
from odresil.plans.registry import query
from odresil.sources.testdata import LAND_USE, TRANSITIONS, land_use, nation_flows, table, transitions

KEYS = ["unit", "component"]


@query(f"WITH {cities.TABLE} SELECT unit, component, round(weight, 6) AS weight, row_number() OVER (PARTITION BY unit ORDER BY weight DESC NULLS LAST, component)::INT AS place FROM tb")
def component_importance(spark, sf_dir):
    rows = cities.feature_table(spark, sf_dir).select(*KEYS, "weight")
    return rounded(op.importance_order(rows, ["unit"], "weight", ["component"]), "weight")


@query(f"WITH {cities.TABLE} SELECT unit, component, round(share_from_leisure, 6) AS share, row_number() OVER (PARTITION BY unit ORDER BY share_from_leisure DESC NULLS LAST, component)::INT AS place FROM tb")
def function_order(spark, sf_dir):
    rows = cities.feature_table(spark, sf_dir).select(*KEYS, F.col("share_from_leisure").alias("share"))
    return rounded(op.importance_order(rows, ["unit"], "share", ["component"]), "share")


@query(f"WITH {TRANSITIONS}, {ACTIVE} SELECT DISTINCT slot_idx FROM act WHERE slot_idx NOT IN (SELECT slot_idx FROM act WHERE day_idx < {W.normal} OR day_idx >= {W.disaster_start})")
def held_slots(spark, sf_dir):
    """Slots that neither the normal nor the disaster segment uses."""
    rows = active(spark, sf_dir)
    used = rows.where((F.col("day_idx") < W.normal) | (F.col("day_idx") >= W.disaster_start))
    return op.held_rows(rows.select("slot_idx").distinct(), used, ["slot_idx"])


EXCLUDED = ("1_AFRICA", "9_NOWHERE")


@query("""WITH u AS (SELECT r_regionkey || '_' || r_name AS code FROM region) SELECT code, regexp_extract(code, '^[^_]*_(.*)$', 1) AS storm FROM u WHERE code NOT IN ('1_AFRICA', '9_NOWHERE')""")
def unit_codes(spark, sf_dir):
    """Units but the excluded ones, and what their code names."""
    code = F.concat(F.col("r_regionkey").cast("string"), F.lit("_"), F.col("r_name"))
    units = table(spark, sf_dir, "region").select(code.alias("code"))
    left = op.held_rows(units, spark.createDataFrame([(x,) for x in EXCLUDED], "code string"), ["code"])
    return left.withColumn("storm", op.storm_of(F.col("code")))


@query(f"WITH {cities.TABLE} SELECT tb.unit, component, r_name AS event, round(weight * length(r_name), 6) AS exposure FROM tb JOIN region ON r_regionkey = tb.unit")
def event_constants(spark, sf_dir):
    constants = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("unit"), F.col("r_name").alias("event"))
    rows = op.with_constants(cities.feature_table(spark, sf_dir).select(*KEYS, "weight"), constants, "unit")
    return rows.select(*KEYS, "event", F.round(F.col("weight") * F.length("event"), 6).alias("exposure"))


@query(f"WITH {TRANSITIONS}, s AS (SELECT DISTINCT slot_of_day FROM od) SELECT slot_of_day, (slot_of_day * 2) || '-' || (slot_of_day * 2 + 2) || 'h' AS label, regexp_matches((slot_of_day * 2) || '-' || (slot_of_day * 2 + 2) || 'h', '^[0-9]+-[0-9]+h$') AS is_label FROM s")
def slot_labels(spark, sf_dir):
    rows = transitions(spark, sf_dir).select("slot_of_day").distinct().withColumn("label", op.slot_label(F.col("slot_of_day"), 2))
    return rows.withColumn("is_label", op.is_slot_label(F.col("label")))


@query(f"WITH d AS (SELECT unnest(range(0, {W.days}))::INT AS day_idx) SELECT day_idx, (DATE '2024-01-01' + day_idx)::DATE AS day, dayname(DATE '2024-01-01' + day_idx) AS weekday FROM d")
def calendar(spark, sf_dir):
    days = spark.range(W.days).select(F.col("id").cast("int").alias("day_idx"))
    return days.withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), F.col("day_idx"))).withColumn("weekday", F.date_format("day", "EEEE"))


@query(f"WITH {SMOOTH} SELECT component, round(list_sort(list(r))[least(floor(0.3 * count(r)), count(r) - 1)::INT + 1], 6) AS q30, round(list_sort(list(r))[least(floor(0.9 * count(r)), count(r) - 1)::INT + 1], 6) AS q90 FROM sm WHERE r IS NOT NULL GROUP BY 1")
def step_quantiles(spark, sf_dir):
    values = smoothed(spark, sf_dir).where("r is not null").groupBy("component").agg(F.collect_list("r").alias("v"))
    return values.select("component", *[F.round(op.step_quantile(F.col("v"), p), 6).alias(n) for n, p in (("q30", 0.3), ("q90", 0.9))])


EDGES = [0.0, 0.1, 0.25, 0.5, 0.8, 1.0]


@query(f"""WITH {cities.TABLE}, p AS (SELECT unit, component, (row_number() OVER (PARTITION BY unit ORDER BY cum_loss NULLS LAST, component) - 0.5) / count(*) OVER (PARTITION BY unit) AS s FROM tb)
SELECT unit, component, greatest(least(len(list_filter({EDGES}, lambda e: e < s)) - 1, {len(EDGES) - 2}), 0)::INT AS cell FROM p""")
def rank_cells(spark, sf_dir):
    rows = cities.feature_table(spark, sf_dir)
    return rows.select(*KEYS, op.quantile_cell("cum_loss", ["unit"], ["component"], EDGES).alias("cell"))


@query(f"WITH {TRANSITIONS}, t AS (SELECT slot_idx, sum(flow) AS flow FROM od GROUP BY 1) SELECT slot_idx, slot_idx - {5 * W.slots} AS position, round(flow, 6) AS flow FROM t WHERE slot_idx >= {5 * W.slots}")
def sub_series(spark, sf_dir):
    """A series from its sixth day on, and the slots its positions stand for."""
    sums = transitions(spark, sf_dir).groupBy("slot_idx").agg(F.sum("flow").alias("flow")).where(F.col("slot_idx") >= 5 * W.slots)
    rows = sums.withColumn("position", F.col("slot_idx") - 5 * W.slots)
    return rows.select(op.original_index(F.col("position"), 5 * W.slots, 0).alias("slot_idx"), "position", F.round("flow", 6).alias("flow"))


TRAIN = int(W.days * 0.7) * W.slots


@query(f"""WITH {TRANSITIONS}, t AS (SELECT slot_idx, sum(flow) AS flow FROM od GROUP BY 1), m AS (SELECT avg(flow) FILTER (slot_idx < {TRAIN}) AS mean, stddev_samp(flow) FILTER (slot_idx < {TRAIN}) AS sd FROM t)
SELECT slot_idx, CASE WHEN slot_idx < {TRAIN} THEN 'train' ELSE 'test' END AS part, round((flow - mean) / CASE WHEN sd < 1e-5 THEN 1 ELSE sd END, 6) AS scaled FROM t, m""")
def train_scaling(spark, sf_dir):
    sums = transitions(spark, sf_dir).groupBy("slot_idx").agg(F.sum("flow").alias("flow"))
    sums = sums.withColumn("part", op.day_split(F.col("slot_idx"), W.slots, W.days, 0.7))
    out = op.scaled(sums, op.train_scaling(sums, "flow", F.col("part") == "train"), "flow")
    return rounded(out.select("slot_idx", "part", "scaled"), "scaled")


STEPS = (1, 12, 84)


@query(f"""WITH {TRANSITIONS}, t AS (SELECT slot_idx, coalesce(flow, 0.0) AS flow FROM (SELECT unnest(range(0, {W.days * W.slots}))::INT AS slot_idx) LEFT JOIN (SELECT slot_idx, sum(flow) AS flow FROM od GROUP BY 1) USING (slot_idx)),
l AS ({" UNION ALL ".join(f"SELECT {k} AS step, flow AS truth, lag(flow, {k}) OVER (ORDER BY slot_idx) AS guess FROM t" for k in STEPS)})
SELECT step, count(*) AS n, round(avg((guess - truth) ** 2), 6) AS mse, round(avg(abs(guess - truth)), 6) AS mae, round(1 - avg((guess - truth) ** 2) / nullif(var_pop(truth), 0), 6) AS r2 FROM l WHERE guess IS NOT NULL GROUP BY 1""")
def step_scores(spark, sf_dir):
    """Scores of persistence over a slot, a day and a week."""
    total = flows.dense_totals(transitions(spark, sf_dir), [], "slot_idx", W.days * W.slots)
    lags = flows.lagged(total, [], "slot_idx", "flow", {f"l{k}": k for k in STEPS})
    pairs = lags.select(F.col("flow").alias("truth"), F.explode(F.array(*[F.struct(F.lit(k).alias("step"), F.col(f"l{k}").alias("guess")) for k in STEPS])).alias("s"))
    return rounded(op.step_scores(pairs.select("truth", "s.*"), "step", "truth", "guess"), "mse", "mae", "r2")


@query(f"WITH {SMOOTH}, l AS (SELECT component, sum(1 - r) AS loss FROM sm GROUP BY 1), s AS (SELECT list_sort(list({{'loss': loss, 'component': component}})) AS s FROM l WHERE loss IS NOT NULL) SELECT s[len(s) // 2 + 1].component AS component, round(s[len(s) // 2 + 1].loss, 6) AS loss FROM s WHERE len(s) > 0")
def median_fold(spark, sf_dir):
    loss = smoothed(spark, sf_dir).groupBy("component").agg(F.sum(1 - F.col("r")).alias("loss"))
    return rounded(op.median_fold(loss, "loss", "component"), "loss")


@query(f"""WITH {SMOOTH}, l AS (SELECT component, sum(1 - r) AS v FROM sm GROUP BY 1), b AS (SELECT min(v) AS lo, median(v) AS mid, max(v) AS hi FROM l)
SELECT {", ".join(f"(SELECT component FROM l, b WHERE v IS NOT NULL ORDER BY abs(v - {k}), v, component LIMIT 1) AS {n}" for n, k in (("least", "lo"), ("middle", "mid"), ("most", "hi")))}""")
def correction_units(spark, sf_dir):
    loss = smoothed(spark, sf_dir).groupBy("component").agg(F.sum(1 - F.col("r")).alias("v"))
    return op.correction_units(loss, "v", "component")


SHAPES = [("square", "POLYGON ((0 0, 4 0, 4 2, 0 2, 0 0))"), ("two", "MULTIPOLYGON (((0 0, 2 0, 2 2, 0 2, 0 0)), ((10 0, 12 0, 12 2, 10 2, 10 0)))"), ("hole", "POLYGON ((0 0, 6 0, 6 6, 0 6, 0 0), (0 0, 0 3, 3 3, 3 0, 0 0))"), ("none", None)]
CENTROIDS = [("square", 2.0, 1.0), ("two", 6.0, 1.0), ("hole", 3.5, 3.5)]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', {x}, {y})" for n, x, y in CENTROIDS) + ", ('none', NULL, NULL)) t(zone, cx, cy)")
def zone_centroids(spark, sf_dir):
    return rounded(op.outlines(spark.createDataFrame(SHAPES, "zone string, wkt string"), "wkt").select("zone", "cx", "cy"), "cx", "cy")


@query(f"""WITH {LAND_USE}, ev AS (SELECT zone, e AS event, {", ".join(f"greatest({c}, 0.0) * (e + 1) AS {c}" for c in C)} FROM lu, (SELECT unnest(range(0, 2)) AS e)),
tt AS (SELECT {", ".join(f"sum({c}) AS {c}" for c in C)}, {" + ".join(f"sum({c})" for c in C)} AS total FROM ev),
iw AS (SELECT {", ".join(f"power(ln(total / ({c} + 1e-9)), 2) AS {c}" for c in C)} FROM tt),
rw AS (SELECT zone, event, {", ".join(f"ev.{c} * iw.{c} AS {c}" for c in C)} FROM ev, iw), sh AS (SELECT *, {" + ".join(C)} AS total FROM rw)
SELECT zone, event::INT AS event, CASE WHEN total <= 0 THEN 'Unknown' WHEN greatest({", ".join(C)}) / total <= 0.4 THEN 'Mix' {" ".join(f"WHEN {c} = greatest({', '.join(C)}) THEN '{c}'" for c in C)} END AS label FROM sh""")
def global_classification(spark, sf_dir):
    """Zones of all units under one set of weights; a zone of two events counts twice."""
    masses = land_use(spark, sf_dir).withColumn("event", F.explode(F.array(F.lit(0), F.lit(1))))
    masses = masses.withColumns({c: feat.clamped(F.col(c)) * (F.col("event") + 1) for c in C})
    return feat.tf_iwf_shares(masses, feat.iwf_weights(masses)).select("zone", "event", "label")


@query()
def frame_digests(spark, sf_dir):
    """A digest of each unit's rows, to tell equal inputs."""
    rows = nation_flows(spark, sf_dir)
    return op.frame_hash(rows, ["day_idx", "origin", "dest", "flow"], "unit")
