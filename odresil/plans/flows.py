"""Queries of the flow layer."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from odresil.config import EVENTS as W
from odresil.operators import flows as op
from odresil.operators import propagation, sampling
from odresil.operators.curves import baselines, is_weekday
from odresil.plans.registry import query
from odresil.scratch import written
from odresil.sources.testdata import TRANSITIONS, transitions

ACTIVE = f"act AS (SELECT * FROM od WHERE slot_of_day BETWEEN {W.first_slot} AND {W.last_slot})"
SEGMENT = f"CASE WHEN day_idx < {W.normal} THEN 'normal' WHEN day_idx < {W.disaster_start} THEN 'buffer' ELSE 'disaster' END"


def active(spark, sf_dir):
    return op.trim_slots(transitions(spark, sf_dir), W)


@query(f"WITH {TRANSITIONS}, {ACTIVE} SELECT slot_idx, origin, dest, round(flow, 6) AS flow FROM act")
def slot_trim(spark, sf_dir):
    return active(spark, sf_dir).select("slot_idx", "origin", "dest", F.round("flow", 6).alias("flow"))


@query(f"""WITH {TRANSITIONS}, m AS (SELECT (max(slot_idx) // 12 + 1) * 12 AS e FROM od)
SELECT (slot_idx - e + 240)::INT AS slot_idx, origin, dest, round(flow, 6) AS flow FROM od, m WHERE slot_idx >= e - 240 AND slot_of_day BETWEEN 3 AND 10""")
def trailing_window(spark, sf_dir):
    rows = op.trailing_days(transitions(spark, sf_dir), 20, W.slots)
    return op.trim_slots(rows, W).select("slot_idx", "origin", "dest", F.round("flow", 6).alias("flow"))


@query(f"WITH {TRANSITIONS}, {ACTIVE} SELECT DISTINCT slot_idx, {SEGMENT} AS segment FROM act WHERE {SEGMENT} IN ('normal', 'disaster')")
def segment_select(spark, sf_dir):
    return op.select_segments(active(spark, sf_dir), ["normal", "disaster"], W).select("slot_idx", "segment").distinct()


FILTERED = f"""{TRANSITIONS}, {ACTIVE}, lim AS (SELECT sum(flow) * 0.38 AS least FROM act),
z AS (SELECT zone FROM (SELECT origin AS zone, flow FROM act UNION ALL SELECT dest, flow FROM act), lim GROUP BY zone, least HAVING sum(flow) >= least),
kept AS (SELECT * FROM act WHERE origin IN (SELECT zone FROM z) AND dest IN (SELECT zone FROM z)),
fl AS (SELECT * FROM kept SEMI JOIN (SELECT origin, dest FROM kept GROUP BY 1, 2 HAVING max(flow) > 0) p USING (origin, dest))"""


@query(f"WITH {FILTERED} SELECT slot_idx, origin, dest, round(flow, 6) AS flow FROM fl")
def inactive_zone_filter(spark, sf_dir):
    rows = active(spark, sf_dir)
    least = rows.agg((F.sum("flow") * 0.38).alias("least"))  # a share of all flow, so that the threshold fits tables of any size
    return op.active_pairs(rows, least).select("slot_idx", "origin", "dest", F.round("flow", 6).alias("flow"))


@query(f"""WITH {TRANSITIONS}, {ACTIVE}, p AS (SELECT origin, dest, row_number() OVER (ORDER BY origin, dest) - 1 AS od_idx FROM (SELECT DISTINCT origin, dest FROM act)),
s AS (SELECT unnest(range(0, 360)) AS slot_idx)
SELECT od_idx::INT AS od_idx, origin, dest, s.slot_idx::INT AS slot_idx, round(coalesce(flow, 0.0), 6) AS flow FROM p CROSS JOIN s LEFT JOIN act USING (origin, dest, slot_idx)""")
def od_pivot(spark, sf_dir):
    rows = op.packed_rows(active(spark, sf_dir), W.days * W.slots)
    return rows.select("od_idx", "origin", "dest", F.posexplode("series").alias("slot_idx", "flow")).withColumn("flow", F.round("flow", 6))


@query(f"""WITH {TRANSITIONS}, {ACTIVE}, z AS (SELECT count(DISTINCT z) AS n_zones FROM (SELECT origin AS z FROM act UNION ALL SELECT dest FROM act)),
c AS (SELECT count(DISTINCT (origin, dest)) AS n_pairs, count(*) FILTER (flow > 0) AS nnz, min(flow) FILTER (flow > 0) AS min_flow,
  median(flow) FILTER (flow > 0) AS median_flow, avg(flow) FILTER (flow > 0) AS mean_flow, max(flow) AS max_flow, count(*) FILTER (flow > 0 AND flow < 1) AS below_1,
  count(*) FILTER (flow > 0 AND flow < 5) AS below_5, count(*) FILTER (flow > 0 AND flow < 10) AS below_10 FROM act)
SELECT n_pairs, nnz, round(min_flow, 6) AS min_flow, round(median_flow, 6) AS median_flow, round(mean_flow, 6) AS mean_flow, round(max_flow, 6) AS max_flow, below_1, below_5, below_10,
  n_zones, round(n_pairs / (n_zones * n_zones), 6) AS pair_share, round(1 - nnz / (n_pairs * 240), 6) AS zero_share FROM c, z""")
def matrix_diagnostics(spark, sf_dir):
    row = op.matrix_diagnostics(active(spark, sf_dir), W.days * 8)
    return row.withColumns({c: F.round(c, 6) for c in ("min_flow", "median_flow", "mean_flow", "max_flow", "pair_share", "zero_share")})


#: Positive flows of a slot of day that are kept as its sample.
SAMPLE = 40


@query(f"""WITH {TRANSITIONS}, h AS (SELECT slot_of_day, origin, dest, slot_idx, flow, md5(origin || ',' || dest || ',' || slot_idx::VARCHAR) AS hash FROM od WHERE flow > 0),
p AS (SELECT *, row_number() OVER (PARTITION BY slot_of_day ORDER BY hash, origin, dest, slot_idx)::INT AS place FROM h)
SELECT slot_of_day, origin, dest, slot_idx, place, round(flow, 6) AS flow FROM p WHERE place <= {SAMPLE}""")
def flow_samples(spark, sf_dir):
    """Sampled flows of each slot of day, for plots of observed against rebuilt values; the same for any partitioning."""
    rows = sampling.bottom_k(transitions(spark, sf_dir).where("flow > 0"), ["slot_of_day"], ["origin", "dest", "slot_idx"], SAMPLE)
    return rows.select("slot_of_day", "origin", "dest", "slot_idx", "place", F.round("flow", 6).alias("flow"))


HOP = "h{k} AS (SELECT b AS node, slot_idx, sum(value * w) AS value FROM h{j} JOIN wt ON a = node WHERE w <> 0 GROUP BY 1, 2 HAVING sum(value * w) <> 0)"


@query(f"""WITH {TRANSITIONS}, nd AS (SELECT DISTINCT origin, dest FROM od WHERE flow > 0),
ed AS (SELECT a.origin || '>' || a.dest AS a, b.origin || '>' || b.dest AS b FROM nd a JOIN nd b ON a.dest = b.origin),
dg AS (SELECT b AS node, count(*) AS n FROM ed GROUP BY 1),
wt AS (SELECT ed.a, ed.b, coalesce(1 / sqrt(x.n * y.n), 0) AS w FROM ed LEFT JOIN dg x ON x.node = ed.a JOIN dg y ON y.node = ed.b),
h0 AS (SELECT origin || '>' || dest AS node, slot_idx, sum(flow) AS value FROM od GROUP BY 1, 2 HAVING sum(flow) <> 0),
{HOP.format(k=1, j=0)}, {HOP.format(k=2, j=1)}
{" UNION ALL ".join(f"SELECT node, slot_idx, {k} AS hop, round(value, 5) AS value FROM h{k}" for k in range(3))}""")
def line_graph_hops(spark, sf_dir):
    """Flows of pairs, and what reaches each pair over one and two steps of the normalised line graph, slot by slot."""
    flows = transitions(spark, sf_dir)
    name = lambda o, d: F.concat(F.col(o), F.lit(">"), F.col(d))
    pairs = flows.where("flow > 0").select("origin", "dest").distinct()
    edges = op.line_graph(pairs, []).select(name("o1", "d1").alias("a"), name("o2", "d2").alias("b"))
    values = flows.select(name("origin", "dest").alias("node"), "slot_idx", F.col("flow").alias("value"))
    rows = propagation.hops(values, written(propagation.normalised(edges), "edges"), 2)
    return rows.withColumn("value", F.round("value", 5))


#: Target slots of the training windows, slots that a window predicts.
TARGETS, HORIZON = (21 * W.slots, 25 * W.slots - 1), 3


@query(f"""WITH {TRANSITIONS}, pr AS (SELECT DISTINCT origin, dest FROM od), sp AS (SELECT origin, dest, unnest(range(0, 360))::INT AS slot_idx FROM pr),
dn AS (SELECT origin, dest, slot_idx, coalesce(flow, 0.0) AS flow FROM sp LEFT JOIN (SELECT origin, dest, slot_idx, flow FROM od) USING (origin, dest, slot_idx)),
wn AS (SELECT origin, dest, slot_idx, {", ".join(f"lag(flow, {n}) OVER w AS i{k}" for k, n in enumerate(op.sequence_lags(W.slots).values()))}, {", ".join(f"lead(flow, {n}) OVER w AS t{n}" for n in range(HORIZON))}
  FROM dn WINDOW w AS (PARTITION BY origin, dest ORDER BY slot_idx))
SELECT ((slot_idx - {TARGETS[0]}) // 16)::INT AS batch, slot_idx, count(*)::INT AS nodes, round(sum({" + ".join(f"{k + 1} * i{k}" for k in range(16))}), 4) AS input_mix, round(sum({" + ".join(f"{n + 1} * t{n}" for n in range(HORIZON))}), 4) AS target_mix
FROM wn WHERE slot_idx BETWEEN {TARGETS[0]} AND {TARGETS[1]} GROUP BY 1, 2""")
def training_windows(spark, sf_dir):
    """Training samples of all pairs by target slot, in batches: recent, daily and weekly inputs and the targets as arrays; here
    each array is summed with the numbers of its places as weights."""
    dense = op.dense_totals(transitions(spark, sf_dir), ["origin", "dest"], "slot_idx", W.days * W.slots)
    lags = list(op.sequence_lags(W.slots).values())
    samples = propagation.windows(dense, ["origin", "dest"], "slot_idx", "flow", lags, HORIZON, *TARGETS)
    out = propagation.batches(samples, "slot_idx", ["origin", "dest"], 16)
    mixed = lambda v: F.aggregate(F.transform(v, lambda x, k: x * (k + 1)), F.lit(0.0), lambda a, x: a + x)
    mix = lambda c: F.round(F.aggregate(F.transform(c, mixed), F.lit(0.0), lambda a, x: a + x), 4)
    return out.select("batch", "slot_idx", F.size("nodes").alias("nodes"), mix("inputs").alias("input_mix"), mix("targets").alias("target_mix"))


@query(f"WITH {TRANSITIONS}, s AS (SELECT unnest(range(0, 360))::INT AS slot_idx) SELECT slot_idx, round(coalesce(sum(flow), 0.0), 6) AS flow FROM s LEFT JOIN od USING (slot_idx) GROUP BY 1")
def total_flows(spark, sf_dir):
    return op.dense_totals(transitions(spark, sf_dir), [], "slot_idx", W.days * W.slots).select("slot_idx", F.round("flow", 6).alias("flow"))


@query(f"WITH {TRANSITIONS} SELECT a.slot_idx, a.origin AS o1, a.dest AS d1, b.origin AS o2, b.dest AS d2 FROM od a JOIN od b ON a.slot_idx = b.slot_idx AND a.dest = b.origin WHERE a.flow > 0 AND b.flow > 0")
def line_graph_edges(spark, sf_dir):
    return op.line_graph(transitions(spark, sf_dir).where("flow > 0"), ["slot_idx"])


DENSE = f"""{TRANSITIONS}, pr AS (SELECT DISTINCT origin, dest FROM od), sp AS (SELECT origin, dest, unnest(range(0, 360))::INT AS slot_idx FROM pr),
dn AS (SELECT origin, dest, slot_idx, coalesce(flow, 0.0) AS flow FROM sp LEFT JOIN (SELECT origin, dest, slot_idx, flow FROM od) USING (origin, dest, slot_idx))"""


LAGS = op.sequence_lags(W.slots)


@query(f"""WITH {DENSE} SELECT origin, dest, slot_idx, round(flow, 6) AS flow, {", ".join(f"round(lag(flow, {n}) OVER w, 6) AS {name}" for name, n in LAGS.items())}
FROM dn WINDOW w AS (PARTITION BY origin, dest ORDER BY slot_idx)""")
def lag_sequences(spark, sf_dir):
    dense = op.dense_totals(transitions(spark, sf_dir), ["origin", "dest"], "slot_idx", W.days * W.slots)
    rows = op.lagged(dense, ["origin", "dest"], "slot_idx", "flow", LAGS)
    return rows.withColumns({c: F.round(c, 6) for c in ("flow", *LAGS)})


@query(f"WITH {TRANSITIONS} SELECT DISTINCT slot_idx, CASE WHEN slot_idx BETWEEN 216 AND 359 THEN slot_idx - 215 ELSE 0 END::INT AS disaster_time FROM od")
def disaster_time(spark, sf_dir):
    slots = transitions(spark, sf_dir).select("slot_idx").distinct()
    return slots.withColumn("disaster_time", op.disaster_clock(F.col("slot_idx"), W.disaster_start * W.slots, W.days * W.slots - 1))


@query(f"""WITH {TRANSITIONS}, m AS (SELECT max(slot_idx) + 1 AS n FROM od) SELECT n::INT AS n_slots, 2 AS interval_hours, n % {W.slots} = 0 AS divisible, n >= {W.days * W.slots} AS long_enough FROM m""")
def series_validation(spark, sf_dir):
    n = (F.max("slot_idx") + 1).cast("int")
    rows = transitions(spark, sf_dir).agg(n.alias("n_slots")).withColumn("interval_hours", F.lit(2))
    return rows.withColumns({"divisible": F.col("n_slots") % W.slots == 0, "long_enough": F.col("n_slots") >= W.days * W.slots})


@query(f"WITH {TRANSITIONS} SELECT slot_idx, origin, dest, round(flow, 6) AS flow FROM od WHERE slot_idx < {20 * W.slots}")
def head_days(spark, sf_dir):
    rows = transitions(spark, sf_dir)
    slots = F.max("slot_of_day") + 1  # what the data say, so that the checks can fail
    meta = rows.agg(((F.max("day_idx") + 1) * slots).alias("n_slots"), (F.lit(24) / slots).alias("interval_hours"))
    return op.head_days(rows, meta, 20, W.slots).select("slot_idx", "origin", "dest", F.round("flow", 6).alias("flow"))


@query(f"""WITH {TRANSITIONS}, {ACTIVE}, d AS (SELECT day_idx, sum(flow) AS flow FROM act GROUP BY 1),
b AS (SELECT day_idx % 7 < 5 AS wd, avg(flow) AS base FROM d WHERE day_idx < {W.normal} GROUP BY 1),
r AS (SELECT day_idx - {W.disaster_start} AS day, flow / nullif(base, 0) AS r FROM d JOIN b ON (d.day_idx % 7 < 5) = b.wd WHERE day_idx >= {W.normal})
SELECT min(day) FILTER (r = (SELECT min(r) FROM r))::INT AS min_day, round(min(r), 6) AS min_value, round(max(r) FILTER (day = 0), 6) AS landfall_value,
  round(max(r) FILTER (day < 0), 6) AS pre_peak, round(max(r) FILTER (day = {W.disaster - 1}), 6) AS end_value, round(sum(1 - r) FILTER (day >= 0), 6) AS cum_loss FROM r""")
def city_mobility_summary(spark, sf_dir):
    """A city's own relative curve over buffer and disaster: its minimum, landfall, the peak before it, and the end."""
    days = op.dense_totals(active(spark, sf_dir), [], "day_idx", W.days)
    weekday = is_weekday(F.col("day_idx"), W)
    r = days.withColumn("weekday", weekday).join(F.broadcast(baselines(days, [], W)), "weekday")  # two rows
    r = r.where(F.col("day_idx") >= W.normal).select((F.col("day_idx") - W.disaster_start).alias("day"), F.try_divide("flow", "base").alias("r")).where("r is not null")
    at = lambda some: F.round(F.max(F.when(some, F.col("r"))), 6)
    return r.agg(
        F.min_by("day", F.struct("r", "day")).cast("int").alias("min_day"),
        F.round(F.min("r"), 6).alias("min_value"),
        at(F.col("day") == 0).alias("landfall_value"),
        at(F.col("day") < 0).alias("pre_peak"),
        at(F.col("day") == W.disaster - 1).alias("end_value"),
        F.round(F.sum(F.when(F.col("day") >= 0, 1 - F.col("r"))), 6).alias("cum_loss"),
    )
