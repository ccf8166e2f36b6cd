"""Queries of statistics operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from odresil.config import EVENTS as W
from odresil.operators import incremental, stats
from odresil.operators.curves import comparison, is_weekday
from odresil.operators.impact import METHODS, impact_period
from odresil.plans.curves import DAILY, KEYS, SMOOTH, daily, rounded, smoothed
from odresil.plans.flows import ACTIVE, SEGMENT, active
from odresil.plans.registry import query
from odresil.shipping import ship
from odresil.sources.testdata import TRANSITIONS, table

CUSTOMERS = "cu AS (SELECT c_custkey AS id, c_nationkey AS unit, round(c_acctbal / 100) AS x, (c_custkey * 7919 % 101)::DOUBLE AS y, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE abs(c_acctbal) % 50 END AS z FROM customer)"
RANK = "CASE WHEN {v} IS NOT NULL THEN rank() OVER (PARTITION BY {p} ORDER BY {v} NULLS LAST) + (count(*) OVER (PARTITION BY {p}, {v}) - 1) / 2.0 END"


def customers(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("unit"), F.round(F.col("c_acctbal") / 100).alias("x"), (F.col("c_custkey") * 7919 % 101).cast("double").alias("y"), F.when(F.col("c_custkey") % 11 != 0, F.abs("c_acctbal") % 50).alias("z"))


@query(f"WITH {CUSTOMERS} SELECT id, unit, round((({RANK.format(v='z', p='unit')}) - 0.5) / count(*) OVER (PARTITION BY unit), 6) AS share FROM cu")
def within_unit_rank(spark, sf_dir):
    return customers(spark, sf_dir).select("id", "unit", F.round(stats.rank_share("z", ["unit"]), 6).alias("share"))


LONG = f"{CUSTOMERS}, lg AS (SELECT id, 'x' AS name, x AS value FROM cu UNION ALL SELECT id, 'y', y FROM cu UNION ALL SELECT id, 'z', z FROM cu), pr AS (SELECT a.id, a.name AS a, b.name AS b, a.value AS x, b.value AS y FROM lg a JOIN lg b USING (id) WHERE a.value IS NOT NULL AND b.value IS NOT NULL)"


def long_form(spark, sf_dir):
    return customers(spark, sf_dir).select("id", F.explode(F.create_map(*[v for c in "xyz" for v in (F.lit(c), F.col(c))])).alias("name", "value"))


@query(f"WITH {LONG}, rk AS (SELECT a, b, {RANK.format(v='x', p='a, b')} AS rx, {RANK.format(v='y', p='a, b')} AS ry FROM pr) SELECT a, b, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM rk GROUP BY 1, 2")
def spearman_matrix(spark, sf_dir):
    return rounded(stats.correlations(long_form(spark, sf_dir), ["id"], "name", "value", True), "rho")


@query(f"WITH {LONG} SELECT a, b, count(*) AS n, round(corr(x, y), 6) AS rho FROM pr GROUP BY 1, 2")
def pearson_matrix(spark, sf_dir):
    return rounded(stats.correlations(long_form(spark, sf_dir), ["id"], "name", "value", False), "rho")


@query(f"WITH {CUSTOMERS} SELECT id, unit, round((x - avg(x) OVER w) / CASE WHEN stddev_pop(x) OVER w > 0 THEN stddev_pop(x) OVER w ELSE 1 END, 6) AS z FROM cu WINDOW w AS (PARTITION BY unit)")
def zscore_within(spark, sf_dir):
    return customers(spark, sf_dir).select("id", "unit", F.round(stats.z_within("x", ["unit"]), 6).alias("z"))


@query(f"WITH {CUSTOMERS}, t AS (SELECT avg(x) AS m, stddev_pop(x) AS s FROM cu WHERE unit < 20) SELECT id, unit, round((x - m) / s, 6) AS z FROM cu, t WHERE unit >= 20")
def zscore_pooled(spark, sf_dir):
    c = customers(spark, sf_dir)
    moments = c.where("unit < 20").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    return c.where("unit >= 20").join(F.broadcast(moments)).select("id", "unit", F.round((F.col("x") - F.col("m")) / F.col("s"), 6).alias("z"))  # one row


COS = "greatest(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 0)"


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").cast("double").alias("y"))


KNN = "WITH j AS (SELECT a.vec_id AS id, b.label AS y, {cos} AS w FROM embeddings a JOIN embeddings b ON {on}) SELECT id, round(coalesce(sum(w * y) / nullif(sum(w), 0), avg(y)), 6) AS pred FROM j GROUP BY 1"
LABELLED = "b.label IS NOT NULL AND b.embedding IS NOT NULL"


@query(KNN.format(cos=COS, on=f"{LABELLED} AND a.vec_id % 100 = 0"))
def cosine_knn(spark, sf_dir):
    """A search: vectors whose id 100 divides, against all labelled ones."""
    ship(spark)
    v = vectors(spark, sf_dir)
    return rounded(stats.cosine_knn(v, v.where("id % 100 = 0")), "pred")


@query(KNN.format(cos=COS, on=f"{LABELLED} AND a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id"))
def cosine_knn_loo(spark, sf_dir):
    """The same, each vector without itself."""
    ship(spark)
    v = vectors(spark, sf_dir)
    return rounded(stats.cosine_knn(v, v.where("id % 100 = 0"), leave_one_out=True), "pred")


@query(KNN.format(cos=COS, on=LABELLED))
def cosine_knn_all(spark, sf_dir):
    """Every vector against all labelled ones, in blocks."""
    ship(spark)
    v = vectors(spark, sf_dir)
    return rounded(stats.cosine_knn_blocks(v, v), "pred")


@query(KNN.format(cos=COS, on=f"{LABELLED} AND a.vec_id <> b.vec_id"))
def cosine_knn_loo_all(spark, sf_dir):
    """The same, each vector without itself."""
    ship(spark)
    v = vectors(spark, sf_dir)
    return rounded(stats.cosine_knn_blocks(v, v, leave_one_out=True), "pred")


@query(f"""WITH {TRANSITIONS}, {ACTIVE}, g AS (SELECT slot_of_day, flow, {SEGMENT} = 'normal' AS a FROM act),
c AS (SELECT slot_of_day, abs(sum(a::INT) OVER w / sum(a::INT) OVER (PARTITION BY slot_of_day) - sum((NOT a)::INT) OVER w / sum((NOT a)::INT) OVER (PARTITION BY slot_of_day)) AS gap FROM g
  WINDOW w AS (PARTITION BY slot_of_day ORDER BY flow RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT slot_of_day, round(max(gap), 6) AS ks FROM c GROUP BY 1""")
def ks_per_slot(spark, sf_dir):
    rows = active(spark, sf_dir).withColumn("a", F.col("day_idx") < W.normal)
    return rounded(stats.ks_distance(rows, ["slot_of_day"], "flow", "a"), "ks")


@query(f"WITH {CUSTOMERS}, p AS (SELECT id, (y + 1) / 103 * (id % 97 + 1) / 97 AS p FROM cu), s AS (SELECT id, p, p * count(*) OVER () / row_number() OVER (ORDER BY p, id) AS s FROM p) SELECT id, round(least(1, min(s) OVER (ORDER BY p DESC)), 6) AS q FROM s")
def bh_adjust(spark, sf_dir):
    p = customers(spark, sf_dir).select("id", ((F.col("y") + 1) / 103 * (F.col("id") % 97 + 1) / 97).alias("p"))
    return rounded(stats.bh_adjust(p, "p"), "q").select("id", "q")


@query(f"WITH {CUSTOMERS} SELECT id, unit, round(cume_dist() OVER (PARTITION BY unit ORDER BY x - m), 6) AS ecdf FROM (SELECT *, avg(x) OVER (PARTITION BY unit) AS m FROM cu)")
def ecdf_spectrum(spark, sf_dir):
    c = customers(spark, sf_dir).withColumn("d", F.col("x") - F.avg("x").over(Window.partitionBy("unit")))
    return c.select("id", "unit", F.round(F.cume_dist().over(Window.partitionBy("unit").orderBy("d")), 6).alias("ecdf"))


@query(f"""WITH {CUSTOMERS}, r AS (SELECT unit, {RANK.format(v='x', p='unit')} AS rx, {RANK.format(v='y', p='unit')} AS ry, id % 7 + 1 AS w FROM cu),
m AS (SELECT unit, sum(w) AS w, sum(w * rx) AS sx, sum(w * ry) AS sy, sum(w * rx * rx) AS sxx, sum(w * ry * ry) AS syy, sum(w * rx * ry) AS sxy FROM r GROUP BY 1)
SELECT unit, round((sxy / w - sx * sy / (w * w)) / sqrt((sxx / w - sx * sx / (w * w)) * (syy / w - sy * sy / (w * w))), 6) AS rho FROM m""")
def weighted_spearman(spark, sf_dir):
    rows = customers(spark, sf_dir).withColumn("w", F.col("id") % 7 + 1)
    return rounded(stats.weighted_spearman(rows, ["unit"], "x", "y", "w"), "rho")


@query(f"""WITH {CUSTOMERS}, c AS (SELECT unit, y, w, (sum(w) OVER (PARTITION BY unit ORDER BY y, w ROWS UNBOUNDED PRECEDING) - w / 2.0) / sum(w) OVER (PARTITION BY unit) AS c FROM (SELECT *, id % 7 + 1 AS w FROM cu)),
e AS (SELECT unit, max(c) FILTER (c <= 0.5) AS c0, min(c) FILTER (c >= 0.5) AS c1 FROM c GROUP BY 1),
v AS (SELECT unit, c0, c1, max(y) FILTER (c = c0) AS y0, min(y) FILTER (c = c1) AS y1 FROM c JOIN e USING (unit) GROUP BY 1, 2, 3)
SELECT unit, round(CASE WHEN c0 IS NULL THEN y1 WHEN c1 IS NULL THEN y0 ELSE y0 + (y1 - y0) * coalesce((0.5 - c0) / nullif(c1 - c0, 0), 0) END, 6) AS q FROM v""")
def weighted_quantile(spark, sf_dir):
    rows = customers(spark, sf_dir).withColumn("w", F.col("id") % 7 + 1)
    return rounded(stats.weighted_quantile(rows, ["unit"], "y", "w", 0.5), "q")


@query("""WITH cv AS (SELECT o_orderpriority AS unit, o_custkey % 8 + 2 AS k, (o_orderkey % 5)::INT AS rep, avg(o_totalprice) / 100000 AS err FROM orders GROUP BY 1, 2, 3),
m AS (SELECT unit, k, avg(err) AS mean, stddev_samp(err) AS sd FROM cv GROUP BY 1, 2),
b AS (SELECT unit, k AS best, mean AS least, sd AS dev FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY mean, k) AS i FROM m) WHERE i = 1)
SELECT unit, best::BIGINT AS k_min, min(k) FILTER (mean <= least + dev / sqrt(5)) AS k_lo, max(k) FILTER (mean <= least + dev / sqrt(5)) AS k_hi,
  min(k) FILTER (mean <= least + 2 * dev / sqrt(5)) AS lo_2se, max(k) FILTER (mean <= least + 2 * dev / sqrt(5)) AS hi_2se,
  min(k) FILTER (mean <= least + 2 * dev) AS lo_2sd, max(k) FILTER (mean <= least + 2 * dev) AS hi_2sd
FROM m JOIN b USING (unit) GROUP BY 1, 2""")
def rank_cv_bands(spark, sf_dir):
    """Bands around the best k by one and two standard errors and by two deviations."""
    o = table(spark, sf_dir, "orders")
    cv = o.groupBy(F.col("o_orderpriority").alias("unit"), (F.col("o_custkey") % 8 + 2).alias("k"), (F.col("o_orderkey") % 5).alias("rep")).agg((F.avg("o_totalprice") / 100000).alias("err"))
    m = cv.groupBy("unit", "k").agg(F.avg("err").alias("mean"), F.stddev_samp("err").alias("sd"))
    return incremental.bands(m, ["unit"], n=5).withColumnsRenamed({"best": "k_min", "lo_1se": "k_lo", "hi_1se": "k_hi"})


@query(f"WITH {CUSTOMERS}, u AS (SELECT unit FROM cu GROUP BY 1 HAVING count(*) >= 2) SELECT id, unit, round(x - avg(x) OVER (PARTITION BY unit), 6) AS centred FROM cu SEMI JOIN u USING (unit)")
def centred_spectra(spark, sf_dir):
    w = Window.partitionBy("unit")
    c = customers(spark, sf_dir).withColumn("n", F.count("*").over(w)).withColumn("centred", F.round(F.col("x") - F.avg("x").over(w), 6))
    return c.where("n >= 2").select("id", "unit", "centred")


#: Quantiles at which distributions are compared (fixed values).
QS = [round(0.0005 + k * 0.999 / 1999, 12) for k in range(2000)]


@query(f"""WITH {CUSTOMERS}, q AS (SELECT unit, quantile_cont(x - m, [{", ".join(map(str, QS))}]) AS qs FROM (SELECT unit, x, avg(x) OVER (PARTITION BY unit) AS m FROM cu) GROUP BY unit),
e AS (SELECT unit, unnest(qs) AS v, unnest(range(len(qs))) AS k FROM q), b AS (SELECT k, avg(v) AS bar FROM e GROUP BY 1)
SELECT unit, round(avg(abs(v - bar)), 6) AS w1, round(1 - avg(abs(v - bar)) / nullif(avg(abs(v)), 0), 6) AS skill FROM e JOIN b USING (k) GROUP BY 1""")
def w1_skill(spark, sf_dir):
    c = customers(spark, sf_dir).withColumn("d", F.col("x") - F.avg("x").over(Window.partitionBy("unit")))
    q = c.groupBy("unit").agg(F.percentile("d", F.array(*map(F.lit, QS))).alias("q")).select("unit", F.posexplode("q").alias("k", "v"))
    q = q.join(q.groupBy("k").agg(F.avg("v").alias("bar")), "k")
    w1 = F.avg(F.abs(F.col("v") - F.col("bar")))
    return q.groupBy("unit").agg(F.round(w1, 6).alias("w1"), F.round(1 - F.try_divide(w1, F.avg(F.abs("v"))), 6).alias("skill"))


COMPARE = f"{SMOOTH}, t AS (SELECT component, day, r FROM sm), f AS (SELECT component, day, r, avg(r) OVER (PARTITION BY component ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hat FROM t)"


BOUND = 1.2816


@query(f"""WITH {DAILY}, bd AS (SELECT component, day_idx % 7 < 5 AS weekday, avg(flow) AS m, coalesce(stddev_samp(flow), 0) AS sd FROM dd WHERE day_idx < {W.normal} GROUP BY 1, 2),
j AS (SELECT rc.component, day, activity, m, m + {BOUND} * sd AS up, m - {BOUND} * sd AS low FROM rc JOIN bd ON bd.component = rc.component AND bd.weekday = ((day + {W.disaster_start}) % 7 < 5))
SELECT component, day, round((activity - m) / nullif(m, 0), 6) AS pct_change, round((activity - low) / nullif(low, 0), 6) AS pct_upper, round((activity - up) / nullif(up, 0), 6) AS pct_lower FROM j""")
def comparison_frame(spark, sf_dir):
    """Activity against the day type's mean and its 80 % interval over the normal days."""
    d = daily(spark, sf_dir).withColumn("weekday", is_weekday(F.col("day_idx"), W))
    normal = d.where(F.col("day_idx") < W.normal).groupBy("component", "weekday")
    bounds = normal.agg(F.avg("flow").alias("m"), (F.coalesce(F.stddev_samp("flow"), F.lit(0.0)) * BOUND).alias("s"))
    bounds = bounds.withColumns({"up": F.col("m") + F.col("s"), "low": F.col("m") - F.col("s")})
    rows = d.where(F.col("day_idx") >= W.disaster_start).join(bounds, ["component", "weekday"])
    out = comparison(rows, "flow", "m", "up", "low").withColumn("day", (F.col("day_idx") - W.disaster_start).cast("int"))
    return out.select("component", "day", *[F.round(c, 6).alias(c) for c in ("pct_change", "pct_upper", "pct_lower")])


def _impact_sql(method: str) -> str:
    """The detector over series x (component, day): runs at or above zero by gaps and islands."""
    need = 2 if method == "consecutive" else 1
    found = "NULL" if method == "end_of_series" else f"min(day - {need - 1}) FILTER (up AND run = {need})"
    status = "'Fixed (End of Series)'" if method == "end_of_series" else "CASE WHEN back IS NOT NULL THEN 'Recovered' ELSE 'Ongoing' END"
    return f"""SELECT component, '{method}' AS method, CASE WHEN start IS NOT NULL THEN greatest(start - 1, 0) END::INT AS last_normal, round(last_value, 6) AS last_value, start::INT AS start_index,
  CASE WHEN start IS NOT NULL THEN coalesce(back, last) END::INT AS end_index, (CASE WHEN start IS NOT NULL THEN coalesce(back, last) END - start)::INT AS duration,
  CASE WHEN start IS NULL THEN 'None' ELSE {status} END AS status
FROM (SELECT component, any_value(start) AS start, max(day) AS last, max(x) FILTER (start IS NOT NULL AND day = greatest(start - 1, 0)) AS last_value, {found} AS back
  FROM (SELECT *, sum(up::INT) OVER (PARTITION BY component, island ORDER BY day) AS run FROM
    (SELECT *, sum((NOT up)::INT) OVER (PARTITION BY component ORDER BY day) AS island FROM (SELECT *, coalesce(day >= start AND x >= 0, false) AS up FROM st))) GROUP BY 1)"""


@query(f"WITH {SMOOTH}, st AS (SELECT component, day, r - 1 AS x, min(CASE WHEN r - 1 < -0.05 THEN day END) OVER (PARTITION BY component) AS start FROM sm) " + " UNION ALL ".join(map(_impact_sql, METHODS)))
def impact_window(spark, sf_dir):
    series, out = smoothed(spark, sf_dir).withColumn("x", F.col("r") - 1), None
    for method in METHODS:
        found = impact_period(series, KEYS, "x", 0.05, method, 2).withColumn("method", F.lit(method))
        out = found if out is None else out.unionByName(found)
    return out.withColumn("last_value", F.round("last_value", 6))


@query(f"""WITH {CUSTOMERS}, p AS (SELECT id, unit, [x + 20, y + 1, id % 13 + 1] AS v FROM cu), l AS (SELECT id, unit, list_transform(v, lambda e: ln(e)) AS l FROM p)
SELECT id, unit, round(l[1] - list_avg(l), 6) AS c0, round(l[2] - list_avg(l), 6) AS c1, round(l[3] - list_avg(l), 6) AS c2 FROM l""")
def clr_coriding(spark, sf_dir):
    v = F.array((F.col("x") + 20).cast("double"), (F.col("y") + 1).cast("double"), (F.col("id") % 13 + 1).cast("double"))
    rows = customers(spark, sf_dir).withColumn("l", F.transform(v, lambda e: F.log(e)))
    mean = F.aggregate("l", F.lit(0.0), lambda a, x: a + x) / F.size("l")
    return rows.select("id", "unit", *[F.round(F.get("l", F.lit(k)) - mean, 6).alias(f"c{k}") for k in range(3)])


@query(f"WITH {CUSTOMERS} SELECT unit, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept FROM cu GROUP BY 1")
def alpha_level_line(spark, sf_dir):
    return customers(spark, sf_dir).groupBy("unit").agg(F.round(F.regr_slope("y", "x"), 6).alias("slope"), F.round(F.regr_intercept("y", "x"), 6).alias("intercept"))


@query(f"WITH {CUSTOMERS} SELECT unit, round(avg(x), 6) AS location, round(stddev_pop(x), 6) AS scale, round(corr(x, y), 6) AS r FROM cu GROUP BY 1")
def location_scale(spark, sf_dir):
    return customers(spark, sf_dir).groupBy("unit").agg(F.round(F.avg("x"), 6).alias("location"), F.round(F.stddev_pop("x"), 6).alias("scale"), F.round(F.corr("x", "y"), 6).alias("r"))


@query("WITH n AS (SELECT DISTINCT count(*) AS n FROM nation GROUP BY n_regionkey UNION SELECT 6 UNION SELECT 4), e AS (SELECT n, unnest(range(0, n + 1)) AS j FROM n) SELECT DISTINCT (j // gcd(j, n))::BIGINT AS num, (n // gcd(j, n))::BIGINT AS den FROM e")
def quantile_grid_edges(spark, sf_dir):
    from odresil.functions.rational import reduced

    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").count().select(F.col("count").alias("n")).union(spark.createDataFrame([(6,), (4,)], "n long")).distinct()
    e = n.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))))
    return e.select(*reduced("j", "n")).distinct()


@query(f"""WITH {SMOOTH}, wt AS (SELECT origin AS component, dest AS purpose, sum(flow) / sum(sum(flow)) OVER (PARTITION BY origin) AS share FROM act GROUP BY 1, 2),
ex AS (SELECT component, purpose, greatest(share - avg(share) OVER (PARTITION BY purpose), 0) AS e FROM wt), w AS (SELECT component, purpose, e / nullif(sum(e) OVER (PARTITION BY purpose), 0) AS w FROM ex)
SELECT purpose, day, round(sum(w * r), 6) AS r FROM sm JOIN w USING (component) GROUP BY 1, 2""")
def trip_purpose_curves(spark, sf_dir):
    shares = active(spark, sf_dir).groupBy(F.col("origin").alias("component"), F.col("dest").alias("purpose")).agg(F.sum("flow").alias("f"))
    shares = shares.withColumn("share", F.col("f") / F.sum("f").over(Window.partitionBy("component")))
    p = Window.partitionBy("purpose")
    excess = shares.withColumn("e", F.greatest(F.col("share") - F.avg("share").over(p), F.lit(0.0))).withColumn("w", F.try_divide("e", F.sum("e").over(p)))
    return smoothed(spark, sf_dir).join(excess.select("component", "purpose", "w"), "component").groupBy("purpose", "day").agg(F.round(F.sum(F.col("w") * F.col("r")), 6).alias("r"))


