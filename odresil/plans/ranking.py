"""The rank channel: which components of a unit lose most, learned from other units' components.

Features are standard scores within units, but for one that keeps its scale between units; the target is the standard score of
the loss's rank.  Fits come from sums of products (see ``operators.moments``)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odresil.operators import communities, moments, permutation, stats
from odresil.plans import cities
from odresil.plans.kernels import PENALTIES, component_table
from odresil.plans.registry import query
from odresil.scratch import written

NAMES = cities.RANK
WITHIN = [n for n in NAMES if n != cities.LEVEL]


def rank_frame(rows: DataFrame, pooled: bool = False) -> DataFrame:
    """(unit, component, target, features, y); with ``pooled`` the level feature is a standard score over all rows."""
    out = rows.withColumn("y", stats.average_rank("target", ["unit"])).select(*cities.KEYS, "target", *NAMES, "y")
    out = moments.standardised(out, "unit", [*WITHIN, "y"])
    if pooled:
        level = F.col(cities.LEVEL)
        whole = rows.agg(F.avg(level).alias("_m"), F.stddev_pop(level).alias("_s"))  # one row
        score = (level - F.col("_m")) / F.when(F.col("_s") > moments.TINY, F.col("_s")).otherwise(1.0)
        out = out.crossJoin(F.broadcast(whole)).withColumn(cities.LEVEL, score).drop("_m", "_s")
    return written(out, "ranks")


def transfer_scores(rows: DataFrame) -> DataFrame:
    """(held, component, score, target): each unit's components scored by what all other units teach."""
    frame = rank_frame(rows)
    fits = moments.ridge(frame, "unit", NAMES, "y", PENALTIES, "without", (cities.LEVEL,))
    return moments.scored(frame, "unit", NAMES, fits).select(F.col("unit").alias("held"), "component", "score", "target")


@query()
def ridge_loo(spark, sf_dir):
    """The pooled rule: coefficients of all components of all units."""
    frame = rank_frame(component_table(spark, sf_dir), pooled=True)
    fits = moments.ridge(frame, "unit", NAMES, "y", PENALTIES, "pooled")
    names = F.array(*map(F.lit, NAMES))
    return fits.select(F.posexplode("beta").alias("k", "beta"), "penalty", "intercept").select(F.get(names, F.col("k")).alias("feature"), "beta", "penalty", "intercept")


@query()
def cross_unit_transfer(spark, sf_dir):
    return transfer_scores(component_table(spark, sf_dir))


@query()
def rank_channel(spark, sf_dir):
    scores = transfer_scores(component_table(spark, sf_dir))
    out = stats.correlation(scores.withColumn("score", F.round("score", 9)), ["held"], "score", "target")
    return out.select("held", F.col("n").cast("int").alias("n"), F.col("rho").alias("spearman"))


def pair_scores(rows: DataFrame) -> DataFrame:
    """(source, held, spearman): every ordered pair of units, the rule of one unit ranking the components of another.

    A unit needs three components and two different losses, which the gate of the component table sees to."""
    frame = rank_frame(rows, pooled=True)
    fits = moments.ridge(frame, "unit", NAMES, "y", PENALTIES, "within")
    rules = F.array_sort(F.collect_list(F.struct(F.col("fold").alias("source"), "intercept", "beta")))
    every = fits.agg(rules.alias("_rules"))  # a rule for each unit, of a few dozen
    out = frame.crossJoin(F.broadcast(every)).withColumn("_rule", F.explode("_rules"))
    dot = F.aggregate(F.zip_with(F.array(*NAMES), F.col("_rule.beta"), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    scores = out.select(F.col("_rule.source").alias("source"), F.col("unit").alias("held"), F.round(dot, 9).alias("score"), "target")
    return stats.correlation(scores, ["source", "held"], "score", "target").select("source", "held", F.col("rho").alias("spearman"))


@query()
def pair_matrix(spark, sf_dir):
    return pair_scores(component_table(spark, sf_dir))


@query()
def mapping_pca(spark, sf_dir):
    """(unit, component, pc1, pc2, share1, share2, shade): all components in the plane of the two leading axes."""
    rows = component_table(spark, sf_dir)
    frame = rank_frame(rows, pooled=True)
    mean, directions, shares = moments.axes(frame, "unit", NAMES, "y")
    out = moments.projected(frame, NAMES, mean, directions, ["pc1", "pc2"])
    out = out.withColumn("_place", stats.average_rank("target", ["unit"])).withColumn("_n", F.max("_place").over(stats.Window.partitionBy("unit")))
    shade = F.lit(0.30) + F.lit(0.62) * (F.col("_place") - 1) / F.greatest(F.col("_n") - 1, F.lit(1.0))
    return out.select(*cities.KEYS, "pc1", "pc2", *(F.lit(float(s)).alias(f"share{k}") for k, s in enumerate(shares, 1)), shade.alias("shade"))


@query()
def mapping_directions(spark, sf_dir):
    """(unit, feature, coef, dx, dy): each unit's own rule and the pooled one (null), at unit length, and its shadow in the plane."""
    frame = rank_frame(component_table(spark, sf_dir), pooled=True)
    _, directions, _ = moments.axes(frame, "unit", NAMES, "y")
    own = moments.ridge(frame, "unit", NAMES, "y", PENALTIES, "within")
    rules = own.unionByName(moments.ridge(frame, "unit", NAMES, "y", PENALTIES, "pooled"))
    sum_of = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(sum_of(F.transform("beta", lambda x: x * x))) + 1e-12
    rules = rules.withColumn("beta", F.transform("beta", lambda x: x / norm))
    along = lambda axis: sum_of(F.zip_with("beta", F.array(*map(F.lit, axis)), lambda a, b: a * b))
    rules = rules.withColumns({c: along(np.asarray(d, float).tolist()) for c, d in zip(("_x", "_y"), directions)})
    length = F.hypot("_x", "_y")
    shadow = lambda c: F.when(length > 1e-9, F.col(c) / length).otherwise(0.0)
    out = rules.select(F.col("fold").alias("unit"), F.posexplode("beta").alias("k", "coef"), shadow("_x").alias("dx"), shadow("_y").alias("dy"))
    return out.select("unit", F.get(F.array(*map(F.lit, NAMES)), F.col("k")).alias("feature"), "coef", "dx", "dy")


def marginal(rows: DataFrame) -> DataFrame:
    """(unit, feature, rho): rank correlation of each feature with the loss's rank, the largest loss being 1; 0 for a constant."""
    long = rows.select("unit", F.col("target"), F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).alias("x")) for n in NAMES))).alias("_c"))
    long = long.select("unit", F.col("_c.feature").alias("feature"), F.round("_c.x", 9).alias("x"), (-F.col("target")).alias("y"))
    return stats.correlation(long, ["unit", "feature"], "x", "y").select("unit", "feature", F.coalesce("rho", F.lit(0.0)).alias("rho"))


RANKED = "rank() OVER (PARTITION BY unit, feature ORDER BY {v}) + (count(*) OVER (PARTITION BY unit, feature, {v}) - 1) / 2.0"
_SHARES = ", ".join(f"share_from_{c} + share_to_{c} AS func_{c}" for c in cities.C)
_PRODUCTS = ", ".join(f"{a} * {b} AS {a}_x_{b}" for a, b in cities.PRODUCTS)
_NEEDED = " AND ".join(f"{c} IS NOT NULL" for c in ["cum_loss", "mean_distance", "income_combined", "r0", "pre_cumloss", "track_km", *cities.SIDES])


@query(f"""WITH {cities.TABLE}, kept AS (SELECT *, {_SHARES} FROM tb WHERE {_NEEDED}),
ok AS (SELECT *, {_PRODUCTS} FROM kept WHERE unit IN (SELECT unit FROM kept GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT cum_loss) >= 2)),
lg AS ({" UNION ALL ".join(f"SELECT unit, '{n}' AS feature, round({n}, 9) AS x, -cum_loss AS y FROM ok" for n in NAMES)}),
rk AS (SELECT unit, feature, {RANKED.format(v="x")} AS a, {RANKED.format(v="y")} AS b FROM lg)
SELECT unit, feature, CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN round(corr(a, b), 6) ELSE 0.0 END + 0.0 AS rho FROM rk GROUP BY 1, 2""")
def coef_heatmap(spark, sf_dir):
    return marginal(component_table(spark, sf_dir)).withColumn("rho", F.round("rho", 6) + F.lit(0.0))  # no negative zero


@query()
def rule_alignment(spark, sf_dir):
    """(unit, feature, value, cosine, place): the heatmap's rows in order of their cosine with the pooled rule (unit null, last)."""
    rows = component_table(spark, sf_dir)
    beta = next((r["beta"] for r in moments.ridge(rank_frame(rows, pooled=True), "unit", NAMES, "y", PENALTIES, "pooled").collect()), None)
    pooled = -np.array(beta or np.zeros(len(NAMES)))  # the largest loss has rank 1 here
    pooled = pooled / (np.linalg.norm(pooled) or 1.0)
    weights = F.create_map(*(F.lit(x) for n, w in zip(NAMES, pooled.tolist()) for x in (n, w)))
    own = marginal(rows).withColumn("_w", F.element_at(weights, F.col("feature")))
    cosine = F.coalesce(F.try_divide(F.sum(F.col("rho") * F.col("_w")), F.sqrt(F.sum(F.col("rho") * F.col("rho")))), F.lit(0.0))
    order = own.groupBy("unit").agg(cosine.alias("cosine"))
    order = order.withColumn("place", F.row_number().over(stats.Window.partitionBy(F.lit(0)).orderBy(F.desc("cosine"), "unit")))  # a row a unit
    out = own.join(order, "unit").select("unit", "feature", F.col("rho").alias("value"), "cosine", "place")
    last = spark.createDataFrame([(n, float(w)) for n, w in zip(NAMES, pooled)] if beta else [], "feature string, value double")
    end = order.agg((F.coalesce(F.max("place"), F.lit(0)) + 1).cast("int").alias("place"))
    return out.unionByName(last.select(F.lit(None).cast("long").alias("unit"), "feature", "value", F.lit(1.0).alias("cosine")).crossJoin(F.broadcast(end)))


def louvain_partitions(rows: DataFrame) -> DataFrame:
    """(gamma, seed, unit, block, modularity) over how well units rank each other's components."""
    pairs = written(pair_scores(rows), "pairs")
    return written(communities.partitions(rows.select("unit").distinct(), communities.affinity(pairs, "source", "held", "spearman")), "partitions")


@query()
def louvain_blocks(spark, sf_dir):
    """Communities of units at every resolution, the first seed's."""
    return louvain_partitions(component_table(spark, sf_dir)).where("seed = 0").select("unit", "gamma", "block")


@query()
def louvain_sweep(spark, sf_dir):
    """What each resolution gives, how far seeds agree, and which one the rule chooses."""
    table = communities.sweep(louvain_partitions(component_table(spark, sf_dir)))
    best = communities.chosen(table).withColumnRenamed("gamma", "_best")
    return table.crossJoin(F.broadcast(best)).withColumn("chosen", F.col("gamma") == F.col("_best")).drop("_best")


def clusters(rows: DataFrame) -> DataFrame:
    """(unit, cluster): communities at the chosen resolution; they describe units that are known and train nothing."""
    found = louvain_partitions(rows)
    best = communities.chosen(communities.sweep(found))
    return found.where("seed = 0").join(F.broadcast(best), "gamma").select("unit", F.col("block").alias("cluster"))


def riding_scores(rows: DataFrame, names: list[str]) -> DataFrame:
    """Standard scores of the ranks, within units, of the centred log ratios of shares; null for a column that is constant."""
    logs = F.array(*(F.log(F.greatest(F.col(n), F.lit(1e-12))) for n in names))
    mean = F.aggregate(logs, F.lit(0.0), lambda s, x: s + x) / len(names)
    out = rows.withColumns({n: F.round(F.log(F.greatest(F.col(n), F.lit(1e-12))) - mean, 12) for n in names})
    out = out.withColumns({n: stats.average_rank(n, ["unit"]) for n in names})
    whole = stats.Window.partitionBy("unit")
    score = lambda n: F.try_divide(F.col(n) - F.avg(n).over(whole), F.stddev_pop(n).over(whole))
    return out.withColumns({n: score(n) for n in names})


@query()
def coriding_significance(spark, sf_dir):
    """(panel, a, b, n, rho, p, q): which categories ride together, over all units and in each of their communities.

    The 15 pairs of all communities are one family for the adjustment; the panel of all units holds the same components
    again, so its p-values stay as they are."""
    rows = component_table(spark, sf_dir)
    scores = riding_scores(rows, cities.MERGED).select(*cities.KEYS, *cities.MERGED)
    named = scores.join(F.broadcast(clusters(rows)), "unit")  # a row a unit
    panels = named.withColumn("panel", F.explode(F.array(F.lit("all"), F.concat(F.lit("c"), F.col("cluster") + 1))))
    out = written(permutation.permutation_test(panels, "panel", "unit", "component", cities.MERGED), "cells")
    family = stats.bh_adjust(out.where("panel <> 'all'"), "p")
    rest = out.where("panel = 'all' or p is null").withColumn("q", F.when(F.col("panel") == "all", F.col("p")))
    return family.unionByName(rest)


@query()
def permutation_p(spark, sf_dir):
    """Two-sided p of the correlation of income and loss, as standard scores of their ranks within units."""
    rows = component_table(spark, sf_dir)
    for v in ("income", "target"):
        rows = rows.withColumn(v, stats.average_rank(v, ["unit"]))
    rows = moments.standardised(rows.select(*cities.KEYS, "income", "target"), "unit", ["income", "target"])
    out = permutation.permutation_test(rows.withColumn("panel", F.lit("all")), "panel", "unit", "component", ["income", "target"])
    return out.select(F.col("rho").alias("observed"), "p")
