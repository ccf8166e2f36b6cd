"""Queries whose core is a grouped kernel: factorisation, fits and transfer between units.

Units are regions and components nations; matrices are packed per unit, one task each, features are a few rows a unit."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odresil.config import CATEGORIES, EVENTS
from odresil.kernels import backbone, citywide, factor, purpose, shape, solve
from odresil.operators import curves, factorise, incremental, moments
from odresil.operators.features import component_filter, flow_context, usable
from odresil.operators.flows import least_activity
from odresil.plans import cities
from odresil.plans.curves import smoothed
from odresil.plans.registry import query
from odresil.plans.zones import shares
from odresil.scratch import folder, written
from odresil.shipping import ship
from odresil.sources.testdata import nation_flows

PERIOD, FIT = 42, 45
NAMES = [*cities.MERGED, "mean_distance", "income", "r0"]
SWEEPS = 5_000
#: Rounds of the factorisation in blocks, each a pass over all units; days whose least activity a zone must reach.
BLOCK_SWEEPS, LEAST_DAYS = 12, 1
#: Candidate ranks of cross-validation, bounded by a unit's matrix, and its independent masks.
RANKS, REPEATS = (*range(1, 13), 15, 18, 21, 25, 30, 35, 40), 5
PENALTIES = np.logspace(-3, 3, 13)


def matrices(spark, sf_dir) -> DataFrame:
    """(unit, origin, dest, series): flows by periods of six weeks, from the first to the last period of the table."""
    ship(spark)
    f = nation_flows(spark, sf_dir).groupBy("unit", "origin", "dest", F.floor(F.col("day_idx") / PERIOD).cast("int").alias("t")).agg(F.sum("flow").alias("flow"))
    last = F.broadcast(f.agg(F.max("t").alias("last")))  # one row
    m = f.groupBy("unit", "origin", "dest").agg(F.map_from_entries(F.collect_list(F.struct("t", "flow"))).alias("m")).crossJoin(last)
    return m.select("unit", "origin", "dest", F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("series"))


def dense(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """The unit's pairs in order and its matrix [slot, pair]."""
    pdf = pdf.sort_values(["origin", "dest"]).reset_index(drop=True)
    return pdf, np.array(pdf["series"].tolist()).T


@query()
def nmf_cd(spark, sf_dir):
    def run(pdf):
        pdf, x = dense(pdf)
        w, h = factor.nmf(x, 3, l1=0.1, sweeps=SWEEPS)
        return pd.DataFrame([(int(pdf.unit[0]), j, float(w[:, j].sum()), float(h[j].sum()), factor.relative_error(x, w, h)) for j in range(3)], columns=["unit", "component", "w_sum", "h_sum", "error"])

    return matrices(spark, sf_dir).groupBy("unit").applyInPandas(run, "unit long, component int, w_sum double, h_sum double, error double")


@query()
def nmf_project(spark, sf_dir):
    def run(pdf):
        pdf, x = dense(pdf)
        _, h = factor.nmf(x[:FIT], 3)
        w = factor.project(x, h)
        return pd.DataFrame([(int(pdf.unit[0]), t, j, float(w[t, j])) for t in range(len(x)) for j in range(3)], columns=["unit", "slot_idx", "component", "value"])

    return matrices(spark, sf_dir).groupBy("unit").applyInPandas(run, "unit long, slot_idx int, component int, value double")


@query()
def nmf_context(spark, sf_dir):
    """Factors under a context: the sum of both ends' shares, at unit length times the length of the pair's series."""
    x = matrices(spark, sf_dir)
    x = x.withColumn("scale", F.sqrt(F.aggregate("series", F.lit(0.0), lambda a, v: a + v * v)))
    rows = flow_context(x, shares(spark, sf_dir), "sum", "scale")

    def run(pdf):
        pdf, x = dense(pdf)
        known, y = pdf.constrained.to_numpy(bool), np.array(pdf.context.tolist(), float)
        w, h, g = factor.nmf_context(x, y, known.astype(float), 3)
        return pd.DataFrame([(int(pdf.unit[0]), j, CATEGORIES[c], float(g[j, c]), factor.relative_error(x, w, h)) for j in range(3) for c in range(6)], columns=["unit", "component", "cat", "value", "error"])

    return rows.groupBy("unit").applyInPandas(run, "unit long, component int, cat string, value double, error double")


@query()
def nmf_quality(spark, sf_dir):
    def run(pdf):
        pdf, x = dense(pdf)
        _, h = factor.nmf(x[:FIT], 3)
        w = factor.project(x, h)
        small = int((w.sum(0) * h.sum(1) < 0.01 * (w.sum(0) * h.sum(1)).max()).sum())
        return pd.DataFrame([(int(pdf.unit[0]), factor.relative_error(x, w, h), factor.relative_error(x[:FIT], w[:FIT], h), factor.relative_error(x[FIT:], w[FIT:], h), factor.ks_mean(x[:FIT], w[:FIT], h), small)], columns=["unit", "error", "fit_error", "held_error", "ks", "near_zero"])

    return matrices(spark, sf_dir).groupBy("unit").applyInPandas(run, "unit long, error double, fit_error double, held_error double, ks double, near_zero int")


def rank_grid(x: DataFrame) -> DataFrame:
    """(unit, k, rep): each rank that the unit's matrix allows and each repeat."""
    bound = x.groupBy("unit").agg(F.least(F.count("*"), F.max(F.size("series"))).alias("bound"))
    ranks = bound.select("unit", "bound", F.explode(F.array(*map(F.lit, RANKS))).alias("k")).where("k <= bound")
    return ranks.select("unit", "k", F.explode(F.array(*map(F.lit, range(REPEATS)))).alias("rep"))


def rank_errors(x: DataFrame, path: str) -> tuple[DataFrame, int]:
    """((unit, k, rep, error), how many were fitted): held-out errors, read from the results at ``path`` where these are of
    the same matrix and settings.  Every missing (unit, k, rep) is a task of its own; the same seeds serve every k."""
    parallel = 4 * x.sparkSession.sparkContext.defaultParallelism
    digests = incremental.digest_of(x, ["unit"], ["origin", "dest", "series"], "l1=0.1", "seed=42", "share=0.1", "rounds=12", "sweeps=120")
    wanted = rank_grid(x).join(digests, "unit")

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                _, m = dense(pd.DataFrame([{"origin": p["origin"], "dest": p["dest"], "series": p["series"]} for p in r.rows]))
                error = factor.masked_error(m, int(r.k), 42 + int(r.rep), l1=0.1)
                yield pd.DataFrame([(r.unit, r.k, r.rep, r.digest, error)], columns=["unit", "k", "rep", "digest", "error"])

    def fit(missing):
        packed = x.groupBy("unit").agg(F.collect_list(F.struct("origin", "dest", "series")).alias("rows"))  # a matrix a row
        return missing.join(packed, "unit").repartition(parallel, "unit", "k", "rep").mapInPandas(run, schema)

    schema = "unit long, k int, rep int, digest string, error double"
    rows, n = incremental.completed(wanted, ["unit", "k", "rep", "digest"], path, schema, fit)
    return rows.select("unit", "k", "rep", "error"), n


def rank_table(spark, sf_dir) -> DataFrame:
    """(unit, k, mean, sd) over the repeats; what earlier runs have fitted is read from the shared folder."""
    x = written(matrices(spark, sf_dir), "matrices")
    cv, _ = rank_errors(x, f"{folder(spark)}/odresil-rank-errors")
    return cv.groupBy("unit", "k").agg(F.avg("error").alias("mean"), F.stddev_samp("error").alias("sd"))


@query()
def rank_cv(spark, sf_dir):
    return rank_table(spark, sf_dir)


@query()
def rank_report(spark, sf_dir):
    """(unit, best, lo_1se, hi_1se, ...): the rank of least error of each unit, and the ranks that are about as good."""
    return incremental.bands(rank_table(spark, sf_dir), ["unit"], n=REPEATS)


@query()
def nmf_block_factors(spark, sf_dir):
    """What ``nmf_cd`` gives, from factors that are never in one task: for units of any number of pairs."""
    x = written(matrices(spark, sf_dir), "matrices")
    first = x.select(F.size("series").alias("slots")).limit(1).collect()
    if not first:
        return spark.createDataFrame([], "unit long, component int, w_sum double, h_sum double")
    w, h = factorise.nmf_blocks(x, first[0].slots, 3, l1=0.1, sweeps=BLOCK_SWEEPS, buckets=4)
    sums = factorise.weights(w, 3).groupBy("unit", "component").agg(F.sum("value").alias("w_sum"))
    return sums.join(factorise.loadings(h, 3).groupBy("unit", "component").agg(F.sum("value").alias("h_sum")), ["unit", "component"])


@query()
def unit_decomposition(spark, sf_dir):
    """(unit, component, weight, share_k, top_flow, kept, new_component): a unit's zones filtered, its matrix factored, its
    factors scaled, its components gated."""
    x = written(matrices(spark, sf_dir), "matrices")
    total = F.aggregate("series", F.lit(0.0), lambda a, v: a + v)
    flows = x.select("unit", "origin", "dest", total.alias("flow"))
    ends = flows.select("unit", F.col("origin").alias("zone"), "flow").unionAll(flows.select("unit", "dest", "flow"))
    active = ends.groupBy("unit", "zone").agg(F.sum("flow").alias("total")).where(F.col("total") >= least_activity(LEAST_DAYS, 1.0)).select("unit", "zone")
    kept = x.join(active.withColumnRenamed("zone", "origin"), ["unit", "origin"], "left_semi")
    kept = kept.join(active.withColumnRenamed("zone", "dest"), ["unit", "dest"], "left_semi").where(total > 0)

    def run(pdf):
        pdf, m = dense(pdf)
        k = min(6, *m.shape)
        w, h = factor.nmf(m, k, l1=0.1, sweeps=SWEEPS)
        rows = [(int(pdf.unit[0]), -1, -1, j, "w", float((w[:, j] ** 2).sum())) for j in range(k)]
        rows += [(int(pdf.unit[0]), int(o), int(d), j, "h", float(h[j, i])) for i, (o, d) in enumerate(zip(pdf.origin, pdf.dest)) for j in range(k)]
        return pd.DataFrame(rows, columns=["unit", "origin", "dest", "component", "part", "value"])

    parts = written(kept.groupBy("unit").applyInPandas(run, "unit long, origin long, dest long, component int, part string, value double"), "factors")
    length = parts.where("part = 'w'").select("unit", "component", F.sqrt("value").alias("length"))
    scaled = parts.where("part = 'h'").join(length, ["unit", "component"]).withColumn("value", F.col("value") * F.when(F.col("length") > 0, F.col("length")).otherwise(1.0))
    weight = scaled.groupBy("unit", "component").agg(F.sum("value").alias("weight"))
    return component_filter(scaled.select("unit", "component", "value"), weight, ["unit"])


def component_table(spark, sf_dir, flows=None) -> DataFrame:
    """(unit, component, weight, target, ...): the components that pass the gate of the feature table, the loss as target.

    It is written, a row a component: what is learned from it reads it many times."""
    ship(spark)
    rows = usable(cities.merged_table(spark, sf_dir, flows), ["unit"], cities.NEEDED, "cum_loss", 3)
    rows = rows.withColumnsRenamed({"cum_loss": "target", "income_combined": "income"})
    columns = dict.fromkeys([*cities.KEYS, "weight", "weight_normal", "target", *NAMES, *cities.RANK, *cities.SIDES, "wind"])
    return written(rows.select(*columns), "components")


def folds(spark, sf_dir, rows: DataFrame | None = None) -> DataFrame:
    """The table once for each held-out unit; a unit has a handful of rows.  Without a second unit there is no fold."""
    rows = component_table(spark, sf_dir) if rows is None else rows
    held = [r["unit"] for r in rows.select("unit").distinct().collect()]  # units are a configuration of a few dozen
    return rows.withColumn("held", F.explode(F.array(*(F.lit(u).cast("long") for u in sorted(held))) if len(held) > 1 else F.array().cast("array<bigint>")))


def standard(x: np.ndarray, unit: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x, float)
    for u in np.unique(unit):
        part = x[unit == u]
        sd = part.std(0)
        out[unit == u] = (part - part.mean(0)) / (sd + moments.TINY)
    return out


def ranked(y: pd.Series, unit: pd.Series) -> np.ndarray:
    return y.groupby(unit).rank(method="average").to_numpy()


def rank_scores(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """The fold in order, whether each row is held, and predicted standard ranks; the held target is never read."""
    pdf = pdf.sort_values(["unit", "component"]).reset_index(drop=True)
    unit, held = pdf.unit.to_numpy(), (pdf.unit == pdf.held).to_numpy()
    x = standard(pdf[cities.RANK].to_numpy(float), unit)
    level = pdf[cities.LEVEL].to_numpy(float)  # keeps its scale between units
    deviation = level[~held].std()
    x[:, cities.RANK.index(cities.LEVEL)] = (level - level[~held].mean()) / (deviation if deviation > 1e-12 else 1.0)
    y = standard(ranked(pdf.target.where(~held, np.arange(len(pdf))), pdf.unit)[:, None], unit)[:, 0]
    _, beta, start = solve.ridge_loo(x[~held], y[~held], PENALTIES)
    return pdf, held, x @ beta + start


def rho(a, b) -> float:
    a, b = pd.Series(np.asarray(a, float)).rank(), pd.Series(np.asarray(b, float)).rank()
    return float(a.corr(b)) if len(a) >= 3 and a.std() > 0 and b.std() > 0 else float("nan")


@query()
def recovery_fit(spark, sf_dir):
    ship(spark)

    def run(pdf):
        pdf = pdf.sort_values("day")
        return pd.DataFrame([(pdf.component.iloc[0], *solve.fit_recovery(pdf.day.to_numpy(float), pdf.r.to_numpy(float)))], columns=["component", "alpha", "level", "strength", "rate", "r2"])

    return smoothed(spark, sf_dir).groupBy("component").applyInPandas(run, "component string, alpha double, level double, strength double, rate double, r2 double")


@query()
def stepwise_fit(spark, sf_dir):
    ship(spark)

    def run(pdf):
        y = pdf.sort_values("day").r.to_numpy(float) - 1
        return pd.DataFrame([(pdf.component.iloc[0], *solve.fit_decay(y))], columns=["component", "depth", "alpha", "beta", "t0"])

    return smoothed(spark, sf_dir).groupBy("component").applyInPandas(run, "component string, depth double, alpha double, beta double, t0 int")


DAYS = EVENTS.disaster


@query()
def plateau_inversion(spark, sf_dir):
    """The level whose logistic loss equals the observed one, by bisection inside one expression."""
    loss = smoothed(spark, sf_dir).groupBy("component").agg(F.sum(1 - F.col("r")).alias("loss"), F.max(F.when(F.col("day") == 0, F.col("r"))).alias("r0")).where("r0 > 1e-6")
    total = lambda level: F.aggregate(F.sequence(F.lit(0), F.lit(DAYS - 1)), F.lit(0.0), lambda a, d: a + 1 - curves.logistic(d, F.col("r0"), F.lit(0.35), level))
    start = F.struct(F.lit(0.05).alias("lo"), F.lit(5.0).alias("hi"))

    def halve(s, _):
        mid = (s["lo"] + s["hi"]) / 2
        return F.when(total(mid) > F.col("loss"), F.struct(mid.alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))

    return loss.withColumn("level", F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2))


def unit_totals(pdf: pd.DataFrame, score: np.ndarray) -> pd.DataFrame:
    g = pdf.assign(s=score * pdf.weight, t=pdf.target * pdf.weight, r=pdf.r0 * pdf.weight).groupby("unit")[["s", "t", "r", "weight"]].sum()
    return pd.DataFrame({"s": g.s / g.weight, "truth": g.t / g.weight, "r0": g.r / g.weight})


def city_level(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, float]:
    """The fold, held mask, scores, and the held unit's total: ridge on (score, r0), spread matched to the training units."""
    pdf, held, score = rank_scores(pdf)
    t = unit_totals(pdf, score)
    train = t.index != pdf.held[0]
    x = t[["s", "r0"]].to_numpy()
    sd = x[train].std(0)
    x = (x - x[train].mean(0)) / np.where(sd > 0, sd, 1)
    y = t.truth.to_numpy()[train]
    _, beta, start = solve.ridge_loo(x[train], y, np.logspace(-3, 3, 25))
    z = x @ beta + start
    spread = z[train].std()
    return pdf, held, score, float(y.mean() + (z[~train][0] - z[train].mean()) * (y.std() / spread if spread > 1e-12 else 0.0))


@query()
def city_total(spark, sf_dir):
    def run(pdf):
        truth = unit_totals(pdf, np.zeros(len(pdf))).truth
        pdf, _, _, guess = city_level(pdf)
        return pd.DataFrame([(int(pdf.held[0]), guess, float(truth[pdf.held[0]]))], columns=["held", "total", "truth"])

    return folds(spark, sf_dir).groupBy("held").applyInPandas(run, "held long, total double, truth double")


#: Quantiles, kernel widths and penalties of the spread fit (fixed values).
GRID = np.linspace(0.0005, 0.9995, 2000)
WIDTHS, WEIGHTS = (0.25, 0.40), (0.0, 1.0, 10.0, 100.0)
CURVE_DAYS = np.arange(6.0)
#: Gap in days up to which a city's loss counts as met.
TOLERANCE = 1e-5


def by_unit(pdf: pd.DataFrame) -> dict[int, pd.DataFrame]:
    return {int(u): p.sort_values("component") for u, p in pdf.groupby("unit")}


def pooled_alpha(frames: dict[int, pd.DataFrame], units) -> float:
    """The rate that fits the losses of some units' components best by the plain logistic, on a fixed grid."""
    rates = np.linspace(0.05, 2.0, 40)
    r0 = np.concatenate([frames[u].r0 for u in units])
    loss = np.concatenate([frames[u].target for u in units])
    ok = r0 > 1e-6
    return float(min(rates, key=lambda a: ((backbone.losses(r0[ok], a, CURVE_DAYS) - loss[ok]) ** 2).sum()))


def spread_scale(pdf: pd.DataFrame) -> tuple[float, float, dict]:
    """(base, multiplier, how): the held unit's backbone spread over the training units' mean, and the fitted correction."""
    frames, held = by_unit(pdf), int(pdf.held.iloc[0])
    rest = [u for u in frames if u != held]
    alpha = pooled_alpha(frames, rest)
    deviation = {u: backbone.deviation(p.r0.to_numpy(float), alpha, CURVE_DAYS) for u, p in frames.items()}
    known = [deviation[u] for u in rest if np.isfinite(deviation[u]) and deviation[u] > 0]
    base = deviation[held] / np.mean(known) if known and np.isfinite(deviation[held]) else 1.0
    units = {u: (p[cities.MERGED].to_numpy(float), p.target.to_numpy(float) if u != held else None) for u, p in frames.items()}
    factor, how = purpose.multiplier(held, units, deviation, GRID, WIDTHS, WEIGHTS)
    return float(base), factor, how


@query()
def purpose_spread(spark, sf_dir):
    def run(pdf):
        base, factor, how = spread_scale(pdf)
        return pd.DataFrame([(int(pdf.held.iloc[0]), base, factor, base * factor, how.get("width"), how.get("penalty"), how.get("distance"))], columns=["held", "base", "multiplier", "scale", "width", "penalty", "distance"])

    return folds(spark, sf_dir).groupBy("held").applyInPandas(run, "held long, base double, multiplier double, scale double, width double, penalty double, distance double")


def predicted_shape(pdf: pd.DataFrame, score: np.ndarray) -> tuple[np.ndarray, str]:
    """The held components' centred losses before scaling; the training units' mean spectrum where the modes can't be fitted."""
    frames, held = by_unit(pdf), int(pdf.held.iloc[0])
    losses = {u: p.target.to_numpy(float) for u, p in frames.items() if u != held}
    r0 = {u: p.r0.to_numpy(float) for u, p in frames.items()}
    try:
        return shape.predicted(losses, r0, lambda units: pooled_alpha(frames, units), CURVE_DAYS, held, score), ""
    except shape.NoShape as why:
        mean = np.mean([np.quantile(v, GRID) - v.mean() for v in losses.values()], axis=0)
        place = np.empty(len(score))
        place[np.argsort(score, kind="stable")] = (np.arange(len(score)) + 0.5) / len(score)
        return np.interp(place, GRID, mean), str(why)


@query()
def shape_modes(spark, sf_dir):
    def run(pdf):
        pdf, held, score = rank_scores(pdf)
        value, why = predicted_shape(pdf, score[held])
        return pd.DataFrame({"held": pdf.held[held], "component": pdf.component[held], "value": value, "fallback": why})

    return folds(spark, sf_dir).groupBy("held").applyInPandas(run, "held long, component long, value double, fallback string")


def mapped(pdf: pd.DataFrame) -> pd.DataFrame:
    """Held components' losses: scores in order take the shape's quantiles, scaled, shifted to the unit's total."""
    pdf, held, score, total = city_level(pdf)
    test = pdf[held].reset_index(drop=True)
    base, factor, _ = spread_scale(pdf)
    loss = base * factor * predicted_shape(pdf, score[held])[0]
    w = test.weight.to_numpy() / test.weight.sum()
    return test.assign(loss=loss + total - (w * loss).sum(), total=total)


@query()
def quantile_map(spark, sf_dir):
    return folds(spark, sf_dir).groupBy("held").applyInPandas(lambda pdf: mapped(pdf)[["held", "component", "loss", "total", "target"]], "held long, component long, loss double, total double, target double")


def decoded(loss: float, r0: float, alpha: float = 0.35) -> np.ndarray:
    """The curve from r0 whose loss is halfway between the backbone's and the wanted one, level and rate fitted together."""
    r0 = max(r0, 1e-3)
    backbone = float((1 - solve.curve(CURVE_DAYS, r0, alpha, 1.0)).sum())
    want = backbone + 0.5 * (loss - backbone)
    p, _ = solve.least_squares(lambda p: np.array([(1 - solve.curve(CURVE_DAYS, r0, *p)).sum() - want]), (alpha, 1.0), (0.0, 0.05), (5.0, 5.0))
    return solve.curve(CURVE_DAYS, r0, *p)


@query()
def joint_curve(spark, sf_dir):
    def run(pdf):
        m = mapped(pdf)
        return pd.DataFrame([(int(r.held), int(r.component), int(d), float(v)) for r in m.itertuples() for d, v in enumerate(decoded(r.loss, r.r0))], columns=["held", "component", "day", "r"])

    return folds(spark, sf_dir).groupBy("held").applyInPandas(run, "held long, component long, day int, r double")


def city_of(m: pd.DataFrame) -> citywide.City:
    """The held unit's baselines: each component's flow in a normal period, and the flow of all its components, those that
    the gate dropped too."""
    base = m.weight.to_numpy(float) / cities.NORMAL
    own = float((m.weight / m.weight_normal).mean()) / cities.NORMAL
    return citywide.City(np.tile(base, (len(CURVE_DAYS), 1)), np.ones(len(m)), np.full(len(CURVE_DAYS), own))


def aligned(m: pd.DataFrame) -> tuple[citywide.City, citywide.Shift, citywide.Shift]:
    """The city, and its losses before and after the shift that makes its curve lose the unit's predicted total."""
    city = city_of(m)
    decode = lambda losses: np.array([decoded(v, r) for v, r in zip(losses, m.r0)]).T
    return city, *citywide.nearest_shift(m.loss.to_numpy(float), float(m.total.iloc[0]), city, decode, TOLERANCE)


@query()
def align_city_loss(spark, sf_dir):
    def run(pdf):
        m = mapped(pdf)
        _, still, moved = aligned(m)
        return pd.DataFrame([(int(m.held[0]), moved.by, still.gap, moved.gap, abs(moved.gap) <= TOLERANCE)], columns=["held", "shift", "initial_gap", "residual", "ok"])

    return folds(spark, sf_dir).groupBy("held").applyInPandas(run, "held long, shift double, initial_gap double, residual double, ok boolean")


@query()
def curve_forecast(spark, sf_dir):
    """The deepest chain: scores, total, spread, shape, quantile map, curves, alignment; one fold a task."""

    def run(pdf):
        m = mapped(pdf)
        city, _, moved = aligned(m)
        curve = (moved.curves * city.base) @ city.loading / city.own
        return pd.DataFrame({"held": int(m.held[0]), "day": np.arange(len(curve), dtype=np.int32), "r_city": curve})

    return folds(spark, sf_dir).groupBy("held").applyInPandas(run, "held long, day int, r_city double")
