"""Further carriers between units: neighbours of cities, parameters with a fallback, refitted folds, co-riding clusters, decay."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from odresil.config import EVENTS as W
from odresil.kernels import baseline, factor, solve
from odresil.kernels.direct import neighbours
from odresil.operators.flows import dense_totals
from odresil.plans import cities
from odresil.plans.kernels import CURVE_DAYS, NAMES, by_unit, component_table, dense, folds, matrices, pooled_alpha, rho
from odresil.plans.ranking import clusters
from odresil.plans.registry import query
from odresil.shipping import ship
from odresil.sources.testdata import transitions


@query()
def city_alpha_knn(spark, sf_dir):
    """One rate for a whole unit from its neighbours' rates, and the plain logistic from its own first value."""

    def run(pdf):
        frames, held = by_unit(pdf), int(pdf.held.iloc[0])
        rest = [u for u in frames if u != held]
        mean = {u: np.average(p[NAMES].to_numpy(float), axis=0, weights=p.weight) for u, p in frames.items()}
        r0 = float(np.average(frames[held].r0, weights=frames[held].weight))
        if len(rest) < 2 or r0 <= 1e-6:
            return pd.DataFrame(columns=["held", "alpha", "day", "r"])
        rates = np.array([pooled_alpha(frames, [u]) for u in rest])
        alpha = float(neighbours(np.array([mean[u] for u in rest]), rates, mean[held][None])[0])
        r = 1 / (1 + (1 / r0 - 1) * np.exp(-alpha * CURVE_DAYS))
        return pd.DataFrame({"held": held, "alpha": alpha, "day": np.arange(len(r), dtype=np.int32), "r": r})

    return folds(spark, sf_dir).groupBy("held").applyInPandas(run, "held long, alpha double, day int, r double")


@query()
def parameter_transfer(spark, sf_dir):
    """A component parameter (its drop) from the training units' components; their mean where a feature is missing."""
    ship(spark)
    names = [*cities.MERGED, "mean_distance", "income_combined"]
    rows = cities.merged_table(spark, sf_dir).select(*cities.KEYS, "drop_depth", *names).where("drop_depth is not null")

    def run(pdf):
        held = pdf.unit == pdf.held
        train = pdf[~held].dropna(subset=names)
        test = pdf[held].sort_values("component")
        known = test[names].notna().all(axis=1).to_numpy()
        mean = float(pdf[~held].drop_depth.mean())
        guess = np.full(len(test), mean)
        if len(train) >= 2 and known.any():
            y, sd = train.drop_depth.to_numpy(float), float(train.drop_depth.std(ddof=0)) or 1.0
            z = neighbours(train[names].to_numpy(float), (y - y.mean()) / sd, test.loc[known, names].to_numpy(float))
            guess[known] = z * sd + y.mean()
        return pd.DataFrame({"held": test.unit, "component": test.component, "guess": guess, "fallback": ~known, "truth": test.drop_depth})

    return folds(spark, sf_dir, rows).groupBy("held").applyInPandas(run, "held long, component long, guess double, fallback boolean, truth double")


@query()
def ridge_loo_refit(spark, sf_dir):
    """Leave-one-out predictions of a unit's losses by ridge with a fixed penalty, the scaler fitted anew in each fold."""
    rows = component_table(spark, sf_dir)

    def run(pdf):
        pdf = pdf.sort_values("component")
        x, y = pdf[["mean_distance", "income", "r0"]].to_numpy(float), pdf.target.to_numpy(float)
        return pd.DataFrame({"unit": pdf.unit, "component": pdf.component, "guess": solve.ridge_refit(x, y, 1.0), "truth": y})

    return rows.groupBy("unit").applyInPandas(run, "unit long, component long, guess double, truth double")


def ridden(shares: np.ndarray) -> np.ndarray:
    """Standard scores of the ranks, within a unit, of the centred log ratios of its components' shares."""
    logs = np.log(np.maximum(shares, 1e-12))
    logs = logs - logs.mean(1, keepdims=True)
    ranks = pd.DataFrame(logs).rank().to_numpy()
    return (ranks - ranks.mean(0)) / (ranks.std(0) + 1e-12)


def cells(z: np.ndarray) -> np.ndarray:
    return (z.T @ z / len(z))[np.triu_indices(z.shape[1], 1)]


@query()
def nearest_cluster(spark, sf_dir):
    """The community of other units whose co-riding matrix is nearest to a unit's own; ties go to the first community."""
    rows = component_table(spark, sf_dir)
    rows = rows.join(F.broadcast(clusters(rows)), "unit")  # a row a unit

    def run(pdf):
        frames, held = by_unit(pdf), int(pdf.held.iloc[0])
        z = {u: ridden(p[cities.MERGED].to_numpy(float)) for u, p in frames.items()}
        distance = {}
        for k in sorted({int(p.cluster.iloc[0]) for u, p in frames.items() if u != held}):
            members = [z[u] for u, p in frames.items() if u != held and int(p.cluster.iloc[0]) == k]
            distance[k] = 1 - rho(cells(z[held]), cells(np.concatenate(members)))
        best = min(distance, key=lambda k: (np.nan_to_num(distance[k], nan=np.inf), k))
        return pd.DataFrame([(held, best, float(distance[best]))], columns=["held", "cluster", "distance"])

    return folds(spark, sf_dir, rows).groupBy("held").applyInPandas(run, "held long, cluster int, distance double")


@query()
def coriding_map(spark, sf_dir):
    """The six categories of each unit in a plane, near where they ride together, laid onto the map of all other units."""

    def run(pdf):
        frames, held = by_unit(pdf), int(pdf.held.iloc[0])
        z = {u: ridden(p[cities.MERGED].to_numpy(float)) for u, p in frames.items()}
        apart = lambda m: 1 - m.T @ m / len(m)
        template = solve.classical_scaling(apart(np.concatenate([v for u, v in z.items() if u != held])))
        points, left = solve.procrustes(solve.classical_scaling(apart(z[held])), template)
        return pd.DataFrame({"held": held, "category": cities.MERGED, "x": points[:, 0], "y": points[:, 1], "left": left})

    return folds(spark, sf_dir).groupBy("held").applyInPandas(run, "held long, category string, x double, y double, left double")


@query()
def nmf_project_multiplicative(spark, sf_dir):
    """Weights of all periods under the first periods' components, by multiplicative updates."""

    def run(pdf):
        pdf, x = dense(pdf)
        _, h = factor.nmf(x[: len(x) * 3 // 4], 3)
        w = factor.project_multiplicative(x, h)
        return pd.DataFrame([(int(pdf.unit[0]), t, j, float(w[t, j])) for t in range(len(x)) for j in range(3)], columns=["unit", "slot_idx", "component", "value"])

    return matrices(spark, sf_dir).groupBy("unit").applyInPandas(run, "unit long, slot_idx int, component int, value double")


@query()
def decay_pipeline(spark, sf_dir):
    """Each component's relative change against a baseline from before the disaster, its impact and the step-wise fit."""
    ship(spark)
    series = dense_totals(transitions(spark, sf_dir).withColumnRenamed("origin", "component"), ["component"], "slot_idx", W.days * W.slots)
    names = ["component", "last_normal", "start", "end", "status", "depth", "alpha", "t0"]

    def run(pdf):
        y = pdf.sort_values("slot_idx").flow.to_numpy(float)
        _, smooth, found = baseline.decay(y, W.disaster * W.slots, W.slots, 3, method="consecutive", run=3)
        name = pdf.component.iloc[0]
        if found is None:
            return pd.DataFrame([(name, None, None, None, "None", None, None, None)], columns=names)
        depth, alpha, _, t0 = solve.fit_decay(smooth[found["last_normal"] : found["end"] + 1])
        return pd.DataFrame([(name, found["last_normal"], found["start"], found["end"], found["status"], depth, alpha, t0)], columns=names)

    schema = "component string, last_normal int, start int, end int, status string, depth double, alpha double, t0 int"
    return series.groupBy("component").applyInPandas(run, schema)
