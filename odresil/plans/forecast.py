"""Forecasts of a held-out city's whole curve by eight methods, and how near each comes.

A fold learns from all other units.  Its one evaluation gives a row for each day of each component and of the city (component
null) with every method's value; metrics are one aggregation over these rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odresil.kernels import direct, solve
from odresil.plans import cities
from odresil.plans.kernels import CURVE_DAYS, NAMES, aligned, by_unit, component_table, folds, mapped, pooled_alpha
from odresil.plans.registry import query
from odresil.scratch import written
from odresil.shipping import ship

#: Methods that go by components, and those that know whole cities only.
BY_COMPONENT, WHOLE = ("pred", "oracle", "train_mean", "naive_ridge"), ("city", "direct_ridge", "direct_mean", "direct_kernel")
METHODS = (*BY_COMPONENT, *WHOLE)
DAYS = len(CURVE_DAYS)
#: Penalty of the ridge from features to a component's own rate (fixed value).
NAIVE_PENALTY = 1.0


def observed(flows: DataFrame) -> DataFrame:
    """(unit, component, curve): relative flow of the days from landfall on, null where there is none; component null: the city."""
    after = (F.col("t") - cities.LANDFALL).cast("int")
    out = None
    for component in (F.col("component").cast("long"), F.lit(None).cast("long")):
        sums = flows.groupBy("unit", component.alias("component"), "t").agg(F.sum("flow").alias("flow"))
        base = sums.where(F.col("t") < cities.NORMAL).groupBy("unit", F.col("component").alias("_c")).agg(F.avg("flow").alias("base"))
        rows = sums.where(after.between(0, DAYS - 1)).join(base.withColumnRenamed("unit", "_u"), (F.col("unit") == F.col("_u")) & F.col("component").eqNullSafe(F.col("_c")))
        r = F.map_from_entries(F.collect_list(F.struct(after, F.try_divide("flow", "base")))).alias("_r")
        days = F.transform(F.sequence(F.lit(0), F.lit(DAYS - 1)), lambda d: F.try_element_at("_r", d))
        one = rows.groupBy("unit", "component").agg(r).select("unit", "component", days.alias("curve"))
        out = one if out is None else out.unionByName(one)
    return out


def fitted(curves: DataFrame) -> DataFrame:
    """Adds alpha, level, strength and rate of the recovery fitted to each curve; null where there is none."""
    ship(curves.sparkSession)
    names = ["alpha", "level", "strength", "rate"]

    def run(batches):
        for pdf in batches:
            found = [solve.fit_recovery(CURVE_DAYS, np.array([np.nan if v is None else v for v in c], float))[:4] for c in pdf["curve"]]
            fits = pd.DataFrame(found, columns=names, index=pdf.index)
            yield pd.concat([pdf, fits.astype(object).where(fits.notna(), None)], axis=1)

    return curves.mapInPandas(run, "unit long, component long, curve array<double>, alpha double, level double, strength double, rate double")


def curve_table(spark, sf_dir) -> DataFrame:
    """The component table with each component's curve and fit, and its city's."""
    flows = written(cities.periods(spark, sf_dir), "periods")
    fits = written(fitted(observed(flows)), "curves")
    parts = [F.col(c).alias(f"city_{c}") for c in ("curve", "alpha", "level", "strength", "rate")]
    city = fits.where("component is null").select("unit", *parts)
    rows = component_table(spark, sf_dir, flows).join(fits.where("component is not null"), cities.KEYS, "left").join(F.broadcast(city), "unit", "left")  # a row a unit
    return written(rows, "curve-table")


def array(values, n: int = DAYS) -> np.ndarray:
    """A curve of a row, missing days as missing numbers."""
    return np.full(n, np.nan) if values is None else np.array([np.nan if v is None else v for v in values], float)


class Cities:
    """What a fold knows of whole cities: features, curves, fitted parameters, first values; the held one's curve is its truth."""

    def __init__(self, frames: dict[int, pd.DataFrame], held: int):
        self.x = {u: np.average(p[NAMES].to_numpy(float), axis=0, weights=p.weight) for u, p in frames.items()}
        self.curve = {u: array(p.city_curve.iloc[0]) for u, p in frames.items()}
        names = ["city_alpha", "city_level", "city_strength", "city_rate"]
        self.fit = {u: p[names].iloc[0].to_numpy(float) for u, p in frames.items()}
        self.held, self.rest = held, [u for u in frames if u != held and np.isfinite(self.curve[u]).all()]

    def stack(self, of: dict, units) -> np.ndarray:
        return np.array([of[u] for u in units])

    def lines(self) -> tuple[dict[str, np.ndarray], dict[str, float]]:
        """Curves of the methods that know whole cities only, and the settings chosen for them; missing where too few cities are known."""
        none, start = np.full(DAYS, np.nan), self.curve[self.held][0]
        out, how = dict.fromkeys(WHOLE, none), {}
        new, rest = self.x[self.held], self.rest
        with_fit = [u for u in rest if np.isfinite(self.fit[u]).all()]
        with_rate = [u for u in rest if np.isfinite(self.fit[u][0])]
        if rest:
            out["direct_mean"] = self.stack(self.curve, rest).mean(0)
        if len(rest) >= 3:
            out["direct_kernel"], how["width"] = direct.kernel_curve(self.stack(self.x, rest), self.stack(self.curve, rest), new)
        if len(with_fit) >= 3:
            out["direct_ridge"], how["penalty"] = direct.ridge_curve(CURVE_DAYS, self.stack(self.x, with_fit), self.stack(self.fit, with_fit), self.stack(self.curve, with_fit), new, start)
        if len(with_rate) >= 2 and np.isfinite(start) and start > 1e-6:
            rate = direct.neighbours(self.stack(self.x, with_rate), self.stack(self.fit, with_rate)[:, 0], new[None])[0]
            out["city"] = solve.curve(CURVE_DAYS, start, rate, 1.0)
        return out, how


def component_lines(pdf: pd.DataFrame, frames: dict[int, pd.DataFrame], held: int):
    """(the city's geometry, components of the held unit, curves [day, component] of each method that goes by components)."""
    m = mapped(pdf)
    city, _, moved = aligned(m)
    rest = [u for u in frames if u != held]
    pool = pd.concat([frames[u] for u in rest])
    mean_rate = pooled_alpha(frames, rest)
    known = pool.dropna(subset=["alpha"])
    x, rates = m[cities.RANK].to_numpy(float), np.full(len(m), mean_rate)
    if len(known) >= 2:
        rates = np.array([direct.ridge(known[cities.RANK].to_numpy(float), known[["alpha"]].to_numpy(float), row, NAIVE_PENALTY)[0] for row in x])
    from_start = lambda rate: np.array([solve.curve(CURVE_DAYS, max(r, 1e-3), a, 1.0) for r, a in zip(m.r0, rate)]).T
    own = []
    for r in m.itertuples():
        fit = np.array([r.alpha, r.level, r.strength, r.rate], float)
        own.append(direct.from_parameters(CURVE_DAYS, r.r0, fit) if np.isfinite(fit).all() else np.full(DAYS, r.r0))
    return city, m, {"pred": moved.curves, "oracle": np.array(own).T, "train_mean": from_start(np.full(len(m), mean_rate)), "naive_ridge": from_start(np.clip(rates, 0, 5))}


def evaluated(pdf: pd.DataFrame) -> pd.DataFrame:
    """All rows of a fold."""
    frames, held = by_unit(pdf), int(pdf.held.iloc[0])
    city, m, curves = component_lines(pdf, frames, held)
    whole, _ = Cities(frames, held).lines()
    whole |= {name: (c * city.base) @ city.loading / city.own for name, c in curves.items()}
    nan = np.full(DAYS, np.nan)
    parts = [(None, array(m.city_curve.iloc[0]), whole)]
    parts += [(int(r.component), array(r.curve), {name: curves[name][:, k] if name in curves else nan for name in METHODS}) for k, r in enumerate(m.itertuples())]
    rows = [(held, component, d, truth[d], {n: v if np.isfinite(v) else None for n, v in ((n, float(lines[n][d])) for n in METHODS)}) for component, truth, lines in parts for d in range(DAYS)]
    out = pd.DataFrame(rows, columns=["held", "component", "day", "truth", "lines"])
    out["component"] = out["component"].astype("Int64")
    return out


LINES = ", ".join(f"{m}: double" for m in METHODS)


def evaluations(spark, sf_dir) -> DataFrame:
    rows = curve_table(spark, sf_dir)
    return folds(spark, sf_dir, rows).groupBy("held").applyInPandas(evaluated, f"held long, component long, day int, truth double, lines struct<{LINES}>")


@query()
def curve_methods(spark, sf_dir):
    """(held, component, day, truth, a column a method): every forecast of every fold; component null: the city's curve."""
    return evaluations(spark, sf_dir).select("held", "component", "day", "truth", "lines.*")


def metrics(rows: DataFrame) -> DataFrame:
    """(level, method, n_units, n, mae, mape, bias, loss_error) of rows like those of ``evaluations``: errors by day, and of
    the loss summed over a curve; days without truth or forecast are left out."""
    named = F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.col(f"lines.{m}").alias("value")) for m in METHODS)))
    long = rows.select("held", "component", "day", "truth", named.alias("_m")).select("held", "component", "day", "truth", "_m.*")
    long = long.where("truth is not null and value is not null and not isnan(truth)").withColumn("gap", F.col("value") - F.col("truth"))
    level = F.when(F.col("component").isNull(), "city").otherwise("component").alias("level")
    share = F.when(F.abs("truth") > 1e-8, F.abs(F.col("gap") / F.col("truth")))
    curves = long.groupBy(level, "method", "held", "component").agg(F.count("*").alias("n"), F.sum("gap").alias("gap"), F.sum(F.abs("gap")).alias("far"), F.sum(share).alias("share"), F.count(share).alias("shares"))
    total = curves.groupBy("level", "method")
    return total.agg(
        F.countDistinct("held").cast("int").alias("n_units"),
        F.sum("n").alias("n"),
        (F.sum("far") / F.sum("n")).alias("mae"),
        (100 * F.try_divide(F.sum("share"), F.sum("shares"))).alias("mape"),
        (F.sum("gap") / F.sum("n")).alias("bias"),
        F.avg(F.abs("gap")).alias("loss_error"),
    )


@query()
def curve_method_metrics(spark, sf_dir):
    return metrics(evaluations(spark, sf_dir))


@query()
def direct_city_curves(spark, sf_dir):
    """(held, day, ridge, kernel, mean, truth, penalty, width): whole curves of cities by ridge from features to curve
    parameters, as a mixture of other cities' curves, and as their mean."""

    def run(pdf):
        known = Cities(by_unit(pdf), int(pdf.held.iloc[0]))
        lines, how = known.lines()
        rows = {"held": known.held, "day": np.arange(DAYS, dtype=np.int32), "ridge": lines["direct_ridge"], "kernel": lines["direct_kernel"], "mean": lines["direct_mean"], "truth": known.curve[known.held]}
        return pd.DataFrame({**rows, "penalty": how.get("penalty"), "width": how.get("width")})

    schema = "held long, day int, ridge double, kernel double, mean double, truth double, penalty double, width double"
    return folds(spark, sf_dir, curve_table(spark, sf_dir)).groupBy("held").applyInPandas(run, schema)
