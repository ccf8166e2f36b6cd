"""Component features: temporal, functional, spatial, socio-economic; factor scaling and filters; land-use shares."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odresil.config import BANDS, CATEGORIES, DOMINANT, EPSILON, IWF_POWER, Windows
from odresil.operators.curves import is_weekday


def temporal_features(flows: DataFrame, keys: list[str], w: Windows, hours: int = 2, weekend_below: float = 1.0) -> DataFrame:
    """Temporal signature of the normal days: weekday_ratio, the weekdays' slot shares and width-corrected band means, and
    peak slot and period with their labels.

    Components below ``weekend_below`` are a category of their own, after all slots and periods.  Without weekend activity
    a component counts as weekday-dominated and has no ratio; without weekday activity its shares are 0."""
    slots = range(w.first_slot, w.last_slot + 1)
    spine = flows.select(*keys).distinct().withColumn("day_idx", F.explode(F.sequence(F.lit(0), F.lit(w.normal - 1))))
    spine = spine.withColumn("slot_of_day", F.explode(F.sequence(F.lit(w.first_slot), F.lit(w.last_slot))))
    sums = flows.groupBy(*keys, "day_idx", "slot_of_day").agg(F.sum("flow").alias("flow"))
    cells = spine.join(sums, [*keys, "day_idx", "slot_of_day"], "left").withColumn("flow", F.coalesce("flow", F.lit(0.0)))
    cells = cells.withColumn("weekday", is_weekday(F.col("day_idx"), w))
    days = cells.groupBy(*keys, "day_idx", "weekday").agg(F.sum("flow").alias("flow"))
    mean = lambda some: F.avg(F.when(some, F.col("flow")))
    ratio = days.groupBy(*keys).agg(F.try_divide(mean(F.col("weekday")), mean(~F.col("weekday"))).alias("weekday_ratio"))
    profile = cells.where("weekday").groupBy(*keys, "slot_of_day").agg(F.avg("flow").alias("m"))
    total = F.sum("m").over(Window.partitionBy(*keys))
    profile = profile.withColumn("share", F.coalesce(F.try_divide("m", total), F.lit(0.0)))
    start, end = F.col("slot_of_day") * hours, (F.col("slot_of_day") + 1) * hours
    bands = [F.coalesce(F.avg(F.when((start >= a) & (end <= b), F.col("share"))), F.lit(0.0)).alias(n) for n, (a, b) in BANDS.items()]
    shares = [F.sum(F.when(F.col("slot_of_day") == s, F.col("share"))).alias(f"share_{hours * s}_{hours * (s + 1)}h") for s in slots]
    top = F.min_by("slot_of_day", F.struct(-F.col("share"), "slot_of_day")).alias("_top")
    out = ratio.join(profile.groupBy(*keys).agg(top, *bands, *shares), keys)
    weekend = F.coalesce(F.col("weekday_ratio") < weekend_below, F.lit(False))
    best = F.array_position(F.array(*BANDS), F.greatest(*BANDS)) - 1
    label = F.concat((F.col("_top") * hours).cast("string"), F.lit("-"), ((F.col("_top") + 1) * hours).cast("string"), F.lit("h"))
    period = F.get(F.array(*map(F.lit, BANDS)), best.cast("int"))
    return out.withColumns(
        {
            "peak_slot": F.when(weekend, len(slots)).otherwise(F.col("_top") - w.first_slot).cast("int"),
            "peak_slot_label": F.when(weekend, "weekend").otherwise(label),
            "peak_period": F.when(weekend, len(BANDS)).otherwise(best).cast("int"),
            "peak_period_label": F.when(weekend, "weekend").otherwise(period),
        }
    ).drop("_top")


def weighted_mean(weight: Column, value: Column) -> Column:
    """Mean of the values present, by weight; null where no weight is left."""
    mass = F.sum(F.when(value.isNotNull(), weight))
    return F.when(mass > 0, F.sum(weight * value) / mass)


def spatial_features(h: DataFrame, distances: DataFrame, keys: list[str]) -> DataFrame:
    """Loading-weighted mean and deviation of the distance; null where the loadings sum to nothing."""
    rows = h.join(distances, ["origin", "dest"])
    mean = weighted_mean(F.col("value"), F.col("km"))
    moments = rows.groupBy(*keys).agg(mean.alias("mean_distance"))
    spread = rows.join(moments, keys).groupBy(*keys).agg(F.first("mean_distance").alias("mean_distance"), F.sqrt(weighted_mean(F.col("value"), F.pow(F.col("km") - F.col("mean_distance"), 2))).alias("std_distance"))
    return spread


def od_values(pairs: DataFrame, values: DataFrame, mode: str) -> DataFrame:
    """``value`` of each pair: the mean of the ends that have one (combined), or the origin's alone (origin)."""
    if mode not in ("combined", "origin"):
        raise ValueError(f"unknown mode {mode!r}")
    o = values.select(F.col("zone").alias("origin"), F.col("value").alias("vo"))
    out = pairs.join(o, "origin", "left")
    if mode == "origin":
        return out.withColumnRenamed("vo", "value")
    d = values.select(F.col("zone").alias("dest"), F.col("value").alias("vd"))
    return out.join(d, "dest", "left").withColumn("value", F.coalesce((F.col("vo") + F.col("vd")) / 2, "vo", "vd")).drop("vo", "vd")


def normalised_factors(w: DataFrame, h: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """W columns of unit length, their lengths moved into H; a zero column keeps length one."""
    norm = w.groupBy(*keys).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm")).withColumn("norm", F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0))
    return tuple(x.join(norm, keys).withColumn("value", f).drop("norm") for x, f in ((w, F.col("value") / F.col("norm")), (h, F.col("value") * F.col("norm"))))


def iwf_weights(masses: DataFrame, names=CATEGORIES) -> DataFrame:
    """One row: ln(total / (category + eps)) ** power of each category over all zones."""
    clean = masses.agg(*[F.sum(clamped(F.col(c))).alias(c) for c in names])
    total = reduce(lambda a, b: a + b, [F.col(c) for c in names])
    return clean.select(*[F.pow(F.log(total / (F.col(c) + EPSILON)), IWF_POWER).alias(c) for c in names])


def clamped(x: Column) -> Column:
    """Missing, not-a-number and negative masses count as none."""
    return F.greatest(F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))


def tf_iwf_shares(masses: DataFrame, weights: DataFrame, names=CATEGORIES) -> DataFrame:
    """``share`` (array in the order of ``names``) and ``label`` of each zone: the first largest share above the
    threshold, else Mix; Unknown without mass.  ``weights`` is one row."""
    w = weights.select(F.array(*names).alias("_w"))
    rows = masses.crossJoin(F.broadcast(w)).withColumn("_m", F.array(*[clamped(F.col(c)) for c in names]))
    raw = F.zip_with(F.col("_m"), F.col("_w"), lambda m, v: m * v)
    rows = rows.withColumn("_r", raw).withColumn("_t", F.aggregate("_r", F.lit(0.0), lambda a, x: a + x))
    rows = rows.withColumn("share", F.transform("_r", lambda x: F.coalesce(F.try_divide(x, F.col("_t")), F.lit(0.0))))
    top = F.array_max("share")
    name = F.element_at(F.array(*map(F.lit, names)), F.array_position("share", top).cast("int"))
    label = F.when(F.col("_t") <= 0, "Unknown").when(top > DOMINANT, name).otherwise("Mix")
    return rows.withColumn("label", label).drop("_w", "_m", "_r", "_t")


def od_function_matrix(h: DataFrame, shares: DataFrame, keys: list[str], names=CATEGORIES) -> DataFrame:
    """(keys, origin_cat, dest_cat, proportion): loadings spread over the outer product of both ends' shares.

    Pairs with an end that has no shares or no mass are left out."""
    s = shares.where(F.aggregate("share", F.lit(0.0), lambda a, x: a + x) > 0)
    o = s.select(F.col("zone").alias("origin"), F.col("share").alias("po"))
    d = s.select(F.col("zone").alias("dest"), F.col("share").alias("pd"))
    rows = h.join(o, "origin").join(d, "dest")
    cats = F.array(*map(F.lit, names))
    rows = rows.select(*keys, "value", F.posexplode("po").alias("i", "a"), "pd").select(*keys, F.expr("value * a").alias("v"), "i", F.posexplode("pd").alias("j", "b"))
    cells = rows.groupBy(*keys, F.get(cats, "i").alias("origin_cat"), F.get(cats, "j").alias("dest_cat")).agg(F.sum(F.col("v") * F.col("b")).alias("m"))
    return cells.withColumn("proportion", F.try_divide("m", F.sum("m").over(Window.partitionBy(*keys)))).drop("m")


def functional_shares(matrix: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cat, share_from, share_to): row and column sums of the function matrix."""
    a = matrix.groupBy(*keys, F.col("origin_cat").alias("cat")).agg(F.sum("proportion").alias("share_from"))
    b = matrix.groupBy(*keys, F.col("dest_cat").alias("cat")).agg(F.sum("proportion").alias("share_to"))
    return a.join(b, [*keys, "cat"])


def function_entropy(shares: DataFrame, keys: list[str]) -> DataFrame:
    """Shannon entropy (natural) of the merged exposure, half of share_from + share_to; 0 ln 0 is left out."""
    p = (F.col("share_from") + F.col("share_to")) / 2
    return shares.groupBy(*keys).agg((-F.sum(F.when(p > 0, p * F.log(p)))).alias("entropy"))


def interactions(wide: DataFrame, names: list[str]) -> DataFrame:
    """The pairwise products of the named columns."""
    return wide.withColumns({f"{a}_x_{b}": F.col(a) * F.col(b) for k, a in enumerate(names) for b in names[k + 1 :]})


def component_filter(h: DataFrame, weight: DataFrame, unit: list[str], least_share: float = 0.5, most_top: float = 0.2) -> DataFrame:
    """(unit, component, share_k, top_flow, kept, new_component): drops components whose weight times k is below
    ``least_share`` and whose largest loading holds ``most_top`` or more; the rest are renumbered in order."""
    top = h.groupBy(*unit, "component").agg(F.try_divide(F.max("value"), F.sum("value")).alias("top_flow"))
    w = Window.partitionBy(*unit) if unit else Window.partitionBy(F.lit(0))
    rows = weight.join(top, [*unit, "component"], "left").withColumn("share_k", F.try_divide(F.col("weight") * F.count("*").over(w), F.sum("weight").over(w)))
    rows = rows.withColumn("kept", ~F.coalesce((F.col("share_k") < least_share) & (F.col("top_flow") >= most_top), F.lit(False)))
    number = F.row_number().over((Window.partitionBy(*unit, "kept") if unit else Window.partitionBy("kept")).orderBy("component")) - 1
    return rows.withColumn("new_component", F.when(F.col("kept"), number).cast("int"))


def usable(rows: DataFrame, unit: list[str], needed: list[str], target: str, least: int) -> DataFrame:
    """Rows with every needed value and a target, of the units that keep ``least`` of them and two different targets."""
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    some = F.lit(True)
    for c in (*needed, target):
        some = some & number(c)
    whole = Window.partitionBy(*unit)
    kept = rows.where(some).withColumn("_n", F.count("*").over(whole)).withColumn("_d", F.max(target).over(whole) > F.min(target).over(whole))
    return kept.where((F.col("_n") >= least) & F.col("_d")).drop("_n", "_d")


def flow_context(pairs: DataFrame, shares: DataFrame, mode: str, scale: str) -> DataFrame:
    """``context`` and ``constrained`` of each pair (origin, dest, scale): the shares of both ends, as their outer product or
    sum, at unit length times the pair's scale; zeros and not constrained where an end has no shares."""
    if mode not in ("outer", "sum"):
        raise ValueError(f"a context is an outer product or a sum, not {mode!r}")
    some = shares.where(F.aggregate("share", F.lit(0.0), lambda a, x: a + x) > 0)
    o = some.select(F.col("zone").alias("origin"), F.col("share").alias("_a"))
    d = some.select(F.col("zone").alias("dest"), F.col("share").alias("_b"))
    rows = pairs.join(o, "origin", "left").join(d, "dest", "left")
    outer = F.flatten(F.transform("_a", lambda x: F.transform("_b", lambda y: x * y)))
    rows = rows.withColumn("_v", outer if mode == "outer" else F.zip_with("_a", "_b", lambda x, y: x + y))
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))
    rows = rows.withColumn("_n", norm).withColumn("constrained", F.coalesce(F.col("_n") > 0, F.lit(False)))
    n = len(CATEGORIES) ** 2 if mode == "outer" else len(CATEGORIES)
    zero = F.array_repeat(F.lit(0.0), n)
    context = F.when(F.col("constrained"), F.transform("_v", lambda x: x * F.col(scale) / F.col("_n"))).otherwise(zero)
    return rows.withColumn("context", context).drop("_a", "_b", "_v", "_n")
