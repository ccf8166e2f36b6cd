"""Readings of the driver's tables as mobility data, and the same readings as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from odresil.config import CATEGORIES

#: Six values of p_type stand for the six land-use categories (fixed values).
TYPES = dict(zip(("ECONOMY", "SMALL", "MEDIUM", "PROMO", "STANDARD", "LARGE"), CATEGORIES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(slot_idx, day_idx, slot_of_day, origin, dest, flow): successive event types of a user, two-hour slots."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.col("event_type").alias("origin"), F.coalesce("value", F.lit(0.0)).alias("flow"))
    e = e.withColumn("dest", F.lead("origin").over(w)).where("dest is not null and origin is not null")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    e = e.select(day.alias("day_idx"), F.expr("hour(ts) div 2").cast("int").alias("slot_of_day"), "origin", "dest", "flow")
    e = e.groupBy("day_idx", "slot_of_day", "origin", "dest").agg(F.sum("flow").alias("flow"))
    return e.select((F.col("day_idx") * 12 + F.col("slot_of_day")).alias("slot_idx"), "day_idx", "slot_of_day", "origin", "dest", "flow")


TRANSITIONS = """e0 AS (SELECT user_id, ts, event_id, event_type AS origin, coalesce(value, 0.0) AS flow,
    lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dest FROM events),
od AS (SELECT date_diff('day', DATE '2024-01-01', ts::DATE)::INT * 12 + (hour(ts) // 2)::INT AS slot_idx,
    date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS day_idx, (hour(ts) // 2)::INT AS slot_of_day, origin, dest, sum(flow) AS flow
  FROM e0 WHERE dest IS NOT NULL AND origin IS NOT NULL GROUP BY 1, 2, 3, 4, 5)"""


def nation_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit, day_idx, origin, dest, flow): shipped quantity between nations by day since 1995-01-01; unit: supplier's region."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", F.to_date("l_shipdate").alias("d"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("dest"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("origin"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("origin"), F.col("n_regionkey").alias("unit"))
    day = F.datediff("d", F.lit("1995-01-01").cast("date"))
    return li.join(o, "l_orderkey").join(c, "o_custkey").join(s, "l_suppkey").join(n, "origin").groupBy("unit", day.alias("day_idx"), "origin", "dest").agg(F.sum("l_quantity").alias("flow"))


NATIONS = """nf AS (SELECT n_regionkey AS unit, date_diff('day', DATE '1995-01-01', l_shipdate::DATE)::INT AS day_idx, s_nationkey AS origin,
    c_nationkey AS dest, sum(l_quantity) AS flow
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
    JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2, 3, 4)"""


def land_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(zone, one mass column a category): quantity by part type shipped from each nation; negative masses count as none."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("zone"))
    joined = li.join(p, "l_partkey").join(s, "l_suppkey")
    return joined.groupBy("zone").agg(*[F.coalesce(F.sum(F.when(F.upper("p_type").startswith(t), F.col("l_quantity"))), F.lit(0.0)).alias(c) for t, c in TYPES.items()])


LAND_USE = "lu AS (SELECT s_nationkey AS zone, " + ", ".join(f"coalesce(sum(CASE WHEN starts_with(upper(p_type), '{t}') THEN l_quantity END), 0.0) AS {c}" for t, c in TYPES.items()) + """
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1)"""


def zone_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(zone, value): mean account balance of a nation's customers, negative balances being a suppression sentinel."""
    c = table(spark, sf_dir, "customer")
    return c.groupBy(F.col("c_nationkey").alias("zone")).agg(F.avg(F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))).alias("value"))


ZONE_VALUES = "zv AS (SELECT c_nationkey AS zone, avg(CASE WHEN c_acctbal >= 0 THEN c_acctbal END) AS value FROM customer GROUP BY 1)"
