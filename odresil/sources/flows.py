"""Readers with explicit schemas for the engine's own tables, and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odresil.operators.tables import outlines

SCHEMAS = {
    "od_flow": "unit string, slot_idx int, origin string, dest string, flow double, distance double",
    "zone": "zone_id string, geoid20 string, wkt string, cx3857 double, cy3857 double, lon double, lat double",
    "zone_landuse": "zone_id string, geoid20 string, totpop double, counthu double, hh double, totemp double, e8_ret double, e8_off double, e8_ind double, e8_svc double, e8_ent double, e8_ed double, e8_hlth double, e8_pub double",
    "zone_income": "zone_id string, geoid20 string, median_household_income double",
    "msa_gdp": "code string, gdp_2019_kusd double",
}


def read_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> DataFrame:
    """One of ``SCHEMAS`` from Parquet or CSV with a header; ids stay strings."""
    reader = spark.read.schema(SCHEMAS[name])
    return reader.parquet(path) if fmt == "parquet" else reader.option("header", True).csv(path)


def read_zones(spark: SparkSession, path: str, names: dict[str, str]) -> DataFrame:
    """Zones from a CSV file with a header: columns renamed as ``names`` says, and the centroid (cx, cy) of their WKT outline."""
    rows = spark.read.option("header", True).option("escape", '"').csv(path).withColumnsRenamed(names)
    return outlines(rows, "wkt")


def write_csv(df: DataFrame, path: str) -> None:
    """Rows as CSV files with a header; arrays and structs as JSON."""
    plain = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*plain).write.mode("overwrite").option("header", True).csv(path)


def read_income(spark: SparkSession, path: str) -> DataFrame:
    """Incomes with suppressed (negative) values as null, one row a geoid: the first by zone id."""
    rows = read_table(spark, "zone_income", path, "csv")
    one = rows.groupBy("geoid20").agg(F.min_by(F.struct("zone_id", "median_household_income"), "zone_id").alias("r")).select("geoid20", "r.*")
    return one.withColumn("median_household_income", F.expr("if(median_household_income < 0, null, median_household_income)"))


def land_use_masses(rows: DataFrame) -> DataFrame:
    """The six category masses of the block-group job and housing counts."""
    sums = {"residential": "counthu", "commercial": "e8_ret + e8_off + e8_svc", "leisure": "e8_ent", "industrial": "e8_ind", "health": "e8_hlth", "public": "e8_ed + e8_pub"}
    return rows.select(F.col("zone_id").alias("zone"), *[F.expr(e).alias(c) for c, e in sums.items()])


def write_audit(df: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    df.write.mode("overwrite").json(path)
