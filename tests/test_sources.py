"""Readers and writers on small files, and the streaming form of the slot totals."""

import datetime

import pytest
from pyspark.sql import functions as F

from odresil.config import EVENTS
from odresil.operators import features
from odresil.operators.flows import select_segments
from odresil.sources import flows
from odresil.streaming import slot_totals


def test_zones_from_csv(spark, tmp_path):
    path = tmp_path / "z.csv"
    path.write_text('GEOID,the_geom\nA,"POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))"\nB,\n')
    got = {r.zone_id: (r.cx, r.cy) for r in flows.read_zones(spark, str(path), {"GEOID": "zone_id", "the_geom": "wkt"}).collect()}
    assert got == {"A": (1.0, 1.0), "B": (None, None)}


def test_income_is_cleaned_and_deduplicated(spark, tmp_path):
    path = tmp_path / "i.csv"
    path.write_text("zone_id,geoid20,median_household_income\nz2,1,500\nz1,1,700\nz3,2,-666666666\n")
    got = {r.geoid20: (r.zone_id, r.median_household_income) for r in flows.read_income(spark, str(path)).collect()}
    assert got == {"1": ("z1", 700.0), "2": ("z3", None)}


def test_csv_and_json_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, [1.0, 2.0])], "k string, n int, v array<double>")
    flows.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).first().asDict() == {"k": "a", "n": "1", "v": "[1.0,2.0]"}
    flows.write_audit(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().v == [1.0, 2.0]


def test_land_use_masses(spark):
    names = "zone_id counthu e8_ret e8_off e8_svc e8_ent e8_hlth e8_ed e8_pub e8_ind".split()
    row = spark.createDataFrame([("z", *map(float, range(1, 10)))], "zone_id string, " + ", ".join(f"{n} double" for n in names[1:]))
    assert tuple(flows.land_use_masses(row).first()) == ("z", 1.0, 9.0, 5.0, 9.0, 6.0, 15.0)


def test_segments_are_checked(spark):
    days = spark.range(30).select(F.col("id").cast("int").alias("day_idx"))
    kept = select_segments(days, ["buffer"], EVENTS)
    assert [r.day_idx for r in kept.orderBy("day_idx").collect()] == list(range(13, 18))
    for names in (["after"], []):
        with pytest.raises(ValueError):
            select_segments(days, names, EVENTS)


def test_context_modes(spark):
    pairs = spark.createDataFrame([(1, 2, 10.0), (1, 3, 10.0), (1, 9, 10.0)], "origin int, dest int, scale double")
    s = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (2, [0.0, 0.6, 0.8, 0.0, 0.0, 0.0]), (3, [0.0] * 6)], "zone int, share array<double>")
    outer = {r.dest: r for r in features.flow_context(pairs, s, "outer", "scale").collect()}
    assert outer[2].context[1:3] == pytest.approx([6, 8]) and sum(outer[2].context) == pytest.approx(14) and len(outer[2].context) == 36
    assert not outer[3].constrained and not outer[9].constrained and sum(outer[9].context) == 0
    both = {r.dest: r for r in features.flow_context(pairs, s, "sum", "scale").collect()}
    assert both[2].context == pytest.approx([10 / 2**0.5, 6 / 2**0.5, 8 / 2**0.5, 0, 0, 0]) and len(both[9].context) == 6
    with pytest.raises(ValueError):
        features.flow_context(pairs, s, "mean", "scale")


def test_slot_totals_of_a_stream(spark, tmp_path):
    at = lambda h: datetime.datetime(2024, 1, 1, h, 30)
    rows = [(at(0), "a", 1.0), (at(1), "a", 2.0), (at(2), "b", 4.0), (at(23), "a", 1.0)]
    df = spark.createDataFrame(rows, "ts timestamp, event_type string, value double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = slot_totals(stream).writeStream.format("memory").queryName("slots").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = {(r.slot_start, r.event_type): (r.flow, r.n) for r in slot_totals(df).collect()}
    assert {(r.slot_start, r.event_type): (r.flow, r.n) for r in spark.table("slots").collect()} == want
    assert spark.table("slots").agg(F.sum("n")).first()[0] == 4
