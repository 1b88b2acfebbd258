"""Fixes are dealt into more parts where there are more tracks, and what is made of all of them is made once."""

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from waymark.operators import ledger, places, tracks
from waymark.plans import catalog, edits, history  # noqa: F401  edits registers its queries
from waymark.plans import ledger as plan_ledger
from waymark.sources import columnar, shared

SF = "/root/testdata/sf0.001"


def test_more_tracks_are_dealt_into_more_parts(spark, monkeypatch):
    monkeypatch.setattr(history, "PART_TRACKS", 50)
    p = catalog.History(spark, SF).points
    assert p.rdd.getNumPartitions() == 1000 // 50


def test_rows_are_dealt_into_as_many_parts_as_they_need(spark):
    rows = spark.range(100)
    assert shared.dealt(rows, "id", rows=100, each=10).rdd.getNumPartitions() == 10
    assert shared.dealt(rows, "id", rows=100, each=1000).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_fixes_are_not_made_again_for_each_use_of_their_ends(spark):
    h = catalog.History(spark, SF)
    for df in (h.end_pins, h.pin_stays):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [event_id") == 1, plan  # the devices of pins


def test_devices_are_walked_in_one_stream_and_whole(spark):
    h = catalog.History(spark, SF)
    df = places.greedy_clusters(h.endpoints, h.pins)
    assert "FlatMapCoGroups" not in df._jdf.queryExecution().executedPlan().toString()
    whole = sorted(map(tuple, df.collect()), key=str)
    # a device's rows come in several batches
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert sorted(map(tuple, df.collect()), key=str) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_device_is_walked_whole_though_its_pins_and_ends_come_dealt_alike(spark):
    ends = spark.createDataFrame([(d, t, 0, True, 38.0, -9.0) for d in range(20) for t in range(3)], "device_id long, track_id long, started_at long, is_start boolean, lat double, lon double")
    ends = ends.withColumn("started_at", F.row_number().over(Window.partitionBy("device_id").orderBy("track_id")).cast("long"))  # small parts, which Spark merges
    pins = spark.createDataFrame([(d, 0, 38.0, -9.0, 150.0) for d in range(20)], "device_id long, seed_index int, lat double, lon double, radius_m double")
    got = places.greedy_clusters(ends, shared.dealt(pins, "device_id")).collect()
    assert len(got) == 60 and {r.seed for r in got} == {0}


def test_endpoints_that_are_walked_are_not_joined_back(spark):
    h = catalog.History(spark, SF)
    ends = h.ends.select("device_id", "track_id", *ledger.ENDS)
    members = ledger.derive(ends, ledger.seeds(h.pins, "seed_index")).members
    plan = members._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("Join", plan)) == 1 and "started_at" in plan, plan  # with the places' names


def test_a_reconciliation_of_clusters_writes_them_and_ends_alone(spark, monkeypatch):
    written = []
    for module in (history, plan_ledger):
        monkeypatch.setattr(module, "kept", lambda df, what, *path: written.append(what) or shared.kept(df, what, *path))
    catalog.QUERIES["reconciled_clusters"](spark, SF)
    assert sorted(written) == ["clusters", "ends"]


def test_a_track_and_its_lines_are_packed_where_its_fixes_are(spark):
    plan = columnar.packed(catalog.History(spark, SF).points)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert plan.count("Exchange hashpartitioning(device_id#") == 2, plan  # by device for the events before, then by track


@pytest.mark.parametrize("name", ["finished_fixes", "jump_restores"])
def test_verdicts_are_told_where_the_fixes_are(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    # by device for the events before, then by track; nothing is joined back to fixes by their numbers
    assert not re.findall(r"(?:Exchange hashpartitioning\(|SortMergeJoin \[)[^\])\n]*seq#", plan), plan


def test_a_pass_over_fixes_gives_their_statistics(spark):
    rows = [(1, 1, 0, 0, 38.0, -9.0, True), (1, 1, 1, 10, 38.0, -9.0, False), (1, 1, 2, 20, 39.0, -9.0, True), (1, 1, 3, 30, None, None, False), (1, 1, 4, 40, 38.001, -9.0, False), (1, 1, 5, 50, 38.002, -9.0, False), (1, 2, 0, 0, 38.0, -9.0, True)]
    s = tracks.stats(spark.createDataFrame(rows, "device_id long, track_id long, seq int, ts_ms long, lat double, lon double, ignored boolean"))
    got = {r.track_id: r for r in s.collect()}
    assert (got[1].good_count, got[1].ignored_count, got[1].start_lat, got[1].end_lat, got[1].first_ms, got[1].last_ms) == (4, 2, 38.0, 38.002, 10, 50)
    assert got[1].distance_m == pytest.approx(111.195, abs=0.01)  # none over a fix without a place
    assert (got[2].good_count, got[2].ignored_count, got[2].distance_m, got[2].extent_m, got[2].start_lat, got[2].first_ms) == (0, 1, 0.0, 0.0, None, None)
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
