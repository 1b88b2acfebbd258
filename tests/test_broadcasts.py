"""Tables that grow with what is recorded are not sent to the driver and to all tasks, however small they look."""

import re

import pytest

from waymark.plans import catalog, edits, library, shown  # noqa: F401  register their queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["duplicate_check", "finished_fixes", "merged_fixes", "split_halves", "journey_lines", "journey_names", "journey_slice", "journey_spent", "journey_stay_overlap", "journey_totals", "journey_windows", "year_sections", "color_runs", "columnar_tracks"])
def test_no_growing_table_is_broadcast(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan, re.findall(r"BroadcastHashJoin[^\n]*", plan)


def test_fixes_are_in_as_many_parts_as_are_shuffled_to(spark):
    # a track is few bytes, so its parts were merged before it became ten fixes
    p = catalog.History(spark, SF).points
    assert p.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_colour_runs_shuffle_fixes_once(spark):
    plan = catalog.QUERIES["color_runs"](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan


@pytest.mark.parametrize("name", ["journey_lines", "journey_names", "journey_slice", "journey_spent", "journey_stay_overlap", "journey_windows"])
def test_no_growing_table_is_broadcast_to_what_is_written_on_the_way(spark, name):
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    catalog.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs = store.executionsList(before, 1000)
    plans = [runs.apply(k).physicalPlanDescription() for k in range(runs.size())]
    assert len(plans) > 3  # ends, pinned, journeys and what is made of them
    broadcast = [line for p in plans for line in p.split("\n\n")[0].split("\n") if "BroadcastExchange" in line]
    assert not broadcast, broadcast
