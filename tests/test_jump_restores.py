"""What a restored jump is the base of."""

from waymark.operators import points


def test_a_restored_jump_is_the_base_over_fixes_that_stay_ignored(spark):
    # the last fix is at 300 km/h from the restored one, at 133 from the first
    rows = [(1, 1, 0, 0, 0.0, 0.0, None), (1, 1, 1, 1_000, 0.0005, 0.0, "jump"), (1, 1, 2, 2_000, 0.0, 0.0, "accuracy"), (1, 1, 3, 3_000, -0.001, 0.0, "jump")]
    df = spark.createDataFrame(rows, "device_id long, track_id long, seq int, ts_ms long, lat double, lon double, reason string")
    assert [r.seq for r in points.restored_jumps(df, 220.0).collect()] == [1]
