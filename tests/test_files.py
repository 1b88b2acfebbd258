"""Round trips of backup and GPX files, and what their readers pass over."""

import gzip
import io
import json
import os
import random
import tempfile
import tracemalloc

import pytest

from waymark.plans.history import History
from waymark.sources import backup, gpx, pull

SF = "/root/testdata/sf0.001"


def folder():
    return tempfile.mkdtemp(prefix="spark-") + "/out"


def test_backup_round_trip(spark):
    h = History(spark, SF)
    path = folder()
    backup.write_backup(h.ends, h.points, h.pins, path, 1_700_000_000_000)
    files = [f"{d}/{f}" for d, _, names in os.walk(path) for f in names if f.endswith(".gz")]
    assert len(files) == h.tracks.select("device_id").distinct().count()
    doc = json.load(gzip.open(files[0]))
    assert doc["format"] == backup.FORMAT and doc["trackCount"] == len(doc["tracks"]) and list(doc["pointFields"]) == list(backup.POINT_FIELDS)
    tracks, points, places = backup.read_backup(spark, path)
    pick = lambda df, *c: sorted(map(tuple, df.select(*c).collect()), key=repr)
    t = ("device_id", "track_id", "activity", "started_at", "ended_at", "source", "distance_m", "good_count", "ignored_count")
    assert pick(tracks, *t) == pick(h.ends, *t)
    p = ("device_id", "track_id", "ts_ms", "lat", "lon", "ignored", "segment_start", "satellites")
    assert pick(points, *p) == pick(h.points, *p)
    s = ("device_id", "place_id", "label", "category", "lat", "lon", "radius_m")
    assert pick(places, *s) == pick(h.pins, *s)


def document(**change):
    d = {"format": backup.FORMAT, "version": 1, "exportedAt": 1, "trackCount": 1, "pointFields": ["lat", "novel", "timestamp", "lon"], "unknown": {"a": [1]}, "tracks": [{"id": 7, "activityType": "KAYAK", "startedAt": 1, "endedAt": 9, "extra": 1, "points": [[1.5, "x", 5, 2.5], [1.6, None, 6, 2.6]]}], "places": [{"id": 1, "label": "A \"b\"", "lat": 1.0, "lon": 2.0, "createdAt": 3}]}
    return d | change


def write(doc):
    path = folder()
    os.makedirs(f"{path}/device_id=4")
    with gzip.open(f"{path}/device_id=4/x.json.gz", "wt") as f:
        json.dump(doc, f)
    return path


def test_backup_fields_by_header_and_defaults(spark):
    tracks, points, places = backup.read_backup(spark, write(document()))
    assert [(r["device_id"], r["activity"], r["source"]) for r in tracks.collect()] == [(4, "KAYAK", "imported")]
    assert sorted((r["ts_ms"], r["lat"], r["lon"], r["ignored"], r["accuracy"]) for r in points.collect()) == [(5, 1.5, 2.5, False, None), (6, 1.6, 2.6, False, None)]
    assert [(r["label"], r["radius_m"], r["category"]) for r in places.collect()] == [('A "b"', 150.0, None)]


def test_backup_defaults_of_points(spark):
    names = [*backup.POINT_FIELDS[:3], "ignored", "segmentStart", "accuracy", "satellitesInFix"]
    track = {"id": 7, "activityType": "WALKING", "startedAt": 1, "endedAt": None, "points": [[5, 1, 2], [6, 1, 2, 1, 0, 4, 3.0], [7, 1.5, 2, None, 1, None]]}
    docs = document(pointFields=names, tracks=[track, track | {"id": 8, "points": []}, track | {"id": 9, "source": "manual"}], places=[{"category": None, "radiusM": 9}, {"id": 3, "category": 4}])
    tracks, points, places = backup.read_backup(spark, write(docs))
    assert sorted((r.track_id, r.source, r.ended_at, r.good_count, r.distance_m) for r in tracks.collect()) == [(7, "recorded", None, 0, 0.0), (8, None, None, 0, 0.0), (9, "manual", None, 0, 0.0)]
    got = [(r.seq, r.ts_ms, r.lat, r.ignored, r.segment_start, r.accuracy, r.satellites) for r in points.where("track_id = 7").orderBy("seq").collect()]
    assert got == [(0, 5, 1.0, False, False, None, None), (1, 6, 1.0, True, False, 4.0, 3), (2, 7, 1.5, False, True, None, None)]
    assert sorted((r.seed_index, r.place_id, r.label, r.radius_m, r.category) for r in places.collect()) == [(0, 0, "", 9.0, None), (1, 3, "", 150.0, None)]


@pytest.mark.parametrize("change,said", [({"tracks": [{"id": 1, "points": []}]}, "activityType"), ({"tracks": [{"activityType": "X", "points": [[1, 2, None, 4]]}]}, "without timestamp")])
def test_backup_refuses_rows(spark, change, said):
    with pytest.raises(Exception, match=said):
        backup.read_backup(spark, write(document(**change)))[1 if said == "without timestamp" else 0].collect()


def test_header_comes_before_tracks():
    late = json.dumps({k: v for k, v in sorted(document().items(), key=lambda x: x[0] == "pointFields")})
    with pytest.raises(ValueError, match="needed field"):
        list(backup.documents(io.StringIO(late), (backup.FORMAT,)))
    for tail in ("x", " {}", ","):
        with pytest.raises(ValueError):
            list(backup.documents(io.StringIO(json.dumps(document()) + tail), (backup.FORMAT,)))
    for bad in ('{"format"', '{"format":"waymark-backup","version":1,"pointFields":["lat","lon","timestamp"],"tracks":[{"id":NaN}]}', '[1]', ""):
        with pytest.raises(ValueError):
            list(backup.documents(io.StringIO(bad), (backup.FORMAT,)))


def test_values_come_whole_at_any_cut(monkeypatch):
    """The reader gives what the standard one gives, wherever the text is cut into chunks."""
    rng = random.Random(4)

    def thing(depth):
        kind = rng.randrange(8 if depth else 5)
        if kind >= 5:
            return [thing(depth - 1) for _ in range(rng.randrange(4))] if kind < 7 else {f'k"{i}\\é': thing(depth - 1) for i in range(rng.randrange(4))}
        return [rng.randint(-(10**17), 10**17), rng.random() * 10 ** rng.randint(-9, 9), rng.choice(['', 'a]}"', "\\", "\u2603\n", "x" * 40]), None, rng.random() < 0.5][kind]

    for size in (1, 2, 7, 64):
        monkeypatch.setattr(pull, "CHUNK", size)
        for _ in range(30):
            d = {"skip": thing(3), "list": [thing(2) for _ in range(rng.randrange(5))], "one": thing(2)}
            p, out = pull.Pull(io.StringIO(json.dumps(d, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])))), {}
            for key in p.members():
                if key == "skip":
                    p.skip()
                else:
                    out[key] = list(p.elements()) if key == "list" else p.value()
            p.end()
            assert out == {k: d[k] for k in ("list", "one")}


def test_a_large_document_is_read_a_track_at_a_time():
    """Some 40 MB of one device: what is held stays near one track, whatever the document's size."""
    track = json.dumps({"id": 1, "activityType": "WALKING", "startedAt": 1, "endedAt": 2, "points": [[1_700_000_000_000 + i, 1.25, 2.5, i * 0.125] for i in range(5000)]})
    head = json.dumps(document(tracks=[], places=[], pointFields=["timestamp", "lat", "lon", "alt"]))
    assert head.count('"tracks": []') == 1
    before, after = head.split('"tracks": []')

    class Text(io.TextIOBase):
        def __init__(self, n):
            self.parts, self.n = iter([before + '"tracks": [', *([track, ","] * n)[:-1], "]" + after]), 0

        def read(self, size):
            return next(self.parts, "")

    def most(n):
        tracemalloc.start()
        rows = sum(b.num_rows for b in backup.batches(Text(n), "points", 1, (backup.FORMAT,)))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows == 5000 * n
        return peak

    assert most(200) < 1.5 * most(10) < 60_000_000


@pytest.mark.parametrize("change", [{"format": "other"}, {"version": 2}, {"version": None}, {"pointFields": ["lat", "lon"]}, {"pointFields": None}])
def test_backup_refuses(spark, change):
    with pytest.raises(Exception, match="backup of a known version|needed field"):
        backup.read_backup(spark, write(document(**change)))[0].collect()


def test_gpx_round_trip(spark):
    h = History(spark, SF)
    few = h.tracks.where("track_id < 40")
    points = h.points.where("track_id < 40")
    docs = gpx.gpx_documents(few, points)
    path = folder()
    gpx.write_gpx(docs, path)
    tracks, read = gpx.read_gpx(spark, path)
    assert tracks.count() == 40 and read.count() == 400
    got = sorted((r["ts_ms"], r["lat"], r["lon"]) for r in read.collect())
    want = sorted((r["ts_ms"] // 1000 * 1000, r["lat"], r["lon"]) for r in points.collect())
    assert got == want
    assert read.where("speed is not null").count() == points.where("speed is not null").count()
    breaks = points.where("segment_start and seq > 0").count()
    assert gpx.importable(read).where("segment_start").count() == breaks


def test_gpx_gathers_measures_not_text(spark):
    h = History(spark, SF)
    plan = gpx.gpx_documents(h.tracks, h.points)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.rsplit("collect_list", 1)
    assert "trkpt" in above + below.split("+- ", 1)[0] and "trkpt" not in below.split("+- ", 1)[1], plan


GPX = """<?xml version="1.0"?><gpx xmlns:gpxtpx="x"><metadata><time>2024-01-01T00:00:00Z</time></metadata>
<trk><type>Mountain biking</type><trkseg>
<trkpt lat="2" lon="2"><time>2024-01-01T10:00:10Z</time></trkpt><trkpt lat="2" lon="2"><time>2024-01-01T10:00:10Z</time></trkpt>
<trkpt lat="1" lon="1"><time>2024-01-01T10:00:00Z</time><ele>5</ele><speed>3.5</speed></trkpt><trkpt lat="9"><time>2024-01-01T10:00:00Z</time></trkpt><trkpt lat="3" lon="3"/></trkseg>
<trkseg><trkpt lat="0" lon="0"><time>2024-01-01T09:00:00</time><extensions><gpxtpx:TrackPointExtension><gpxtpx:speed>1.5</gpxtpx:speed></gpxtpx:TrackPointExtension></extensions></trkpt></trkseg></trk>
<trk><type>x</type><trkseg><trkpt lat="1" lon="1"><time>2024-01-01T10:00:00Z</time></trkpt></trkseg></trk></gpx>"""


def test_gpx_normalised(spark):
    path = folder()
    os.makedirs(path)
    open(f"{path}/a.gpx", "w").write(GPX)
    tracks, points = gpx.read_gpx(spark, path)
    assert sorted(r["activity"] for r in tracks.collect()) == ["CYCLING", "DRIVING"]
    rows = gpx.importable(points).orderBy("seq").collect()
    assert [(r["lat"], r["speed"], r["segment_start"]) for r in rows] == [(0.0, 1.5, False), (1.0, 3.5, True), (2.0, None, False)]
