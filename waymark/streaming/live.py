"""Live recording as a stateful stream, keyed by device.

Fixes, activity readings and idle positions go in; recorded points and the
session's events come out, or a numbered log of what the recorder is to do. State
is small: the session, the gate that readings pass, what is known of their source,
the number of the log's last row, and the fixes of the last minute. Order within a
micro-batch is by time; what comes too late is judged by the rules, not dropped by a
watermark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from waymark.config import Live, Quality
from waymark.operators.dwells import near_m
from waymark.schemas import ACTIVITIES

INPUT = "device_id long, kind string, at timestamp, at_ms long, seq long, lat double, lon double, accuracy double, gnss_ok boolean, activity string, event_ms long"
OUTPUT = "device_id long, event string, track_no long, at_ms long, seq long, activity string, reason string, motion string, segment_start boolean"
EFFECTS = "device_id long, n long, effect string, at_ms long, track_no long, activity string, value long"
#: State variables by name; the fixes of the last minute are a list beside them.
STATES = {
    "session": "phase string, activity string, deadline long, track_no long, good_ts long, good_lat double, good_lon double, pending boolean, stopped_since long, still_ms long, fast_ms long, sample_ms long, sample_still boolean, sample_fast boolean, accepted_ms long, anchor_lat double, anchor_lon double, anchor_m double, nearly boolean, probe_ms long, failed int, retry_ms long",
    "gate": "confirmed string, held string, held_kind string, held_at long, held_until long, last_reading long",
    "hearing": "armed_ms long, registered_ms long, restarted_ms long, detections int, warned boolean",
    "log": "logged long",
}
WINDOW = "t long, lat double, lon double"
#: Oldest reading that is believed, wait for an arrival, waits of the carrier rule, margins of a departure, sharp enough an anchor.
OLDEST_READING_MS, ARRIVAL_MS = 6 * 3_600_000, 240_000
#: After reception was given up, the first wait until it is tried again, and the longest.
RETRY_MS, RETRY_MOST_MS = 120_000, 480_000
CREDIT_MS, STILL_PROVES_MS, FAST_PROVES_MS = 35_000, 60_000, 120_000
MARGIN_M, SOLO_MARGIN_M, SHARP_M = 50.0, 150.0, 50.0
FOOT_KMH = 30.0
#: A reading this late was never delivered live, if it moves the clock on by so much; what a registration is answered with; rest between restarts; proofs before a warning.
LATE_MS, ADVANCE_MS, REPLAY_MS, RESTART_GAP_MS, PROOFS = 60_000, 1_000, 60_000, 300_000, 2
#: What the recorder does on an event, in order; WAKE_AT and RETRY_AT have an instant as value.
DOES = {
    "START": ("GPS_ON", "OPEN_TRACK"),
    "RESUME": ("GPS_ON",),
    "PAUSE": ("GPS_OFF", "WAKE_AT"),
    "FINISH": ("GPS_OFF", "CLOSE_TRACK"),
    "GAVE_UP": ("GPS_OFF", "RETRY_AT"),
    "PROBED": ("GPS_ON",),
    "ANCHORED": ("ARM_FENCE",),
    "DEPARTED": ("DISARM_FENCE",),
    "READ": ("STAMP_READING",),
    "RESTART": ("RESTART_REGISTRATION",),
    "DEAF": ("WARN",),
    "HEARS": ("WITHDRAW_WARNING",),
}


@dataclass
class Recorder:
    """One device's state and the rules that move it on; each rule returns events."""

    phase: str = "IDLE"
    activity: str | None = None
    confirmed: str = "STILL"
    held: str | None = None
    held_kind: str | None = None
    deadline: int | None = None
    track_no: int = 0
    last_reading: int | None = None
    good_ts: int | None = None
    good_lat: float | None = None
    good_lon: float | None = None
    pending: bool = False
    stopped_since: int | None = None
    times: list = field(default_factory=list)
    lats: list = field(default_factory=list)
    lons: list = field(default_factory=list)
    still_ms: int = 0
    fast_ms: int = 0
    sample_ms: int | None = None
    sample_still: bool = False
    sample_fast: bool = False
    accepted_ms: int | None = None
    anchor_lat: float | None = None
    anchor_lon: float | None = None
    anchor_m: float | None = None
    nearly: bool = False
    probe_ms: int | None = None
    failed: int = 0
    retry_ms: int | None = None
    held_at: int | None = None
    held_until: int | None = None
    armed_ms: int | None = None
    registered_ms: int | None = None
    restarted_ms: int | None = None
    detections: int = 0
    warned: bool = False
    logged: int = 0

    def event(self, name: str, at: int, **more) -> dict:
        return {"event": name, "track_no": self.track_no, "at_ms": at, "activity": self.activity} | more

    def motion(self, now: int, rule: Live) -> tuple[str, float]:
        """By the fixes of the last minute: (MOVING, m/s), STOPPED or UNKNOWN."""
        span = int(rule.span_s * 1000)
        first = next((i for i, t in enumerate(self.times) if now - t <= max(60_000, 2 * span)), len(self.times))
        for name in ("times", "lats", "lons"):
            setattr(self, name, getattr(self, name)[first:])
        n = len(self.times)
        if n < rule.min_fixes or self.times[-1] - self.times[0] < span:
            return "UNKNOWN", 0.0
        half = n // 2
        early, late = ([sum(x[a:b]) / (b - a) for x in (self.lats, self.lons)] for a, b in ((0, half), (half, n)))
        moved = float(near_m(*early, *late))
        if moved >= rule.moving_m:
            seconds = (sum(self.times[half:]) // (n - half) - sum(self.times[:half]) // half) / 1000
            return ("MOVING", moved / seconds) if seconds > 0 else ("UNKNOWN", 0.0)
        spread = max(float(near_m(self.lats[0], self.lons[0], y, x)) for y, x in zip(self.lats, self.lons))
        return ("STOPPED", 0.0) if spread <= rule.still_m else ("UNKNOWN", 0.0)

    def start(self, activity: str, at: int) -> dict:
        self.track_no += 1
        self.phase, self.activity, self.deadline = "RECORDING", activity, None
        self.good_ts = self.good_lat = self.good_lon = self.stopped_since = self.sample_ms = None
        self.still_ms = self.fast_ms = 0
        self.pending, self.accepted_ms = False, None
        self.probe_ms, self.failed, self.retry_ms = at, 0, None
        self.anchor_lat = self.anchor_lon = self.anchor_m = None
        return self.event("START", at)

    def finish(self, at: int) -> dict:
        proven = self.still_ms >= STILL_PROVES_MS or self.fast_ms >= FAST_PROVES_MS
        renamed = "UNKNOWN" if proven and group(self.activity) == "FOOT" else self.activity
        out = self.event("FINISH", at) | {"activity": renamed}
        self.phase, self.activity, self.deadline, self.retry_ms = "IDLE", None, None, None
        return out

    def tick(self, now: int, resume_ms: int = 180_000) -> list[dict]:
        """What the passing of time does: a stop that nothing bore out lands at its own time, and a pause runs out."""
        out = []
        if self.held_kind == "UNCORROBORATED" and now >= self.held_until:
            out = self.settle(self.held, self.held_at, resume_ms)
        return out + ([self.finish(self.deadline)] if self.phase == "PAUSED" and now >= self.deadline else [])

    def arm(self, now: int) -> list[dict]:
        """Recording is switched on: nothing is held, the body is taken to be still, and the source is judged from here on."""
        self.confirmed, self.held, self.held_kind, self.held_until = "STILL", None, None, None
        self.armed_ms = self.registered_ms = now
        self.detections, self.warned = 0, False
        return []

    def doubt(self, raw: str, motion: str, mps: float, rule: Live) -> str | None:
        """Why a reading isn't believed yet: the ground moves too fast for it, or says nothing of a stop."""
        if contradicts(raw, motion, mps):
            return "CONTRADICTED"
        return "UNCORROBORATED" if raw == "STILL" and motion == "UNKNOWN" and rule.hold_s > 0 else None

    def released(self, motion: str, mps: float) -> bool:
        """Whether what is held may land: a contradiction when it ceases, an unborne stop only when the ground stands still."""
        return motion == "STOPPED" if self.held_kind == "UNCORROBORATED" else not contradicts(self.held, motion, mps)

    def heard(self, at: int, event_ms: int | None, now: int, last: int | None) -> list[dict]:
        """What a reading tells of its source: one that comes late and yet moves the clock on was never delivered live.

        Two such proofs warn. A prompt reading withdraws the warning, unless it may be
        the answer to a new registration.
        """
        if self.armed_ms is None:
            return []
        out = []
        if event_ms is not None and last is not None and at > last + ADVANCE_MS and at > self.armed_ms and now - at > LATE_MS:
            if self.restarted_ms is None or now - self.restarted_ms > RESTART_GAP_MS:
                self.restarted_ms = self.registered_ms = now
                out.append(self.event("RESTART", now))
            self.detections += 1
            if not self.warned and self.detections >= PROOFS:
                self.warned = True
                out.append(self.event("DEAF", now))
        elif now - at <= LATE_MS and now - self.registered_ms >= REPLAY_MS:
            self.detections = 0
            if self.warned:
                self.warned = False
                out.append(self.event("HEARS", now))
        return [*out, self.event("READ", at)]

    def settle(self, activity: str, at: int, resume_ms: int) -> list[dict]:
        """What a reading that is believed does to the session."""
        self.held = self.held_kind = self.held_until = None
        self.confirmed = activity
        if activity == "STILL":
            if self.phase != "RECORDING":
                return []
            self.phase, self.deadline = "PAUSED", at + resume_ms
            return [self.event("PAUSE", at, value=self.deadline)]
        same = self.activity is not None and group(self.activity) == group(activity)
        if self.phase == "RECORDING" and same:
            self.activity = activity
            return [self.event("CONTINUE", at)]
        if self.phase == "PAUSED" and same and at < self.deadline:
            self.phase, self.deadline, self.pending = "RECORDING", None, True
            return [self.event("RESUME", at)]
        ended = [self.finish(at if self.phase == "RECORDING" else min(at, self.deadline))] if self.phase != "IDLE" else []
        return [*ended, self.start(activity, at)]

    def reading(self, raw: str, event_ms: int | None, now: int, resume_ms: int, rule: Live) -> list[dict]:
        """A reading counts at its own time if that is likely, and never before the last one."""
        at = now if event_ms is None or event_ms > now or now - event_ms > OLDEST_READING_MS else event_ms
        last = self.last_reading
        at = self.last_reading = max(at, last if last is not None else at)
        out = self.heard(at, event_ms, now, last) + self.tick(at, resume_ms)
        if raw == self.confirmed:
            self.held = self.held_kind = self.held_until = None
            return out
        motion, mps = self.motion(now, rule)
        kind = self.doubt(raw, motion, mps, rule)
        if kind:
            self.held, self.held_kind, self.held_at = raw, kind, at
            self.held_until = now + int(rule.hold_s * 1000) if kind == "UNCORROBORATED" else None
            return [*out, self.event("HELD", at, reason=raw)]
        return out + self.settle(raw, at, resume_ms)

    def fix(self, x: dict, resume_ms: int, rule: Live, quality: Quality) -> list[dict]:
        at, lat, lon = x["at_ms"], x["lat"], x["lon"]
        out = self.tick(at, resume_ms)
        if self.phase != "RECORDING":
            return out
        if self.retry_ms is not None:
            if at < self.retry_ms:
                return out
            self.retry_ms, self.probe_ms, self.accepted_ms = None, at, None
            out.append(self.event("PROBED", at))
        motion, mps = self.motion(at, rule)
        reason = "no_gnss" if x["gnss_ok"] is False else "accuracy" if x["accuracy"] is not None and x["accuracy"] >= quality.max_accuracy_m else None
        if reason is None and self.good_ts is not None and not self.pending:
            top = ACTIVITIES.get(self.confirmed, ("UNKNOWN", 220.0))[1]
            if motion == "MOVING":
                top = max(top, min(mps * 3.6 * quality.raised_by, quality.raised_most_kmh))
            metres, ms = float(near_m(self.good_lat, self.good_lon, lat, lon)), at - self.good_ts
            kmh = metres / (ms / 1000) * 3.6 if ms > 0 else float("inf") if metres > quality.standing_jump_m else 0.0
            reason = "jump" if kmh > top else None
        if reason in (None, "jump") and (not self.times or at >= self.times[-1]):
            self.times, self.lats, self.lons = [*self.times, at], [*self.lats, lat], [*self.lons, lon]
        self.sample(at, motion, mps)
        begins = self.pending and reason is None
        if reason is None:
            self.good_ts, self.good_lat, self.good_lon, self.pending, self.accepted_ms, self.failed = at, lat, lon, False, at, 0
        out.append(self.event("POINT", at, seq=x["seq"], reason=reason, motion=motion, segment_start=begins))
        if self.held and self.released(motion, mps):
            # a contradicted stop begins when the ground agrees, an unborne one when it was read
            out += self.settle(self.held, at if self.held_kind == "CONTRADICTED" else self.held_at, resume_ms)
        return out + self.arrived(at, motion, resume_ms) + self.lost(at, motion, rule)

    def sample(self, at: int, motion: str, mps: float) -> None:
        """Evidence that something carries the device: it moves while the body is still, or too fast for its legs."""
        if self.sample_ms is not None and at < self.sample_ms:
            return
        still = motion == "MOVING" and self.held == "STILL"
        fast = motion == "MOVING" and mps * 3.6 > max(c for g, c in ACTIVITIES.values() if g == group(self.activity))
        if self.sample_ms is not None:
            credit = min(at - self.sample_ms, CREDIT_MS)
            self.still_ms += credit if still and self.sample_still else 0
            self.fast_ms += credit if fast and self.sample_fast else 0
        self.sample_ms, self.sample_still, self.sample_fast = at, still, fast

    def arrived(self, at: int, motion: str, resume_ms: int) -> list[dict]:
        """A long standstill is a stop since it began."""
        if motion == "MOVING":
            self.stopped_since = None
        elif motion == "STOPPED" and self.stopped_since is None:
            self.stopped_since = at
        since = self.stopped_since
        if self.phase != "RECORDING" or since is None or at - since < max(resume_ms, ARRIVAL_MS):
            return []
        self.stopped_since = None
        stop = self.settle("STILL", since, resume_ms)
        return [self.event("ARRIVED", since), *stop, *self.tick(at, resume_ms)]

    def lost(self, at: int, motion: str, rule: Live) -> list[dict]:
        """Nothing good for long, and not on the move: reception is given up, for longer each time that trying fails."""
        since = max(self.probe_ms or 0, self.accepted_ms or 0)
        if not rule.give_up_s or self.phase != "RECORDING" or motion == "MOVING" or at - since < rule.give_up_s * 1000:
            return []
        self.failed += 1
        self.retry_ms = at + min(RETRY_MS << min(self.failed - 1, 2), RETRY_MOST_MS)
        return [self.event("GAVE_UP", at, value=self.retry_ms)]

    def position(self, x: dict, rule: Live = Live(), resume_ms: int = 180_000) -> list[dict]:
        """An idle device has departed when it is farther from its anchor than both errors and a margin."""
        if self.phase != "IDLE":
            return []
        lat, lon, error = x["lat"], x["lon"], x["accuracy"] or 0.0
        if self.anchor_lat is None:
            self.anchor_lat, self.anchor_lon, self.anchor_m, self.nearly = lat, lon, error, False
            return [self.event("ANCHORED", x["at_ms"])]
        gap, both = float(near_m(self.anchor_lat, self.anchor_lon, lat, lon)), self.anchor_m + error
        margin = MARGIN_M if self.nearly else SOLO_MARGIN_M
        self.nearly = gap > MARGIN_M + both
        if gap > margin + both:
            self.anchor_lat = None
            out = [self.event("DEPARTED", x["at_ms"])]
            # adopted, not read: else the stop that ends the track would be no change
            return out + self.settle("UNKNOWN", x["at_ms"], resume_ms) if rule.departures_open else out
        if self.anchor_m >= SHARP_M > error:
            self.anchor_lat, self.anchor_lon, self.anchor_m, self.nearly = lat, lon, error, False
            return [self.event("ANCHORED", x["at_ms"])]
        return []


def group(activity: str | None) -> str:
    return ACTIVITIES.get(activity, ("UNKNOWN", 0.0))[0]


def contradicts(raw: str, motion: str, mps: float) -> bool:
    top = 0.0 if raw == "STILL" else FOOT_KMH if group(raw) == "FOOT" else float("inf")
    return motion == "MOVING" and mps * 3.6 > top


#: Events that tell of the readings' source only.
QUIET = ("READ", "RESTART", "DEAF", "HEARS")


def numbered(r: Recorder, events: list[dict]) -> list[dict]:
    """The effects of events, each with the next number of the device's log."""
    out = []
    for e in events:
        for effect in DOES.get(e["event"], ()):
            r.logged += 1
            timed = effect in ("WAKE_AT", "RETRY_AT")
            out.append({"n": r.logged, "effect": effect, "at_ms": e["at_ms"], "track_no": e["track_no"], "activity": e["activity"], "value": e.get("value") if timed else None})
    return out


class LiveProcessor(StatefulProcessor):
    def __init__(self, resume_ms: int = 180_000, rule: Live = Live(), quality: Quality = Quality(), effects: bool = False):
        self.resume_ms, self.rule, self.quality, self.effects = resume_ms, rule, quality, effects

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.states = {name: handle.getValueState(name, schema) for name, schema in STATES.items()}
        self.window = handle.getListState("window", WINDOW)

    def load(self) -> Recorder:
        held = {}
        for name, schema in STATES.items():
            if self.states[name].exists():
                held |= dict(zip([c.split()[0] for c in schema.split(", ")], self.states[name].get()))
        fixes = list(self.window.get()) if self.window.exists() else []
        return Recorder(**held, times=[f[0] for f in fixes], lats=[f[1] for f in fixes], lons=[f[2] for f in fixes])

    def save(self, r: Recorder) -> None:
        values = asdict(r)
        for name, schema in STATES.items():
            self.states[name].update(tuple(values[c.split()[0]] for c in schema.split(", ")))
        fixes = list(zip(r.times, r.lats, r.lons))
        self.window.put(fixes) if fixes else self.window.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        for due in {r.deadline if r.phase == "PAUSED" else None, r.held_until} - {None}:
            self.handle.registerTimer(due)

    def frame(self, key, events: list[dict]) -> pd.DataFrame:
        if self.effects:
            return pd.DataFrame([{"device_id": key[0]} | e for e in events], columns=[c.split()[0] for c in EFFECTS.split(", ")]).astype({"value": "Int64"})
        names = [x.split()[0] for x in OUTPUT.split(", ")]
        out = pd.DataFrame([{"device_id": key[0]} | e for e in events]).reindex(columns=names)
        plain = {c: out[c].astype(object).where(out[c].notna(), None) for c in ("event", "activity", "reason", "motion")}
        return out.assign(**plain).astype({"seq": "Int64", "device_id": "int64", "track_no": "int64", "at_ms": "int64", "segment_start": "boolean"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        r, events = self.load(), []
        batch = pd.concat(list(rows)).sort_values(["at_ms", "seq"], kind="stable")
        for x in batch.to_dict("records"):
            x = {k: None if v is None or v != v else v for k, v in x.items()}
            if x["kind"] == "fix":
                events += r.fix(x, self.resume_ms, self.rule, self.quality)
            elif x["kind"] == "activity":
                events += r.reading(x["activity"], None if x["event_ms"] is None else int(x["event_ms"]), x["at_ms"], self.resume_ms, self.rule)
            elif x["kind"] == "position":
                events += r.tick(x["at_ms"], self.resume_ms) + r.position(x, self.rule, self.resume_ms)
            elif x["kind"] == "armed":
                events += r.arm(x["at_ms"])
        yield from self.told(key, r, events)

    def told(self, key, r: Recorder, events: list[dict]) -> Iterator[pd.DataFrame]:
        """The rows of what happened, after the state is saved: events, or numbered effects."""
        events = numbered(r, events) if self.effects else [e for e in events if e["event"] not in QUIET]
        self.save(r)
        if events:
            yield self.frame(key, events)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        r = self.load()
        yield from self.told(key, r, r.tick(expiredTimerInfo.getExpiryTimeInMs(), self.resume_ms))

    def close(self) -> None:
        pass


def live(stream: DataFrame, late: str = "10 minutes", **rules) -> DataFrame:
    """Events of a stream of INPUT rows; needs Spark's RocksDB state store.

    A pause whose window runs out ends its track when the watermark passes it.
    """
    rows = stream.withWatermark("at", late).groupBy("device_id")
    return rows.transformWithStateInPandas(statefulProcessor=LiveProcessor(**rules), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime", eventTimeColumnName="")


def effect_log(stream: DataFrame, path: str, checkpoint: str, late: str = "10 minutes", **rules):
    """A query that writes what recorders are to do, in order: EFFECTS under ``path``, n counting up from 1 for each device.

    Numbers are kept with the state, so a micro-batch that runs again after a failure
    makes the same rows with the same numbers, and they replace what it had written.
    """
    rows = stream.withWatermark("at", late).groupBy("device_id")
    log = rows.transformWithStateInPandas(statefulProcessor=LiveProcessor(**rules, effects=True), outputStructType=EFFECTS, outputMode="Append", timeMode="EventTime", eventTimeColumnName="")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def as_input(points: DataFrame) -> DataFrame:
    """Recorded points as live fixes, for replays."""
    null = lambda kind: F.lit(None).cast(kind)
    return points.select("device_id", F.lit("fix").alias("kind"), F.timestamp_millis("ts_ms").alias("at"), F.col("ts_ms").alias("at_ms"), F.col("seq").cast("long").alias("seq"), "lat", "lon", F.col("accuracy").cast("double").alias("accuracy"), (F.col("satellites") >= 1).alias("gnss_ok"), null("string").alias("activity"), null("long").alias("event_ms"))
