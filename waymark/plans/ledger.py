"""Registered queries over the stored derivation: repaired after edits, reconciled with moved places."""

from __future__ import annotations

from dataclasses import fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import ledger
from waymark.plans.catalog import LEADERS, recursive
from waymark.plans.ctes import NEAR, TRACK, between, verdict
from waymark.plans.history import History
from waymark.plans.library import EDITED, edited_pins
from waymark.plans.registry import KEY, SQL, query, r
from waymark.sources.shared import kept

#: Tracks that start later are added to a derivation that was stored without them.
LATE_MS = 1_705_500_000_000
SPHERE = {"distance": geo.haversine_m, "one": geo.one_sphere_m}


def held(d: ledger.Derivation) -> ledger.Derivation:
    return ledger.Derivation(*(kept(getattr(d, f.name), f.name) for f in fields(d)))


def ends(h: History) -> DataFrame:
    return h.pinned.select(*KEY, *ledger.ENDS, "start_pin", "end_pin")


def edits(h: History) -> tuple[ledger.Derivation, DataFrame, DataFrame]:
    """(stored, tracks now, changed tracks): late tracks came, and every third of those from a place to a place went."""
    e = kept(ends(h), "ends")
    gone = (F.col("track_id") % 3 == 0) & F.col("start_pin").isNotNull() & F.col("end_pin").isNotNull()
    late = F.col("started_at") >= LATE_MS
    stored = held(ledger.derive(e.where(~late), ledger.seeds(h.pins, "seed_index"), **SPHERE))
    return stored, e.where(~gone), e.where(late | gone).select(*KEY)


GONE = "(track_id % 3 = 0 and start_pin is not null and end_pin is not null)"
#: As LEADERS, over other tracks and pins; each cluster's name besides.
NAMED = """nam as (select c.*, case when cluster < s.n then 'p' || s.ids[cluster + 1] else first_value('t' || track_id || case when is_start then 's' else 'e' end) over (partition by c.device_id, cluster order by c.n) end as cluster_id
    from clu c join (select device_id, count(*) as n, list(place_id order by {order}) as ids from {pins} group by all) s on s.device_id = c.device_id)"""
KEPT = f"""kept as (select * from pinned where not {GONE}),
    kepn as (select e.*, row_number() over (partition by e.device_id order by t.started_at, e.track_id, not e.is_start) as n from endp e join kept t on t.device_id = e.device_id and t.track_id = e.track_id),
    {LEADERS.replace("epn", "kepn")}, {NAMED.format(order="seed_index", pins="pins")}"""


@query()
def repaired_intervals(h: History) -> DataFrame:
    """What lies between tracks after a batch of edits, by what the edits move."""
    d = ledger.repair(*edits(h), **SPHERE)
    return d.intervals.select("device_id", "after_track_id", "next_id", "kind", "reason", "start", "end", "cluster_id", "to_cluster_id")


SQL["repaired_intervals"] = recursive(
    """select device_id, after_track_id, next_id, kind, reason, "start", "end", case when kind != 'NONE' then from_cluster end as cluster_id, case when kind = 'GAP' then to_cluster end as to_cluster_id from cvl""",
    KEPT
    + f""",
    ced as (select e.*, s.cluster_id as start_cluster, f.cluster_id as end_cluster from kept e left join nam s on s.device_id = e.device_id and s.track_id = e.track_id and s.is_start left join nam f on f.device_id = e.device_id and f.track_id = e.track_id and not f.is_start),
    cvl as ({verdict(f"({NEAR} or coalesce(from_cluster = to_cluster, false) or coalesce(from_pin = to_pin, false))")} from ({between("ced", ", end_cluster as from_cluster, lead(start_cluster) over w as to_cluster, end_pin as from_pin, lead(start_pin) over w as to_pin")}))""",
    "epn", "pins", "pinned",
)


@query()
def repaired_clusters(h: History) -> DataFrame:
    """Clusters after the same edits: their sums and counts moved by what joined and what left."""
    return ledger.repair(*edits(h), **SPHERE).clusters.select("device_id", "cluster_id", "members", r("sum_lat", 7), r("sum_lon", 7), r("anchor_lat", 6), r("anchor_lon", 6))


SQL["repaired_clusters"] = recursive(
    f"""select c.device_id, c.cluster_id, c.members, c.sum_lat, c.sum_lon, c.anchor_lat, c.anchor_lon from (select device_id, cluster_id, count(*) as members, round(sum(lat), 7) as sum_lat, round(sum(lon), 7) as sum_lon, round(any_value(anchors[cluster + 1].lat), 6) as anchor_lat, round(any_value(anchors[cluster + 1].lon), 6) as anchor_lon from nam group by all) c
    union all select device_id, 'p' || place_id, 0, 0e0, 0e0, round(lat, 6), round(lon, 6) from pins p where not exists (select 1 from nam where nam.device_id = p.device_id and nam.cluster_id = 'p' || p.place_id)""",
    KEPT, "epn", "pins", "pinned",
)


@query()
def reconciled_clusters(h: History) -> DataFrame:
    """Clusters after places were edited: one reaches less far, one is gone, one is new; ids last where places and founders do."""
    e = h.ends.select(*KEY, *ledger.ENDS)
    stored = ledger.derive(e, ledger.seeds(h.pins, "seed_index"), **SPHERE)
    # of what is stored only the clusters are read here
    stored = replace(stored, clusters=kept(stored.clusters, "clusters"))
    d = ledger.reconcile(stored, e, ledger.seeds(edited_pins(h).where("label != 'Gym'")), **SPHERE)
    return d.clusters.select("device_id", "cluster_id", "members", r("sum_lat", 7), r("sum_lon", 7))


SQL["reconciled_clusters"] = recursive(
    """select device_id, cluster_id, count(*) as members, round(sum(lat), 7) as sum_lat, round(sum(lon), 7) as sum_lon from nam group by all
    union all select device_id, 'p' || place_id, 0, 0e0, 0e0 from newp p where not exists (select 1 from nam where nam.device_id = p.device_id and nam.cluster_id = 'p' || p.place_id)""",
    f"newp as (select *, place_id as seed_index from {EDITED} where label != 'Gym'), {LEADERS.replace('from pins', 'from newp')}, {NAMED.format(order='seed_index', pins='newp')}",
    "epn", "pins",
)
