"""Geofences over a stream of raw scans: a grid join with the nodes, then state per session."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.geo import haversine_km
from ..operators.geofence import BUFFER_KM, RADIUS_KM, fences_of_reaches, reach_of
from ..operators.links import all_round, at_home

OUTPUT = "session_id string, event_id long, node_id string, distance_km double, trigger_state string, user_mode string"
#: Milliseconds of a session's scans that are put in order at a time.
BUCKET_MS = 10_000
#: Steps an octave of the stream's reaches: nodes are kept for all of them.
PARTS = 1


def next_state(previous: str | None, distance_km: float, radius_km: float, buffer_km: float = BUFFER_KM) -> str:
    if distance_km <= radius_km:
        return "INSIDE" if previous in ("ENTERED", "INSIDE") else "ENTERED"
    if distance_km > radius_km + buffer_km:
        return "EXITED"
    return previous or "EXITED"


def with_near_nodes(scans: DataFrame, nodes: DataFrame, buffer_km: float = BUFFER_KM) -> DataFrame:
    """Each scan of a stream once for each node (node_id, lat, lng) within its radius and the
    buffer, with node_id and distance_km, or once with nulls. Scans are keyed by the
    cell they are in and meet a static table of the cells around each node."""
    radius = F.coalesce(F.col("radius_km").cast("double"), F.lit(RADIUS_KM))
    usable = ~F.coalesce("is_reset", F.lit(False))
    asked = scans.withColumns({"radius_km": radius, "lat": F.when(usable, F.col("latitude")), "lng": F.when(usable, F.col("longitude")), "reach": reach_of(radius + buffer_km, PARTS)})
    there = all_round(fences_of_reaches(nodes, PARTS), F.col("reach")).select(F.col("id").alias("node_id"), F.col("lat").alias("n_lat"), F.col("lng").alias("n_lng"), F.col("reach").alias("n_reach"), F.col("band").alias("n_band"), F.col("cell").alias("n_cell"))
    placed = at_home(asked, F.col("reach"), keep_all=True)
    km = haversine_km("lat", "lng", "n_lat", "n_lng")
    met = placed.join(there, (F.col("band") == F.col("n_band")) & (F.col("cell") == F.col("n_cell")) & (F.col("reach") == F.col("n_reach")) & (km <= F.col("radius_km") + buffer_km), "left")
    return met.select("session_id", "event_id", "ts", "radius_km", "is_teleport_mode", "is_reset", F.col("lat").isNotNull().alias("placed"), "node_id", km.alias("distance_km"))


class Geofence(StatefulProcessor):
    """The states of one session's nodes.

    Rows wait in the state, in buckets of event time, until the watermark passes their
    bucket's end and its timer puts them in order; so neither a session nor a batch of
    any size is held at once, and batches may bring rows out of order. Scans are
    numbered: a node whose last near scan is not the one before was left. How many
    scans of its run were within the radius gives its state. Nodes that were left
    leave the state with the bucket.
    """

    def __init__(self, bucket_ms: int = BUCKET_MS, ttl_ms: int | None = None):
        self.bucket_ms, self.ttl_ms = bucket_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket long, part int", "rows binary")
        self.parts = handle.getMapState("parts", "bucket long", "n int")
        self.count = handle.getValueState("count", "nth long, epoch long")
        self.nodes = handle.getMapState("nodes", "node_id string", "last long, epoch long, ins int", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            ends = (batch["ts"].astype("datetime64[ms]").astype("int64") // self.bucket_ms + 1) * self.bucket_ms
            for end, part in batch.groupby(ends):
                n = self.parts.getValue((int(end),))[0] if self.parts.containsKey((int(end),)) else 0
                self.waiting.updateValue((int(end), n), (pickle.dumps(part.drop(columns="session_id")),))
                self.parts.updateValue((int(end),), (n + 1,))
                self.handle.registerTimer(int(end))
        yield pd.DataFrame(columns=["session_id", "event_id", "node_id", "distance_km", "trigger_state", "user_mode"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs()
        parts = []
        for k in range(self.parts.getValue((end,))[0] if self.parts.containsKey((end,)) else 0):
            parts.append(pickle.loads(self.waiting.getValue((end, k))[0]))
            self.waiting.removeKey((end, k))
        if not parts:
            return
        self.parts.removeKey((end,))
        nth, epoch = self.count.get() if self.count.exists() else (0, 0)
        stored = {k[0]: tuple(v) for k, v in self.nodes.iterator()}
        states, out, event = dict(stored), [], None
        for r in pd.concat(parts).sort_values(["ts", "event_id", "node_id"], na_position="first").itertuples(index=False):
            if event != (r.ts, r.event_id):
                event = (r.ts, r.event_id)
                nth, epoch = nth + bool(r.placed), epoch + (r.is_reset is True)
            if not isinstance(r.node_id, str):
                continue
            last, of, ins = states.get(r.node_id, (0, 0, 0))
            ins = (ins if (last, of) == (nth - 1, epoch) else 0) + (r.distance_km <= r.radius_km)
            if not ins:
                states.pop(r.node_id, None)
                continue
            states[r.node_id] = (nth, epoch, min(ins, 2))
            out.append((key[0], r.event_id, r.node_id, round(r.distance_km, 2), "ENTERED" if ins == 1 else "INSIDE", "teleport" if r.is_teleport_mode is True else "normal"))
        self.count.update((nth, epoch))
        kept = {k: v for k, v in states.items() if v[:2] == (nth, epoch)}
        for k in stored.keys() - kept.keys():
            self.nodes.removeKey((k,))
        for k, v in kept.items():
            if stored.get(k) != v:
                self.nodes.updateValue((k,), v)
        yield pd.DataFrame(out, columns=["session_id", "event_id", "node_id", "distance_km", "trigger_state", "user_mode"])

    def close(self) -> None:
        pass


def geofence_stream(scans: DataFrame, nodes: DataFrame, buffer_km: float = BUFFER_KM, delay: str = "10 seconds", bucket_ms: int = BUCKET_MS, ttl_ms: int | None = None) -> DataFrame:
    """ENTERED and INSIDE rows of a stream of scans (session_id, event_id, ts, latitude,
    longitude, radius_km, is_teleport_mode, is_reset) held against static nodes, as
    operators.geofence.triggered() gives them for a table. Scans go by (ts, event_id);
    they may come `delay` late, and are answered once the watermark has passed their
    bucket. Scans without a time take no part. Needs the RocksDB state store."""
    timed = scans.where("ts is not null").withWatermark("ts", delay)
    near = with_near_nodes(timed, nodes, buffer_km)
    return near.groupBy("session_id").transformWithStateInPandas(Geofence(bucket_ms, ttl_ms), OUTPUT, "Append", "EventTime")
