"""Structured Streaming twins: detections as they arrive, sessions over several tools, beacons."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from loglattice.events import derive
from loglattice.operators.correlate import family_key
from loglattice.schema import RAW


def read_json(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Raw events in JSON lines of the event schema, as they land in a folder, derived."""
    return derive(spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_per_batch).json(folder))


def episodes(stream: DataFrame, key: str = "host_canon", gap: str = "120 seconds", late: str = "10 minutes", min_sources: int = 2) -> DataFrame:
    """Sessions of activity around one ``key`` (a host by default) that several families saw.

    A session ends after ``gap`` without events.  Streams sessionise by a key, so state is spread
    over tasks; the number of families is a sketch's estimate, exact for the few there are.
    """
    timed = stream.filter(F.col("ts_parsed").isNotNull() & F.col(key).isNotNull()).withWatermark("ts_parsed", late)
    agg = timed.groupBy(F.session_window("ts_parsed", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("events"), F.approx_count_distinct(family_key(), 0.01).alias("families"), F.max("kc_order").alias("depth"))
    return agg.filter(F.col("families") >= min_sources).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "events", "families", "depth")


def host_activity(stream: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events and ATT&CK evidence per host and window of time."""
    timed = stream.filter("ts_parsed is not null and host_canon is not null").withWatermark("ts_parsed", late)
    agg = timed.groupBy(F.window("ts_parsed", window).alias("w"), "host_canon").agg(F.count(F.lit(1)).alias("events"), F.count_if("attack_evidence").alias("attack_events"))
    return agg.select(F.col("w.start").alias("start"), "host_canon", "events", "attack_events")


FLOW = ("host", "src_ip", "dst_ip", "dst_port")
BEACON_SCHEMA = "host string, src_ip string, dst_ip string, dst_port int, connections bigint, last timestamp, mean_interval_s double, jitter double, regular boolean"


class _Beacons(StatefulProcessor):
    """Of each flow: connections that the watermark has not passed, those that it has, and the running gaps between these.

    A connection's start is only certain once the watermark has passed it, as an earlier segment
    may still come; a timer tells, and starts are then taken in order, so the result does not
    depend on the order in which events arrive.
    """

    def __init__(self, min_events: int, max_jitter: float, idle_ms: int):
        self.min_events, self.max_jitter, self.idle_ms = min_events, max_jitter, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "port string", "micros bigint")
        self.known = handle.getMapState("known", "port string", "micros bigint")
        self.gaps = handle.getValueState("gaps", "n bigint, last bigint, mean double, m2 double")

    @staticmethod
    def _timer(micros: int) -> int:
        """The millisecond at which a start is certain: the first one wholly after it."""
        return micros // 1000 + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        earliest: dict[str, int] = {}
        for r in rows:
            port = str(r["src_port"]) if r["src_port"] is not None else f"id {r['id']}"
            earliest[port] = min(r["micros"], earliest.get(port, r["micros"]))
        for port, at in earliest.items():
            if self.known.containsKey((port,)):
                continue  # a further segment of a connection that has been counted
            if not self.pending.containsKey((port,)) or at < self.pending.getValue((port,))[0]:
                self.pending.updateValue((port,), (at,))
                self.handle.registerTimer(self._timer(at))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted((v[0], k[0]) for k, v in self.pending.iterator() if self._timer(v[0]) <= now)
        n, last, mean, m2 = self.gaps.get() if self.gaps.exists() else (0, None, 0.0, 0.0)
        for at, port in due:
            self.pending.removeKey((port,))
            self.known.updateValue((port,), (at,))
            if last is not None:
                gap = (at - last) / 1e6
                n += 1
                step = gap - mean
                mean += step / n
                m2 += step * (gap - mean)
            last = at
        if due:
            self.gaps.update((n, last, mean, m2))
            self.handle.registerTimer(self._timer(last) + self.idle_ms)
            if n:
                sd = math.sqrt(m2 / (n - 1)) if n > 1 else 0.0
                jitter = sd / mean if mean > 0 else None
                regular = n + 1 >= self.min_events and jitter is not None and jitter <= self.max_jitter
                yield Row(**dict(zip(FLOW, key, strict=True)), connections=n + 1, last=last, mean_interval_s=round(mean, 2), jitter=None if jitter is None else round(jitter, 3), regular=regular)
        elif last is not None and now >= self._timer(last) + self.idle_ms and not any(True for _ in self.pending.iterator()):
            for state in (self.pending, self.known, self.gaps):
                state.clear()


def beacons(stream: DataFrame, min_events: int = 4, max_jitter: float = 0.25, late: str = "10 minutes", idle_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """A row for each flow and step of the watermark that settles connections of it, with its call-backs so far.

    The last row of a flow is what ``recipes.beaconing`` says of the same events, whatever order
    they came in within the watermark; ``regular`` tells whether it is a beacon.  Segments of one
    source port are one connection, and events without one stand alone.  A flow without new
    connections for ``idle_ms`` of event time is forgotten, so state does not grow for ever.  The
    session needs the RocksDB state store (``state_store``).
    """
    timed = stream.filter("dst_ip is not null and ts_parsed is not null").withWatermark("ts_parsed", late)
    rows = timed.select(*FLOW, "src_port", "id", F.unix_micros("ts_parsed").alias("micros"), "ts_parsed")
    output = BEACON_SCHEMA.replace("last timestamp", "last bigint")
    found = rows.groupBy(*FLOW).transformWithState(_Beacons(min_events, max_jitter, idle_ms), output, "Append", "EventTime")
    return found.withColumn("last", F.timestamp_micros("last"))


def state_store(spark: SparkSession) -> None:
    """Keep streams' state in RocksDB, which timers and maps need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def write(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Start writing to Parquet; ``checkpoint`` is on shared storage."""
    return stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).start(path)
