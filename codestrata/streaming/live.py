"""Structured Streaming forms of the request reports and the rule scan."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.rulescan import rule_scan
from ..session import ensure_checkpoint_dir
from . import machines as M
from .requests import THROTTLE_LIMIT, THROTTLE_WINDOW_MS, answer_uses

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that the processors need, for queries that start and end inside the block."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class _Machine(StatefulProcessor):
    """Keeps one small list per key; a timer drops it when its life is over."""

    step = live = None
    life_ms = 0
    key_name = "key"
    extra: list[str] = []
    outputs: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cell = handle.getValueState("state", "items array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # a micro-batch brings the rows of a key in any order
        pdf = pd.concat(list(rows)).sort_values(["ts_ms", "request_id"])
        state = list(self.cell.get()[0]) if self.cell.exists() else []
        outs = []
        cols = [pdf[c].tolist() for c in self.extra]
        for i, t in enumerate(pdf["ts_ms"].tolist()):
            state, out = type(self).step(state, int(t), tuple(c[i] for c in cols))
            outs.append(out)
        self.cell.update((state,))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(int(pdf["ts_ms"].iloc[-1]) + self.life_ms + 1)
        res = pd.DataFrame({self.key_name: [key[0]] * len(pdf), "request_id": pdf["request_id"].tolist()})
        for j, n in enumerate(self.outputs):
            res[n] = [o[j] for o in outs]
        yield res

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.cell.clear()
        return iter([])

    def close(self) -> None:
        pass


class RateLimiter(_Machine):
    step, live, life_ms = M.rate_step, M.rate_live, M.RATE_WINDOW_MS
    key_name, outputs = "client", ["allowed", "remaining", "reset_seconds"]


class Deduplicator(_Machine):
    step, live, life_ms = M.dedup_step, M.dedup_live, M.DEDUP_TTL_MS
    key_name, outputs = "fingerprint_key", ["is_duplicate"]


class AnswerReuse(_Machine):
    step, live, life_ms = M.reuse_step, M.reuse_live, M.ANSWER_LIFE_MS
    key_name, extra, outputs = "answer_key", ["tokens", "nano"], ["hit", "saved_tokens", "saved_nano"]


class TrailingMinute(StatefulProcessor):
    """Answers each call once the watermark has passed it, so calls that arrive out of order are counted.

    A key is (agent, minute); it is given the calls of its own minute and of the one before. Both lists only
    grow by appends until a timer takes out what is decided; the last timer drops the key.
    """

    def __init__(self, limit: int, window_ms: int):
        self.limit, self.window_ms = limit, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "ts_ms bigint")
        self.waiting = handle.getListState("waiting", "ts_ms bigint, request_id bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            self.times.appendList([(t,) for t in pdf["ts_ms"].tolist()])
            own = pdf[pdf["own"]]
            if len(own):
                self.waiting.appendList(list(zip(own["ts_ms"].tolist(), own["request_id"].tolist())))
                self.handle.registerTimer(int(own["ts_ms"].min()) + 1)
        self.handle.registerTimer((int(key[1]) + 1) * self.window_ms)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, end = timerValues.getCurrentWatermarkInMs(), (int(key[1]) + 1) * self.window_ms
        waiting = sorted(self.waiting.get())
        due = [w for w in waiting if w[0] < now]
        if due:
            times = np.sort(np.array([t for (t,) in self.times.get()], np.int64))
            at = np.array([t for t, _ in due], np.int64)
            first = np.searchsorted(times, at - self.window_ms, "left")
            calls = np.searchsorted(times, at, "right") - first
            throttled = calls >= self.limit
            wait = np.where(throttled, np.maximum(0, self.window_ms - (at - times[first])), 0)
            yield pd.DataFrame({"request_id": [r for _, r in due], "agent": [key[0]] * len(due), "calls": calls, "is_throttled": throttled, "wait_ms": wait})
        if expiredTimerInfo.getExpiryTimeInMs() >= end:
            self.times.clear()
            self.waiting.clear()
        elif due:
            left = waiting[len(due):]
            if left:
                self.waiting.put(left)
                self.handle.registerTimer(left[0][0] + 1)
            else:
                self.waiting.clear()

    def close(self) -> None:
        pass


def _stateful(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str, delay: str) -> DataFrame:
    return stream.withWatermark("ts", delay).groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="EventTime")


def rate_limit_stream(requests: DataFrame, delay: str = "5 minutes") -> DataFrame:
    """Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``)."""
    return _stateful(requests, "client", RateLimiter(),
                     "client bigint, request_id bigint, allowed boolean, remaining int, reset_seconds int", delay)


def dedup_stream_exact(requests: DataFrame, delay: str = "5 minutes") -> DataFrame:
    return _stateful(requests, "fingerprint_key", Deduplicator(), "fingerprint_key string, request_id bigint, is_duplicate boolean", delay)


def reuse_stream(log: DataFrame, delay: str = "5 minutes") -> DataFrame:
    """Hits and savings of stored answers as requests arrive."""
    return _stateful(answer_uses(log, "ts"), "answer_key", AnswerReuse(),
                     "answer_key string, request_id bigint, hit boolean, saved_tokens bigint, saved_nano bigint", delay)


def dedup_stream(requests: DataFrame, ttl: str = "300 seconds") -> DataFrame:
    """Built-in form: drops repeats seen within the watermark delay."""
    return requests.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["fingerprint_key"])


def throttle_stream(calls: DataFrame, limit: int = 20, slide: str = "10 seconds") -> DataFrame:
    """Sliding minute counts per agent with the throttle flag."""
    w = F.window("ts", "60 seconds", slide)
    d = calls.withWatermark("ts", "1 minute").groupBy("agent", w).agg(F.count("*").alias("calls"))
    return d.select("agent", "window", "calls", (F.col("calls") >= limit).alias("is_throttled"))


def throttle_live(calls: DataFrame, delay: str = "1 minute", limit: int = THROTTLE_LIMIT, window_ms: int = THROTTLE_WINDOW_MS) -> DataFrame:
    """``throttle_status`` as calls arrive: the exact trailing minute of every call, given out once it is final.

    A call is final when the watermark (the latest time seen less ``delay``) has passed it. Calls may arrive
    in any order within ``delay``; later ones are dropped, as are calls without a time. State is kept by
    (agent, minute), so a busy agent is spread over minutes. Needs the RocksDB state store.
    """
    b = F.floor(F.col("ts_ms") / window_ms)
    d = calls.where("ts_ms is not null").withWatermark("ts", delay).withColumn("home", b)
    d = d.select("ts", "request_id", "agent", "ts_ms", "home", F.explode(F.array("home", F.col("home") + 1)).alias("bucket"))
    d = d.withColumn("own", F.col("bucket") == F.col("home")).drop("home")
    return d.groupBy("agent", "bucket").transformWithStateInPandas(
        statefulProcessor=TrailingMinute(limit, window_ms), outputStructType="request_id bigint, agent string, calls bigint, is_throttled boolean, wait_ms bigint",
        outputMode="append", timeMode="EventTime")


def reuse_sessions_stream(log: DataFrame, idle: str = "30 minutes") -> DataFrame:
    d = log.withWatermark("ts", idle).groupBy("fingerprint_key", F.session_window("ts", idle)).agg(F.count("*").alias("uses"))
    return d.select("fingerprint_key", "session_window", "uses", (F.col("uses") - 1).alias("hits"))


def stream_rule_scan(files: DataFrame, rules=None) -> DataFrame:
    """Rules are literals of the plan, so an arriving file needs no join and no state."""
    return rule_scan(files, rules)


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process what is there, then read the result table back."""
    spark: SparkSession = stream.sparkSession
    root = os.path.join(ensure_checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")
    q = (stream.writeStream.outputMode(mode).format("parquet").option("path", f"{root}/out")
         .option("checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")
