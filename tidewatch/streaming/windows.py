"""The trailing windows over a stream, with the same features as the batch.

A group's events of one micro-batch are ordered by time and id, seen together with those the state still holds, and
computed by the batch definition on plain numbers. State holds what the window can still reach. Events earlier than what
a group has emitted are late: they are dropped, or raise in strict mode. State expires by event time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..operators.windows import GROUP, NO_VARIANCE, WINDOW_FEATURES, WINDOW_INPUT, window_us

_STATE = StructType(
    [StructField("us", LongType()), StructField("event_id", StringType())]
    + [StructField(c, StringType()) for c in ("query", "subdomain", "dst_ip", "qtype_cat")]
    + [StructField(c, DoubleType()) for c in ("query_length", "query_entropy", "subdomain_length", "digit_ratio", "is_nxdomain", "num_answers", "ttl_mean")]
)
_FIELDS = [f.name for f in _STATE.fields]


def _number(x) -> float | None:
    return None if x is None or x != x else float(x)


def trailing_features(window: list[tuple], seconds: float) -> list[float | None]:
    """The 21 features of the last event of ``window``, its members in order."""
    n = len(window)
    us = [m[0] for m in window]
    column = lambda k: [m[_FIELDS.index(k)] for m in window]
    lengths = [int(x) for x in column("query_length")]
    entropies = column("query_entropy")
    mean = lambda xs: math.fsum(xs) / n
    defined = lambda xs: (lambda ys: math.fsum(ys) / len(ys) if ys else None)([x for x in xs if x is not None])
    length_sum, length_squares = sum(lengths), sum(x * x for x in lengths)
    spread = math.fsum(x * x for x in entropies) / n - mean(entropies) ** 2
    gaps = [b - a for a, b in zip(us, us[1:], strict=False)]
    m = len(gaps)
    queries, subs = len(set(column("query"))), len({x for x in column("subdomain") if x})
    nx = sum(int(x) for x in column("is_nxdomain"))
    return [
        float(n), n / seconds, float(queries), queries / n, float(subs), subs / n, length_sum / n,
        math.sqrt(length_squares * n - length_sum * length_sum) / n if n > 1 else 0.0, float(max(lengths)), mean(entropies),
        math.sqrt(spread) if n > 1 and spread > NO_VARIANCE else 0.0, mean(column("subdomain_length")), mean(column("digit_ratio")), float(nx), nx / n,
        float(len(set(column("qtype_cat")))), float(len({x for x in column("dst_ip") if x is not None})), defined(column("num_answers")), defined(column("ttl_mean")),
        sum(gaps) / m / 1e6 if m else seconds, math.sqrt(sum(g * g for g in gaps) * m - sum(gaps) ** 2) / m / 1e6 if m > 1 else 0.0,
    ]


class WindowProcessor(StatefulProcessor):
    """Holds each group's reachable events and the last one emitted."""

    def __init__(self, seconds: float, strict: bool = False):
        self.seconds, self.us, self.strict = float(seconds), window_us(seconds), strict

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.events.get()] if self.events.exists() else []
        floor = (held[-1][0], held[-1][1]) if held else None
        new = []
        for pdf in rows:
            for r in pdf.to_dict("records"):
                us = int(round(r["timestamp"] * 1e6)) if r["timestamp"] is not None else 0
                text = [None if r[c] is None or r[c] != r[c] else str(r[c]) for c in ("query", "subdomain", "dst_ip", "qtype_cat")]
                new.append((us, str(r["event_id"]), *text, *[_number(r[c]) for c in _FIELDS[6:]]))
        new.sort(key=lambda m: (m[0], m[1]))
        late = [m for m in new if floor and (m[0], m[1]) < floor]
        if late and self.strict:
            raise ValueError(f"group {key}: {len(late)} events are earlier than what has been emitted")
        window, out = held, []
        for m in new[len(late) :]:
            window = [w for w in window if w[0] > m[0] - self.us] + [m]
            out.append([m[1], m[0] / 1e6, *key, *trailing_features(window, self.seconds)])
        if out:
            self.events.put(window)
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            self.handle.registerTimer((window[-1][0] + self.us) // 1000 + 1)
        yield pd.DataFrame(out, columns=["event_id", "timestamp", *GROUP, *WINDOW_FEATURES])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.events.clear()
        return iter([])

    def close(self) -> None:
        pass


OUTPUT = StructType(
    [StructField("event_id", StringType()), StructField("timestamp", DoubleType()), StructField("src_ip", StringType()), StructField("sld", StringType())]
    + [StructField(c, DoubleType()) for c in WINDOW_FEATURES]
)


def stream_window_features(events: DataFrame, seconds: float, delay: str = "10 seconds", strict: bool = False) -> DataFrame:
    """Window features of a stream of events with the columns ``WINDOW_INPUT``; append mode, RocksDB state store.

    ``delay`` bounds how much later than others an event may come before its group's state goes.
    """
    timed = events.select(*WINDOW_INPUT).withColumn("_time", F.timestamp_micros(F.rint(F.col("timestamp") * 1e6).cast("long"))).withWatermark("_time", delay)
    return timed.groupBy(*GROUP).transformWithStateInPandas(WindowProcessor(seconds, strict), OUTPUT, "Append", "EventTime")


def live_groups(spark, checkpoint: str) -> DataFrame:
    """Groups that a query's state holds, with the number of events, from its checkpoint."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "events").load()
    return state.groupBy("key").count()
