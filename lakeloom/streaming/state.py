"""Keyed state that ends: running totals of customers in a processor with timers of event time."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

DAY_MS, HOUR_US = 86_400_000, 3_600_000_000
TOTALS_ROW = "order_id string, customer_id string, order_count long, gmv double, hour_count long"
TOTALS_STATE = "timer_ms long, customer_id array<string>, order_count array<long>, gmv_cents array<long>, last_micros array<long>, recent array<array<long>>"


class RunningTotals(StatefulProcessor):
    """For each order the customer's orders and GMV since their last absence, and their orders of the last hour.

    A group holds many customers, so that a batch reads and writes its state once and not once a customer. Its state ``totals`` holds by customer the
    count, cents, time of the last order and the times of the last hour's orders. By the clock of events an absence of more than
    ttl_ms ends them: a timer, of the group's first end, drops those whose end the watermark has passed, and an order
    that comes after a longer gap starts anew, so results don't depend on how batches were cut. By the machine's clock
    the store itself ends a group, ttl_ms after it was last written, as it takes no time to live by that of events; groups are single customers then.
    """

    def __init__(self, ttl_ms: int = DAY_MS, by_events: bool = True) -> None:
        self.ttl_ms, self.by_events = ttl_ms, by_events

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", TOTALS_STATE, None if self.by_events else self.ttl_ms)

    def known(self) -> tuple[int, dict[str, list]]:
        """The time of the group's timer, 0 if it has none, and by customer the count, cents, last time and times of the last hour."""
        if not self.totals.exists():
            return 0, {}
        timer, names, *columns = self.totals.get()
        return timer, dict(zip(names, zip(*columns)))

    def keep(self, timer: int, of: dict[str, tuple]) -> None:
        """Writes the group's state. A timer that is too early stays, and finds out when it is due."""
        if not of:
            self.totals.clear()
            return
        if self.by_events:
            due = min(last for _, _, last, _ in of.values()) // 1000 + self.ttl_ms
            if timer and due < timer:
                self.handle.deleteTimer(timer)
            if not timer or due < timer:
                self.handle.registerTimer(timer := due)
        counts, cents, lasts, recents = zip(*of.values())
        self.totals.update((timer, list(of), list(counts), list(cents), list(lasts), list(recents)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["customer_id", "micros", "order_id"], kind="stable")
        names, micros = new["customer_id"].to_numpy(), new["micros"].to_numpy()
        cents = (new["price"].fillna(0) * 100).round().to_numpy().astype("int64")
        first = np.append(True, names[1:] != names[:-1])
        at = np.flatnonzero(first)
        ends = np.append(at[1:], len(names))
        timer, of = self.known()
        before = [of.get(names[k], (0, 0, int(micros[k]), [])) for k in at]
        count0, cents0, last0 = (np.repeat([b[k] for b in before], ends - at) for k in range(3))
        last = np.where(first, last0, np.maximum(last0, np.append(0, micros[:-1])))
        anew = (micros - last > self.ttl_ms * 1000) & self.by_events
        rows_ = np.arange(len(names))
        start = np.maximum.accumulate(np.where(first | anew, rows_, 0))  # where a row's stretch without an absence begins in this batch
        goes_on = first[start] & ~anew[start]
        total = np.cumsum(cents)
        counts = rows_ - start + 1 + goes_on * count0
        sums = total - total[start] + cents[start] + goes_on * cents0
        in_hour = np.zeros(len(names), dtype=np.int64)
        for (_, _, newest, recent), a, b in zip(before, at.tolist(), ends.tolist()):
            times = np.sort(np.concatenate([np.array(recent, dtype=np.int64), micros[a:b]])) if len(recent) else micros[a:b]
            in_hour[a:b] = times.searchsorted(micros[a:b], "right") - times.searchsorted(micros[a:b] - HOUR_US, "left")
            newest = max(newest, int(micros[b - 1]))
            of[names[a]] = int(counts[b - 1]), int(sums[b - 1]), newest, times[times.searchsorted(newest - HOUR_US) :].tolist()
        self.keep(timer, of)
        yield pd.DataFrame({"order_id": new["order_id"].to_numpy(), "customer_id": names, "order_count": counts, "gmv": sums / 100, "hour_count": in_hour})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        _, of = self.known()
        self.keep(0, {name: x for name, x in of.items() if x[2] // 1000 + self.ttl_ms > passed})
        yield pd.DataFrame({"order_id": [], "customer_id": [], "order_count": [], "gmv": [], "hour_count": []}).astype({"order_id": str, "customer_id": str, "order_count": "int64", "gmv": float, "hour_count": "int64"})

    def close(self) -> None:
        pass


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, as processors with timers ask for."""
    key, wanted = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key, None)
    spark.conf.set(key, wanted)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def running_totals(orders: DataFrame, delay: str = "5 seconds", ttl_ms: int = DAY_MS, by_events: bool = True, buckets: int = 1024) -> DataFrame:
    """A stream of orders with ``RunningTotals``; start it inside ``rocksdb``. Orders without a time or a customer have no totals.

    buckets: into how many groups customers are put; one batch's orders of a group are sorted in memory, so more of them suit larger batches. By the machine's clock
    a group is a customer, and there is always another batch to come, so such a query ends when it is stopped, or by a trigger of one batch.
    """
    timed = orders.filter("event_time IS NOT NULL AND customer_id IS NOT NULL")
    timed = timed.withWatermark("event_time", delay) if by_events else timed
    group = F.pmod(F.xxhash64("customer_id"), F.lit(buckets)).cast("string") if by_events else F.col("customer_id")
    rows = timed.select(group.alias("bucket"), "order_id", "customer_id", "price", "event_time", F.unix_micros("event_time").alias("micros"))
    return rows.groupBy("bucket").transformWithStateInPandas(RunningTotals(ttl_ms, by_events), TOTALS_ROW, "append", "eventTime" if by_events else "processingTime")


def state_left(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What a stopped query's store holds: key (customer_id) and value (order_count, gmv_cents, last_micros)."""
    groups = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "totals").load()
    values = ["order_count", "gmv_cents", "last_micros"]
    each = groups.select(F.explode(F.arrays_zip("value.customer_id", *(f"value.{c}" for c in values))).alias("x"))
    return each.select(F.struct("x.customer_id").alias("key"), F.struct(*(f"x.{c}" for c in values)).alias("value"))
