"""Ingest with state by offer: Spark keeps what is known of each url, and timers wake those that failed.

The state holds an offer's price, stock, times and link, and its failures. An event changes
the state of its own url only, so a batch costs what it brings, not what is known. A
failure sets a timer; when the wait is over and the offer hasn't failed too often, it is due.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from offerlake.plans.buckets import BucketTable

#: An event: `kind` is seen (a scan found the offer), linked or failed (a search for its product ended).
EVENT = "url string, kind string, price_value double, stock_status string, first_seen timestamp, product_url string, reason string, at timestamp"
_OFFER = "price_value double, stock_status string, first_seen timestamp, last_seen timestamp, product_url string"
STATE = f"url string, {_OFFER}, attempts int, reason string"
#: What comes out: the state after the event, and `change`: new, restock, seen, linked, failed or due.
OUTPUT = f"{STATE}, change string, at timestamp"
#: Failures after which an offer isn't tried again, and the days it waits. Fixed values.
ATTEMPTS, DAYS = 3, 3

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _out(stock: str | None) -> bool:
    return any(word in (stock or "").lower() for word in ("sold", "out"))


def _given(value):
    return None if pd.isna(value) else value


class OfferState(StatefulProcessor):
    """Folds the events of a url, in order of time, into its state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.offer = handle.getValueState("offer", _OFFER)
        self.failures = handle.getValueState("failures", "attempts int, reason string")

    def _row(self, key, change: str, at) -> tuple:
        offer = self.offer.get() if self.offer.exists() else (None,) * 5
        failures = self.failures.get() if self.failures.exists() else (0, None)
        return (*key, *offer, *failures, change, at)

    def _seen(self, event) -> str:
        old = self.offer.get() if self.offer.exists() else None
        known = old is not None and old[3] is not None
        first, stock, at = _given(event.first_seen), _given(event.stock_status), event.at
        restock = known and _out(old[1]) and not _out(stock)
        if first is None:
            first = at if restock or not known else old[2]
        link = old[4] if old is not None and old[4] is not None else _given(event.product_url)
        self.offer.update((_given(event.price_value), stock, first, at, link))
        return "restock" if restock else "seen" if known else "new"

    def _linked(self, event) -> str:
        old = self.offer.get() if self.offer.exists() else (None,) * 5
        self.offer.update((*old[:4], _given(event.product_url)))
        self.failures.clear()
        self._forget_timers()
        return "linked"

    def _failed(self, event) -> str:
        had = self.failures.get()[0] if self.failures.exists() else 0
        self.failures.update((had + 1, _given(event.reason)))
        self._forget_timers()
        if had + 1 < ATTEMPTS:
            self.handle.registerTimer(int((event.at + timedelta(days=DAYS)).timestamp() * 1000))
        return "failed"

    def _forget_timers(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["at", "kind"], kind="stable")  # the events of one offer in one batch
        ways = {"seen": self._seen, "linked": self._linked, "failed": self._failed}
        out = [self._row(key, ways[event.kind](event), event.at) for event in events.itertuples() if event.kind in ways]
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        yield _frame([self._row(key, "due", at)])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [part.split()[0] for part in OUTPUT.split(", ")]
    frame = pd.DataFrame(rows, columns=names)
    for name in ("first_seen", "last_seen", "at"):
        frame[name] = pd.to_datetime(frame[name])
    return frame.astype({"price_value": "float64", "attempts": "int32"})


def changes(events: DataFrame, late: str = "1 day") -> DataFrame:
    """A stream of events (`EVENT`) as a stream of changes (`OUTPUT`).

    Events of a batch count in order of time; events with a null url or time or of another kind are left
    out. Spark drops events that come more than `late` behind the latest of earlier batches, so `late` has to cover what
    scans of several shops may lag; timers ring as much later. A first sight is the shop's date, else the event's time for new and restocked offers, else what
    it was; a link stays until another event links. A due offer comes with the first batch
    whose predecessors' times are past its wait.
    """
    sound = events.where("url IS NOT NULL AND at IS NOT NULL").withWatermark("at", late)
    return sound.groupBy("url").transformWithStateInPandas(OfferState(), outputStructType=OUTPUT, outputMode="Update", timeMode="EventTime")


def start(
    spark: SparkSession, incoming: str, table: BucketTable, checkpoint: str, after: Callable[[DataFrame, int], None] | None = None, late: str = "1 day"
) -> StreamingQuery:
    """Fold new Parquet files of `incoming` (`EVENT`) into a table of states (`STATE`), one file a batch.

    A batch rewrites the buckets of its urls only, and a batch that is run again after a
    failure writes nothing twice. `after` gets the batch's changes and its number, for what has to follow: a
    refreshed view, a queue of due offers. The session's state store has to be RocksDB, which is set where none was chosen.
    """
    if spark.conf.get(_STORE) != _ROCKS:
        spark.conf.set(_STORE, _ROCKS)

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            last = F.max_by(F.struct(*[c for c in batch.columns]), F.struct("at", F.col("change") != "due", "attempts"))
            table.upsert(batch.groupBy("url").agg(last.alias("s")).select("s.*"), number)
            table.vacuum(spark)
            if after is not None:
                after(batch, number)
        finally:
            batch.unpersist()

    stream = changes(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(incoming), late)
    return stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
