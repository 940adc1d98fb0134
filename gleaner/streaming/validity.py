"""Validation of a stream of secrets, each request asked once for as long as its answer holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from gleaner.operators.validate import TTL_SECONDS

#: State of this kind is kept in RocksDB, on disk and in changelogs, not on the heap.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Validity(StatefulProcessor):
    """Of one request key the time it was last asked, until that answer has run out."""

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl * 1_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - the interface's names
        parts, request = [], None
        for part in rows:
            # of all rows of a batch only their times are held
            parts.append(part["at"].to_numpy(np.int64))
            known = part["request"].dropna()
            request = min([*known, *([request] if request is not None else [])], default=None)
        last = self.last.get()[0] if self.last.exists() else None
        asked, times = [], np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
        at = 0
        while at < len(times):
            if last is not None:
                # what comes before the answer has run out is answered by it, late rows included
                at = max(at, int(np.searchsorted(times, last + self.ttl, side="left")))
                if at >= len(times):
                    break
            last = int(times[at])
            asked.append(last)
            at += 1
        if asked:
            self.last.update((last,))
            self.handle.registerTimer((last + self.ttl) // 1000 + 1)
            yield pd.DataFrame({"request_key": key[0], "request": request, "asked_at": asked})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """The watermark has passed a time at which an answer ran out: unless it was asked anew since, nothing is kept."""
        if self.last.exists() and (self.last.get()[0] + self.ttl) // 1000 + 1 <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def asks(requests: DataFrame, time: str, ttl: int = TTL_SECONDS, lateness: str = "1 hour") -> DataFrame:
    """(request_key, request, asked_at): when each request of a stream has to be sent.

    ``requests`` is a stream with request_key, request and an event time.  The first sighting of a key is asked; others within ``ttl``
    seconds from then are answered by it, and the first one after that is asked anew.  State is one time for each key that was asked within the last ``ttl`` and ``lateness``;
    event-time timers remove it.  Rows later than the watermark are dropped; rows without a key or a time are not asked.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rows = requests.where(F.col("request_key").isNotNull() & F.col(time).isNotNull()).withWatermark(time, lateness)
    rows = rows.select("request_key", "request", F.unix_micros(F.col(time).cast("timestamp")).alias("at"), F.col(time))
    told = rows.groupBy("request_key").transformWithStateInPandas(
        _Validity(ttl), "request_key string, request string, asked_at long", "Append", "EventTime"
    )
    return told.withColumn("asked_at", F.timestamp_micros("asked_at"))


def send_stream(asked: DataFrame, transport, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Sends what ``asks`` tells through ``transport`` and appends the answers (request_key, asked_at, status, headers, body) as Parquet.

    A batch is written under its number, so one that is run again replaces itself.
    """
    from gleaner.operators import validate

    def write(batch: DataFrame, number: int) -> None:
        answers = validate.send(batch, transport)
        batch.select("request_key", "asked_at").join(answers, "request_key").write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = asked.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
