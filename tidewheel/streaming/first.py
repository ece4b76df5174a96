"""The first row of each key of a stream, in the order of its source."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Times and dates of a row on its way through the state, to the last digit.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "dateFormat": "yyyy-MM-dd"}
#: The store that keyed state with timers needs; streams that a checkpoint continues keep the one they began with.
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _First(StatefulProcessor):
    """State of a key is the time until which none of its rows passes."""

    def __init__(self, held_ms: int) -> None:
        self.held_ms = held_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        now, best = 0, None
        for r in rows:
            now, found = r["_came_ms"], (r["_place"], r["_row"])
            best = found if best is None else min(best, found)
        held = self.until.get()
        if held is None or held[0] <= now:
            self.until.update((now + self.held_ms,))
            self.handle.registerTimer(now + self.held_ms)
            yield Row(_row=best[1])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:  # noqa: N802, N803
        held = self.until.get()
        if held is not None and held[0] <= expiredTimerInfo.getExpiryTimeInMs():  # a row may have passed since
            self.until.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_in_order(rows: DataFrame, key: str, order: str, keep: str) -> DataFrame:
    """Of the rows of a key that come in one batch the one of the smallest ``order`` passes, and then none for ``keep`` (such as
    ``7 days``) after that batch came.

    So batches that come in source order give what one batch over all rows gives. State holds a key and a time, and a timer
    removes it once a batch has come later than that; the time of a batch stays the same when it is repeated. The rows of a key are looked
    at one by one. Rows without a key or an ``order`` do not pass. Of rows of one ``order`` the first by their JSON text passes.
    The session's state store becomes RocksDB, for streams that start from now on.
    """
    held_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    whole = rows.schema
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    dealt = rows.filter(F.col(key).isNotNull() & F.col(order).isNotNull()).select(
        F.col(key).cast("string").alias("_key"), F.col(order).cast("bigint").alias("_place"), F.to_json(F.struct("*"), _JSON).alias("_row"),
        F.current_timestamp().alias("_came")).withWatermark("_came", "1 second").withColumn("_came_ms", F.unix_millis("_came"))
    passed = dealt.groupBy("_key").transformWithState(_First(held_ms), "_row string", "append", "EventTime")
    return passed.select(F.from_json("_row", whole, _JSON).alias("_row")).select("_row.*")
