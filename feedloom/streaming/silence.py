"""Silence as a stream: each post flagged once its place among its source's posts is certain."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state(spark: SparkSession) -> None:
    """State of processors lives in RocksDB; set for the session, as a query takes it when it starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Silence(StatefulProcessor):
    """Of a source: the time of its last post, and posts that an earlier one may still come before.

    Times are microseconds.  One timer is set, for the earliest post held; when
    the watermark passes it, all posts it has passed are flagged in order.
    ``start`` stands for the last post of a source that never posted; after
    ``horizon`` without a post a source is one that never did.
    """

    def __init__(self, gap: int, start: int | None, horizon: int | None, columns: list[str]):
        self.gap, self.start, self.horizon, self.columns = gap, start, horizon, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t bigint")
        self.held = handle.getListState("held", "t bigint, id string")

    def _wake(self, micros: int) -> None:
        self.handle.registerTimer(micros // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # One call of the store a batch of a source's rows, not some a row.
        new = [at for frame in rows for at in zip(frame["micros"].tolist(), frame["post"].tolist())]
        if new:
            self.held.appendList(new)
            self._wake(min(new)[0])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(at) for at in self.held.get()] if self.held.exists() else []
        ready, rest = sorted(at for at in held if at[0] <= passed), [at for at in held if at[0] > passed]
        left = min(rest)[0] if rest else None
        if ready and rest:
            self.held.put(rest)
        elif ready:
            self.held.clear()
        last = self.last.get()[0] if self.last.exists() else None
        out, before = [], last
        for t, post in ready:
            if last is not None and t > last:
                before = last
            elif last is None:
                before = None
            since = before if before is not None else self.start
            out.append((key[0], post, t, since is not None and t > since + self.gap))
            last = t
        if last is not None:
            if self.horizon is not None and left is None and last + self.horizon <= passed:
                self.last.clear()
            else:
                self.last.update((last,))
                if left is not None:
                    self._wake(left)
                elif self.horizon is not None:
                    self._wake(last + self.horizon)
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def silence_stream(posts: DataFrame, source: str, ts: str, key: str, gap: str, lateness: str, start: str | None = None, horizon: str | None = None) -> DataFrame:
    """``source``, ``key`` (as text), ``ts`` and ``after_silence`` of a stream of posts, as ``posts.silence`` flags them all at once.

    A post is out when the watermark (``lateness`` behind the latest time seen) has passed it, so rows that come late
    change what follows; rows that come later than that are dropped.  Posts without a time or source never come out.
    Rows that repeat are flagged alike.  ``gap``, ``lateness`` and ``horizon`` are intervals, ``start`` a time.
    """
    spark = posts.sparkSession
    keep_state(spark)
    micros = lambda i: int(pd.Timedelta(i) / pd.Timedelta(microseconds=1)) if i else None
    begun = int(pd.Timestamp(start, tz=spark.conf.get("spark.sql.session.timeZone")).timestamp() * 1_000_000) if start else None
    own = posts.where(F.col(source).isNotNull() & F.col(ts).isNotNull()).select(F.col(source).alias("who"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("post"), F.col(ts).cast("timestamp").alias("at"))
    timed = own.withColumn("micros", F.unix_micros("at")).withWatermark("at", lateness)
    names = ["who", "post", "micros", "after_silence"]
    schema = f"who {dict(posts.dtypes)[source]}, post string, micros bigint, after_silence boolean"
    flagged = timed.groupBy("who").transformWithStateInPandas(Silence(micros(gap), begun, micros(horizon), names), schema, "append", "eventTime")
    return flagged.select(F.col("who").alias(source), F.col("post").alias(key), F.timestamp_micros("micros").alias(ts), "after_silence")
