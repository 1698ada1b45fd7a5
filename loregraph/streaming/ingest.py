"""Streaming operators: validation, windowed deduplication, rate limit and daily counters over ingestion events."""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loregraph.session import ensure_checkpoint_dir

DEDUP_HOURS = 24


def split_valid(events: DataFrame, required: tuple[str, ...] = ("event_id", "ts", "event_type")) -> tuple[DataFrame, DataFrame]:
    """(well-formed, malformed) events; the second belongs into a quarantine sink."""
    ok = F.lit(True)
    for c in required:
        ok = ok & F.col(c).isNotNull()
    return events.filter(ok), events.filter(~ok)


def dedup_sliding(events: DataFrame, keys: list[str], stamp: str = "ts", hours: int = DEDUP_HOURS) -> DataFrame:
    """Events whose key was not seen within ``hours`` before them; a suppressed event renews the time, so that a steady stream of copies stays suppressed.

    State is one timestamp per key, dropped when it is ``hours`` behind the watermark. Within a batch the events of a key are taken in time order. The events
    must carry a watermark on ``stamp``. Returns the columns of ``events`` that are kept.
    """
    schema = events.schema
    span = pd.Timedelta(hours=hours)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        rows = pd.concat(list(batches)).sort_values(stamp)
        keep = []
        for t in rows[stamp]:
            keep.append(seen is None or t - seen >= span)
            seen = t if seen is None else max(seen, t)
        state.update((int(seen.value // 1000),))
        state.setTimeoutTimestamp(max(int((seen + span).value // 1_000_000), state.getCurrentWatermarkMs() + 1))
        yield rows[keep]

    return events.groupBy(*keys).applyInPandasWithState(run, schema, "seen long", "append", GroupStateTimeout.EventTimeTimeout)


def rate_limited(events: DataFrame, by: str, capacity: int, seconds: float = 60, stamp: str = "ts") -> DataFrame:
    """The events of each key that fewer than ``capacity`` accepted ones precede within ``seconds``; the others are dropped. State is the times of the last accepted events.

    As for ``dedup_sliding``, the events of a key are taken in time order within a batch and must carry a watermark; batches are as large as the source's limit on files.
    """
    schema = events.schema
    span = pd.Timedelta(seconds=seconds)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = deque((pd.Timestamp(t, unit="us") for t in state.get[0]) if state.exists else (), maxlen=capacity)
        rows = pd.concat(list(batches)).sort_values(stamp, kind="stable")
        keep = []
        for t in rows[stamp]:
            keep.append(len(last) < capacity or t - last[0] >= span)
            if keep[-1]:
                last.append(t)
        state.update(([int(t.value // 1000) for t in last],))
        state.setTimeoutTimestamp(max(int((last[-1] + span).value // 1_000_000), state.getCurrentWatermarkMs() + 1))
        yield rows[keep]

    return events.groupBy(by).applyInPandasWithState(run, schema, "last array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def trickle_only(events: DataFrame, keys: list[str], mode: str = "mode", stamp: str = "ts", hours: int = DEDUP_HOURS) -> tuple[DataFrame, DataFrame]:
    """(trickle without copies, bulk as it is): bulk deliveries are never suppressed."""
    return dedup_sliding(events.filter(~F.col(mode).eqNullSafe("bulk")), keys, stamp, hours), events.filter(F.col(mode) == "bulk")


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, one file or a folder of files, as a stream of its files."""
    files = spark.read.parquet(path)
    folder, _, name = files.inputFiles()[0].rpartition("/")
    return spark.readStream.schema(files.schema).option("pathGlobFilter", name if path.rstrip("/").endswith(name) else "*.parquet").parquet(folder)


def drained(df: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives for what is there now, written to and read from a folder of the session's shared one."""
    spark = df.sparkSession
    at = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        drain(df, f"{at}/out", f"{at}/ckpt")
        return spark.read.schema(df.schema).parquet(f"{at}/out")

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out")

    df.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/ckpt").foreachBatch(replace).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out")


def daily_counters(events: DataFrame, *by: str, stamp: str = "ts") -> DataFrame:
    """Events per key and day; with a watermark late events update their day until it closes."""
    return events.groupBy(*by, F.window(stamp, "1 day").alias("w")).agg(F.count("*").alias("n")).select(*by, F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n")


def drain(df: DataFrame, sink_dir: str, checkpoint_dir: str, mode: str = "append") -> None:
    """Process what is there and stop; a second call goes on where the first ended."""
    df.writeStream.format("parquet").outputMode(mode).option("path", sink_dir).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start().awaitTermination()
