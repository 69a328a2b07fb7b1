"""Event logs as streams: counters, last events, and a timer for silent runs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from narrata import schemas
from narrata.operators import runs
from narrata.session import shared_dir


def stream(spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int = 1000) -> DataFrame:
    """A log folder as a stream; every part file is read once."""
    return spark.readStream.format(fmt).schema(schemas.EVENT_ROW).option("maxFilesPerTrigger", files_per_trigger).load(path)


def live_counters(events: DataFrame, keys: list[str], kinds: dict[str, str]) -> DataFrame:
    """The batch counters over a stream (``update`` or ``complete`` mode)."""
    return runs.counters(events, keys, kinds)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events by time window and type; state older than ``late`` is dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


_OUT = "user_id long, quiet_from timestamp, quiet_s double"
_STATE = "last_us long"


def silences(events: DataFrame, quiet_s: int = runs.STALE_S, late: str = "10 minutes") -> DataFrame:
    """A row for each silence of more than ``quiet_s`` seconds, as soon as it is known.

    State is one number a run; an event-time timer reports a run that stays
    silent, so a row comes even if no further event does.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        if state.hasTimedOut:
            yield pd.DataFrame({"user_id": [key[0]], "quiet_from": [pd.Timestamp(last, unit="us")], "quiet_s": [float(quiet_s)]})
            state.update((last,))
            return
        times = sorted(int(t.value // 1000) for b in batches for t in b["ts"])
        rows = []
        for t in times:
            if last is not None and t - last > quiet_s * 1_000_000:
                rows.append((key[0], pd.Timestamp(last, unit="us"), (t - last) / 1e6))
            last = t if last is None else max(last, t)
        state.update((last,))
        if last // 1000 + quiet_s * 1000 > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(last // 1000 + quiet_s * 1000)
        yield pd.DataFrame(rows, columns=["user_id", "quiet_from", "quiet_s"])

    return events.withWatermark("ts", late).select("user_id", "ts").groupBy("user_id").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run_to_end(df: DataFrame, name: str, mode: str) -> DataFrame:
    """Run a stream over what there is, to files in the shared folder, and read it; of a result that changes (``complete``), the last state."""
    spark = df.sparkSession
    out = f"{shared_dir(spark)}/narrata-{name}-{uuid.uuid4().hex}"
    w = df.writeStream.outputMode(mode).option("checkpointLocation", f"{out}-state").trigger(availableNow=True)
    if mode != "append":
        states: list[str] = []

        def keep(batch: DataFrame, i: int) -> None:
            # The executors write each state; the driver only knows where it lies.
            batch.write.mode("overwrite").parquet(f"{out}/{i}")
            states.append(f"{out}/{i}")

        w.foreachBatch(keep).start().awaitTermination()
        return spark.read.schema(df.schema).parquet(states[-1]) if states else spark.createDataFrame([], df.schema)
    w.format("parquet").start(out).awaitTermination()
    return spark.read.schema(df.schema).parquet(out)
