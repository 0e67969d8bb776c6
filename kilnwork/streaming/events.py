"""Event streams: windows with late data, first occurrences, a sliding limit with state.

The limit admits exactly what operators.limits.admitted admits when events come in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read(spark: SparkSession, folder: str, files: int = 1, pattern: str = "*") -> DataFrame:
    """Events from Parquet files as they arrive in a folder, with `at` as a timestamp."""
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).option("pathGlobFilter", pattern).parquet(folder)
    return stream.withColumn("at", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums per window and type; windows close once the watermark has passed them."""
    w = F.window("at", size, slide) if slide else F.window("at", size)
    out = events.withWatermark("at", late).groupBy(w.alias("w"), "event_type")
    return out.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select("w.start", "w.end", "event_type", "n", "value")


def sessions(events: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    out = events.withWatermark("at", late).groupBy(F.session_window("at", gap).alias("w"), "user_id")
    return out.agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", "user_id", "n")


def first_of(events: DataFrame, keys: list[str], late: str = "2 days") -> DataFrame:
    """The first event of each key within the watermark: redeliveries and repeated alerts go."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(keys)


def limited(events: DataFrame, window_ms: int, limit: int, late: str = "10 minutes") -> DataFrame:
    """(user_id, event_id, allowed, used) of a sliding-window limit; state is the admitted times of
    the last window, at most `limit` a user, and is dropped once the watermark has passed it."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"user_id": [], "event_id": [], "allowed": [], "used": []}, dtype=object)
            return
        live = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ms", "event_id"])
        allowed, used = [], []
        for ms in rows.ms.tolist():
            live = [t for t in live if t > ms - window_ms]
            ok = len(live) < limit
            if ok:
                live.append(ms)
            allowed.append(ok)
            used.append(len(live))
        state.update((live,))
        state.setTimeoutTimestamp(int(max(state.getCurrentWatermarkMs(), rows.ms.max()) + window_ms))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows.event_id, "allowed": allowed, "used": used})

    timed = events.withWatermark("at", late).select("user_id", "event_id", "at", F.unix_millis("at").alias("ms"))
    keyed = timed.where("user_id is not null and ms is not null")
    return keyed.groupBy("user_id").applyInPandasWithState(
        step,
        "user_id bigint, event_id bigint, allowed boolean, used int",
        "live array<bigint>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def drain(stream: DataFrame, spark: SparkSession, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is, into a table of the driver's memory. For tests and reports
    of bounded size; production writes to files or a table."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    query.option("checkpointLocation", checkpoint).start().awaitTermination()
    return spark.table(name)


def written_out(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over what there is, into files that each batch adds to exactly once, and read them."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path)
    query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
