"""Structured Streaming forms of the batch operators: windowed counts, dedup, cooldown, label joins, parity with batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupStateTimeout

ALERTS = "symbol string, ts timestamp, event_id long, move double"
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """A stream over a folder's Parquet files."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "events*.parquet").parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(stream: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """origin, bucket, n of windows; rows later than the watermark are left out."""
    w = F.window("ts", width)
    return stream.withWatermark("ts", late).groupBy(F.col("event_type").alias("origin"), w.alias("w")).agg(F.count("*").alias("n")).select("origin", F.col("w.start").alias("bucket"), "n")


def sliding(stream: DataFrame, width: str, step: str, late: str = "2 hours") -> DataFrame:
    w = F.window("ts", width, step)
    return stream.withWatermark("ts", late).groupBy(F.col("event_type").alias("origin"), w.alias("w")).agg(F.count("*").alias("n")).select("origin", F.col("w.end").alias("until"), "n")


def distinct(stream: DataFrame, key: str, late: str = "2 hours") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def labels_with_decisions(labels: DataFrame, decisions: DataFrame, seconds: int = 300) -> DataFrame:
    """All pairs of a key at most so many seconds apart, from two streams; a foreachBatch sink picks the nearest.

    Streams join on key and stretch of so many seconds, decisions in their own and the two next to it, so that a row
    is held against the state of its surroundings and not of all its key.
    """
    late, width = f"{seconds} seconds", seconds * 1_000_000
    own = lambda ts: F.floor(F.unix_micros(ts) / width)
    a = labels.withWatermark("ts", late).withColumn("stretch", own("ts")).alias("a")
    near = F.array(*[own("r_ts") + i for i in (-1, 0, 1)])
    b = decisions.withWatermark("r_ts", late).withColumn("r_stretch", F.explode(near)).alias("b")
    apart = F.expr(f"b.r_ts between a.ts - interval {seconds} seconds and a.ts + interval {seconds} seconds")
    return a.join(b, (F.col("a.origin") == F.col("b.r_origin")) & (F.col("a.stretch") == F.col("b.r_stretch")) & apart).drop("stretch", "r_stretch")


def cooled(stream: DataFrame, minutes: int, differ: float, late: str = "2 hours") -> DataFrame:
    """Alerts (symbol, ts, event_id, move) that come so many minutes after the symbol's last accepted one or differ enough from it.

    State is the last accepted alert of a symbol; it goes once the watermark is so many minutes past it, when any alert
    would be accepted. Alerts of a micro-batch are taken in order of time; one older than the last accepted one counts
    as soon after it, one later than the watermark allows, or without a time, is left out.
    """
    width = minutes * 60_000_000

    def accept(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"], kind="stable")
        last, keep = state.get if state.exists else None, []
        for own in zip((rows.ts.astype("datetime64[us]").astype("int64")).tolist(), rows.move.tolist(), strict=True):
            ok = last is None or own[0] - last[0] >= width or abs(own[1] - last[1]) >= differ
            keep.append(ok)
            last = own if ok else last
        state.update(last)
        state.setTimeoutTimestamp(max((last[0] + width) // 1000, state.getCurrentWatermarkMs() + 1))
        yield rows[np.array(keep)][["symbol", "ts", "event_id", "move"]]

    grouped = stream.withWatermark("ts", late).groupBy("symbol")
    return grouped.applyInPandasWithState(accept, ALERTS, "t long, move double", "append", GroupStateTimeout.EventTimeTimeout)


def run_cooled(stream: DataFrame, folder: str, minutes: int, differ: float) -> DataFrame:
    """Accepted alerts of what is there now, written to folder (shared by driver and executors); a later run goes on from the state that it left."""
    return run_available(cooled(stream, minutes, differ), folder)


def nearest_labels(labels: DataFrame, decisions: DataFrame, seconds: int = 300, late: str = "0 seconds") -> DataFrame:
    """event_id, h_id: each label (origin, ts, event_id) with the nearest decision (origin, ts, h_id) at most so many seconds away, once.

    A label is answered when the watermark is past all decisions that could be nearer. State is the labels of an origin
    and stretch of so many seconds with the decisions around it, so no origin's rows meet as a whole, and it goes with
    the answer. Of decisions as near the earlier one wins, then the smaller id. Labels without one, and rows later than
    the watermark allows, give nothing; whatever lies behind the watermark when the input ends waits for more of it.
    """
    width = seconds * 1_000_000
    one = lambda df, i, kind: df.select("origin", "ts", F.col(i).alias("id"), F.lit(kind).alias("kind"))
    both = one(labels, "event_id", 0).union(one(decisions, "h_id", 1)).withWatermark("ts", late)
    own = F.floor(F.unix_micros("ts") / width)
    spread = both.withColumn("stretch", F.explode(F.when(F.col("kind") == 0, F.array(own)).otherwise(F.array(own - 1, own, own + 1))))

    def answered(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        have = [[int(v) for v in x] for x in state.get] if state.exists else [[], [], [], []]
        if state.hasTimedOut:
            state.remove()
            at, ids = (np.array(x, np.int64) for x in have[2:])
            order = np.lexsort((ids, at))
            at, ids, out = at[order], ids[order], []
            for t, i in zip(*have[:2], strict=True):
                near = [j for j in (np.searchsorted(at, at[np.searchsorted(at, t) - 1]) if np.searchsorted(at, t) else len(at), np.searchsorted(at, t)) if j < len(at) and abs(at[j] - t) <= width]
                if near:
                    out.append((i, ids[min(near, key=lambda j: (abs(at[j] - t), j))]))
            yield pd.DataFrame(out, columns=["event_id", "h_id"])
            return
        for rows in parts:
            t = rows.ts.astype("datetime64[us]").astype("int64")
            for kind in (0, 1):
                mine = (rows.kind == kind).to_numpy()
                have[2 * kind] += t[mine].tolist()
                have[2 * kind + 1] += rows.id[mine].tolist()
        state.update(tuple(have))
        state.setTimeoutTimestamp(max((int(key[1]) + 2) * width // 1000 + 1, state.getCurrentWatermarkMs() + 1))

    kept = "l_t array<long>, l_id array<long>, d_t array<long>, d_id array<long>"
    return spread.groupBy("origin", "stretch").applyInPandasWithState(answered, "event_id long, h_id long", kept, "append", GroupStateTimeout.EventTimeTimeout)


class FailureAlerts(StreamingQueryListener):
    """Counts failures that streams observe under a name, and calls alert(component, count) at every so manieth of a component.

    observed() adds the metric to a stream; each micro-batch reports a row of counts, one a component.
    """

    def __init__(self, components: list[str], alert, every: int = 10, name: str = "failures"):
        self.components, self.alert, self.every, self.name, self.counts = components, alert, every, name, dict.fromkeys(components, 0)

    def observed(self, stream: DataFrame, component: str, failed: Column) -> DataFrame:
        return stream.observe(self.name, *[F.count_if(failed & (F.col(component) == c)).alias(f"c{i}") for i, c in enumerate(self.components)])

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        for i, c in enumerate(self.components if row is not None else ()):
            before, self.counts[c] = self.counts[c], self.counts[c] + row[f"c{i}"]
            for n in range(before // self.every + 1, self.counts[c] // self.every + 1):
                self.alert(c, n * self.every)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def run_available(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now and reads what it wrote to folder: the rows of all micro-batches, or in complete mode of the last.

    folder is shared by driver and executors; a batch that is run again overwrites what it wrote.
    """
    spark = stream.sparkSession

    def batch(rows: DataFrame, n: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/out/micro_batch={n}")

    q = stream.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/out")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):  # no batch yet
        return spark.createDataFrame([], stream.schema)
    out = spark.read.schema(stream.schema).parquet(f"{folder}/out").drop("micro_batch")
    if mode == "complete":
        names = [x.getPath().getName() for x in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
        out = spark.read.schema(stream.schema).parquet(f"{folder}/out/micro_batch={max(int(x.split('=')[1]) for x in names if '=' in x)}")
    return out


def append_parquet(stream: DataFrame, path: str, checkpoint: str, every: str = "600 seconds"):
    """Ingest loop: appends each micro-batch to path, exactly once by its checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=every).start()
