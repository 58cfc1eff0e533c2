"""The per-source threshold on Spark's own state: keyed state, event-time timers and expiry."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from alertloom.operators.thresholds import MICROS

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _judge(count: int, seconds: int):
    """A function of batches (rule, track, begin, instants): the instants of the second half of each window that are over the threshold."""
    size = seconds * MICROS

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Windows are laid side by side, each three sizes long, so that one search serves many; numbers stay below 2 ** 62.
        together = max(1, (1 << 62) // (3 * size))
        for batch in batches:
            for first in range(0, batch.num_rows, together):
                part = batch.slice(first, together)
                held = part.column("instants")
                t, n = (held.flatten().field(name).to_numpy(zero_copy_only=False) for name in ("instant", "n"))
                of = np.repeat(np.arange(len(held)), held.value_lengths().to_numpy(zero_copy_only=False))
                begin = part.column("begin").to_numpy(zero_copy_only=False)[of]
                place = t - begin + (of * 3 + 1) * size
                order = np.argsort(place, kind="stable")
                t, n, of, begin, place = t[order], n[order], of[order], begin[order], place[order]
                total = np.concatenate([[0], n.cumsum()])
                reach = total[1:] - total[np.searchsorted(place, place - size, "right")]
                found = np.flatnonzero((reach >= count) & (t >= begin + size))
                rows = pa.array(of[found])
                columns = [part.column("rule").take(rows), part.column("track").take(rows), pa.array(t[found]), pa.array(reach[found])]
                yield pa.RecordBatch.from_arrays(columns, ["rule", "track", "instant", "n"])

    return over


class StateThreshold:
    """The per-source threshold over arriving matches, held in Spark's state store.

    Rows are counted per rule, source and instant first, by a streaming aggregate that
    combines them before the shuffle, so equal instants of a flood are one number. An
    instant goes to the span of ``seconds`` that it lies in and, as context, to the next one:
    windows of two spans that slide by one. (rule, source, window) is the key of a second aggregate's
    state, so a source that never rests is spread over as many keys as it has spans. When the
    watermark has passed the end of a window, its instants leave the state, are judged by their running total
    and written out as (rule, source, instant in microseconds, rows in reach).

    Restarts resume from the checkpoint. Rows at or before the watermark, the newest instant of
    earlier batches less the delay, are late: they count for nothing, and the progress of the query tells how many
    (``numRowsDroppedByWatermark``). An instant without a time counts for nothing. A row
    without a rule is no match, but its time moves the watermark: a heartbeat, or a last
    row two spans behind the others, makes spans final. Sources that are null are one source.

    Needs the RocksDB state store, which :meth:`start` asks for. Only counts of instants go through Python, many
    windows at a time, and none of windows with too few rows; the state itself never does.
    """

    def __init__(self, store: str, track: str, count: int, seconds: int, delay_seconds: int = 0, rule: str = "sid", ts: str = "ts"):
        self.store, self.track, self.count, self.seconds = store, track, count, seconds
        self.delay, self.rule, self.ts = delay_seconds, rule, ts

    def verdicts(self, matches: DataFrame) -> DataFrame:
        """(rule, track, instant, n) as a stream: the instants at which a source is over the threshold."""
        timed = matches.select(F.col(self.rule).alias("rule"), F.col(self.track).alias("track"), F.col(self.ts).cast("timestamp").alias("at"))
        timed = timed.withWatermark("at", f"{self.delay} seconds")
        # One test of both columns, which stays behind the watermark and does not keep heartbeats from it.
        real = timed.where(F.when(F.col("at").isNotNull(), F.col("rule").isNotNull()).otherwise(False))
        instants = real.groupBy("rule", "track", "at").agg(F.count(F.lit(1)).alias("n"))
        spans = F.window("at", f"{2 * self.seconds} seconds", f"{self.seconds} seconds")
        held = F.collect_list(F.struct(F.unix_micros("at").alias("instant"), "n"))
        windows = instants.groupBy("rule", "track", spans.alias("span")).agg(held.alias("instants"), F.sum("n").alias("rows"))
        full = windows.where(F.col("rows") >= self.count).select("rule", "track", F.unix_micros("span.start").alias("begin"), "instants")
        fields = [T.StructField(c, timed.schema[c].dataType) for c in ("rule", "track")]
        schema = T.StructType([*fields, T.StructField("instant", T.LongType()), T.StructField("n", T.LongType())])
        return full.mapInArrow(_judge(self.count, self.seconds), schema)

    def start(self, matches: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        """Append verdicts to the store; the setting of the state store holds for this query only."""
        spark = matches.sparkSession
        before = spark.conf.get(PROVIDER, None)
        spark.conf.set(PROVIDER, ROCKSDB)
        try:
            writer = self.verdicts(matches).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
            return writer.trigger(**(trigger or {"availableNow": True})).start(self.store)
        finally:
            if before is None:
                spark.conf.unset(PROVIDER)
            else:
                spark.conf.set(PROVIDER, before)

    def passed(self, matches: DataFrame) -> DataFrame:
        """The rows of a table of matches, such as the one that was streamed, whose instant has a verdict."""
        names = {"rule": F.col(self.rule), "track": F.col(self.track), "instant": F.unix_micros(F.col(self.ts).cast("timestamp"))}
        found = matches.sparkSession.read.parquet(self.store).select(*[F.col(c).alias(f"_{c}") for c in names])
        on = reduce(lambda x, y: x & y, [column.eqNullSafe(F.col(f"_{c}")) for c, column in names.items()])
        return matches.join(found, on, "left_semi")
