"""The live jobs. Checkpoints replace file offsets; every job equals its batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from alertloom.models.detector import Detector, score_packets
from alertloom.operators.alerts import parse_alerts, typed_alerts
from alertloom.operators.joins import alerts_in_wait, windows_in_pieces
from alertloom.operators.thresholds import MICROS, detection_filter
from alertloom.runtime import existing_paths
from alertloom.sources.alerts import LINES
from alertloom.sources.suggestions import write_suggestions


def run_available(stream: DataFrame, sink: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Append everything that has arrived to a table, then stop."""
    writer = stream.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start(sink)


def stream_lines(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(LINES).option("maxFilesPerTrigger", files_per_batch).text(folder)


def stream_alerts(spark: SparkSession, folder: str, files_per_batch: int = 1000, observation: str | None = None) -> DataFrame:
    """Alerts of log files as they land; with ``observation`` each batch's progress names its lines, alerts and rejects."""
    return parse_alerts(stream_lines(spark, folder, files_per_batch), observation=observation)


def stream_score(detector: Detector, packets: DataFrame, mode: str = "either") -> DataFrame:
    """Packets that raise an alert, with their prompts; no state is kept."""
    return score_packets(detector, packets, mode)


class ThresholdStream:
    """The per-source threshold over arriving matches, exact for all rows that are not late.

    Each batch is judged by the batch operator's own window over the new rows and
    a small context table: for each rule and source the last ``count - 1`` rows
    that still lie within reach, and the rows that wait for the watermark. The
    watermark is the newest instant seen minus the delay. Rows up to the
    watermark of earlier batches are judged already; later rows of that time, of its very
    instant too, are late: they are dropped and counted. Where an instant may arrive in
    parts, give a delay, and :meth:`flush` when no more will come.

    Batch n reads context n - 1 and overwrites context n and result n, so a
    replayed batch changes nothing. No row goes through Python.
    """

    def __init__(self, store: str, track: str, count: int, seconds: int, delay_seconds: int = 0, rule: str = "sid", ts: str = "ts"):
        self.store, self.track, self.count, self.seconds = store, track, count, seconds
        self.delay, self.rule, self.ts = delay_seconds * MICROS, rule, ts

    def _path(self, table: str, version: int) -> str:
        return f"{self.store}/{table}/version={version:09d}"

    def judge(self, batch: DataFrame, version: int) -> None:
        # The batch is read by each write below; a lost block is read again from the source.
        kept = batch.persist()
        try:
            self._judge(kept, version)
        finally:
            kept.unpersist()

    def flush(self, spark: SparkSession) -> None:
        """Judge the rows that still wait, when no more will come."""
        newest = spark.read.parquet(f"{self.store}/marks").orderBy(F.desc("version")).first()
        if newest is not None:
            context = spark.read.parquet(self._path("context", newest["version"]))
            self._judge(context.drop("_t", "_waiting").limit(0), newest["version"] + 1, flush=True)

    def _judge(self, batch: DataFrame, version: int, flush: bool = False) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("_t", F.unix_micros(F.col(self.ts).cast("timestamp")))
        known = existing_paths(spark, [self._path("marks", version - 1)])[0]
        mark = spark.read.parquet(known[0]).first() if known else None
        before = mark["watermark"] if mark else None
        late = F.lit(False) if before is None else F.col("_t") <= F.lit(before)
        seen = rows.agg(F.max("_t").alias("newest"), F.count_if(late).alias("late")).first()
        if seen["newest"] is None:
            now, lost = before, mark["late"] if mark else 0
        else:
            now = max(seen["newest"] - self.delay, before if before is not None else seen["newest"] - self.delay)
            lost = seen["late"] + (mark["late"] if mark else 0)
        table = rows.where(~late).withColumn("_waiting", F.lit(True))
        if mark:
            table = table.unionByName(spark.read.schema(table.schema).parquet(self._path("context", version - 1)))
        reached = F.lit(True) if flush else F.col("_t") <= F.lit(now)
        # Rows beyond the watermark cannot count for rows up to it.
        judged = detection_filter(table.where(reached), self.track, self.count, self.seconds, self.rule, self.ts)
        judged.where("_waiting").select(*batch.columns).write.mode("overwrite").parquet(self._path("passed", version))
        newest_first = Window.partitionBy(self.rule, self.track).orderBy(F.desc("_t"))
        in_reach = table.where(reached & (F.col("_t") > F.lit((now or 0) - self.seconds * MICROS)))
        recent = in_reach.withColumn("_i", F.row_number().over(newest_first)).where(F.col("_i") <= self.count - 1)
        context = table.where(~reached).unionByName(recent.drop("_i").withColumn("_waiting", F.lit(False)))
        context.write.mode("overwrite").parquet(self._path("context", version))
        marks = spark.createDataFrame([(now, lost)], "watermark long, late long")
        marks.coalesce(1).write.mode("overwrite").parquet(self._path("marks", version))

    def start(self, matches: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        writer = matches.writeStream.foreachBatch(self.judge).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def passed(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.store}/passed").drop("version")

    def late_rows(self, spark: SparkSession) -> int:
        newest = spark.read.parquet(f"{self.store}/marks").orderBy(F.desc("version")).first()
        return newest["late"]


def stream_suggest(rules: DataFrame, store: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append each new rule once; rules of earlier batches are known from the store.

    A replayed batch finds its own rules in the store, so a restart adds nothing twice.
    """
    writer = rules.writeStream.foreachBatch(lambda batch, _: write_suggestions(batch, store))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class VerifyStream:
    """Whether expected rules fire, over arriving lines, and what arrived instead where they did not.

    ``expected`` is (sid, since, wait_seconds). Each batch writes under its own version the
    alerts that lie between the first start and the last end of all windows, each once, the first
    line of each rule that it brings, and how far time has come. Nothing that was
    written before is read or written again by a batch, and a replayed batch overwrites
    its own version.

    ``pos`` names a column of the lines, of ``pos_type``, that carries their order; without one the first
    line is the earliest, and of several the first by text. With ``delay_seconds`` there is a
    watermark, the newest instant less the delay: alerts at or behind that of earlier
    batches are late and are dropped, and a rule whose window ends at or before it and that has not
    fired has failed for good. Without a delay every line counts, and only the end of the
    stream (``ended``) makes failures final.
    """

    def __init__(self, expected: DataFrame, store: str, year: int, pos: str | None = None, delay_seconds: int | None = None, zone: str = "+00:00", pos_type: str = "long"):
        self.expected, self.store, self.year, self.pos, self.delay, self.zone = expected, store, year, pos, delay_seconds, zone
        until = F.col("since") + F.make_dt_interval(secs=F.col("wait_seconds"))
        self.low, self.high = expected.agg(F.min(F.unix_micros("since")), F.max(F.unix_micros(until))).first()
        self.pos_type = pos_type

    def _path(self, table: str, version: int) -> str:
        return f"{self.store}/{table}/version={version:09d}"

    def _read(self, table: str, schema: str) -> DataFrame:
        spark = self.expected.sparkSession
        if not existing_paths(spark, [f"{self.store}/{table}"])[0]:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema + ", version long").parquet(f"{self.store}/{table}").drop("version")

    def _order_type(self) -> str:
        return "struct<event_ts: timestamp, line: string>" if self.pos is None else self.pos_type

    def _alerts_schema(self) -> str:
        return f"sid long, event_ts timestamp, line string, _order {self._order_type()}"

    def judge(self, batch: DataFrame, version: int) -> None:
        keep = ("line",) if self.pos is None else ("line", self.pos)
        # A file may be one task however large it is, and a batch has few: its lines are dealt out to all cores first.
        batch = batch.repartition(batch.sparkSession.sparkContext.defaultParallelism)
        typed = typed_alerts(parse_alerts(batch.withColumn("line", F.col("value")), keep=keep), self.year, self.zone, keep=keep)
        order = F.struct("event_ts", "line") if self.pos is None else F.col(self.pos).cast(self.pos_type)
        alerts = typed.where("event_ts IS NOT NULL").select("sid", "event_ts", "line", order.alias("_order"))
        # Read by two writes; a lost block is parsed again from the source.
        kept = alerts.persist()
        try:
            self._judge(kept, version)
        finally:
            kept.unpersist()

    def _judge(self, alerts: DataFrame, version: int) -> None:
        spark = alerts.sparkSession
        before = self.watermark(version)
        micros = F.unix_micros("event_ts")
        late = F.lit(False) if before is None else micros <= F.lit(before)
        seen = alerts.agg(F.max(micros).alias("newest"), F.count_if(late).alias("late")).first()
        inside = F.lit(False) if self.low is None else (micros > F.lit(self.low)) & (micros <= F.lit(self.high))
        alerts.where(inside & ~late).write.mode("overwrite").parquet(self._path("alerts", version))
        written = spark.read.schema(self._alerts_schema()).parquet(self._path("alerts", version))
        hits = alerts_in_wait(self.expected, written)
        first = hits.groupBy(F.col("expected_sid").alias("sid"), "since", "wait_seconds").agg(F.min(F.struct("_order", "line")).alias("first"))
        first.write.mode("overwrite").parquet(self._path("firsts", version))
        marks = spark.createDataFrame([(seen["newest"], seen["late"])], "newest long, late long")
        marks.coalesce(1).write.mode("overwrite").parquet(self._path("marks", version))

    def watermark(self, version: int | None = None) -> int | None:
        """Microseconds up to which time has come, by the batches before ``version`` or by all; None without a delay."""
        spark = self.expected.sparkSession
        if self.delay is None or not existing_paths(spark, [f"{self.store}/marks"])[0]:
            return None
        marks = spark.read.schema("newest long, late long, version long").parquet(f"{self.store}/marks")
        marks = marks if version is None else marks.where(F.col("version") < version)
        newest = marks.agg(F.max("newest")).first()[0]
        return None if newest is None else newest - self.delay * MICROS

    def start(self, lines: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        writer = lines.writeStream.foreachBatch(self.judge).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def verdicts(self, ended: bool = False) -> DataFrame:
        """Per expected rule: sid, since, wait_seconds, passed, first_line, and whether that is final."""
        keys = ["sid", "since", "wait_seconds"]
        rules = self.expected.select(*keys).distinct()
        kinds = {k: self.expected.schema[k].dataType.simpleString() for k in keys}
        schema = ", ".join(f"{k} {t}" for k, t in kinds.items()) + f", first struct<_order: {self._order_type()}, line: string>"
        found = self._read("firsts", schema).groupBy(*keys).agg(F.min("first").alias("first")).select(*keys, F.col("first.line").alias("first_line"))
        until = F.unix_micros(F.col("since") + F.make_dt_interval(secs=F.col("wait_seconds")))
        mark = self.watermark()
        over = F.lit(True) if ended else F.lit(False) if mark is None else until <= F.lit(mark)
        passed = F.col("first_line").isNotNull()
        return rules.join(found, keys, "left").select(*keys, passed.alias("passed"), "first_line", (passed | over).alias("final"))

    def failures(self, ended: bool = False) -> tuple[DataFrame, DataFrame]:
        """(lines, ranges) of the rules that failed for good: each line of their windows once, and each rule's pieces of time."""
        failed = self.verdicts(ended).where("final AND NOT passed")
        return windows_in_pieces(failed, self._read("alerts", self._alerts_schema()))

    def late_rows(self) -> int:
        return self._read("marks", "newest long, late long").agg(F.coalesce(F.sum("late"), F.lit(0))).first()[0]
