"""Structured Streaming jobs.

Streams read files landing in a folder (parquet), run the same operators as
the batch path, and write to a sink with checkpointing in the shared folder;
``availableNow`` drains what is there and stops (restart-safe).  A job that is given
the same folder ``at`` again goes on from its checkpoint with what has come since.
Keyed state that outlives a batch is kept in RocksDB, on disk and in the checkpoint.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions import text as TX
from ..operators import findings as FD
from ..operators import rules as RU
from ..operators.helpers import join_null_safe, ordered_scan
from ..session import shared_path


_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB (also after a restart)."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _run(df: DataFrame, spark: SparkSession, mode: str = "append", at: str | None = None) -> DataFrame:
    base = at or shared_path(spark, "stream")
    q = (df.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def _files(spark: SparkSession, in_dir: str, schema: str, per_batch: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", per_batch) if per_batch else r).parquet(in_dir)


def stream_scan(spark: SparkSession, in_dir: str, schema: str, rules=None) -> DataFrame:
    """Units arriving as files -> rule scan -> findings sink (stateless)."""
    units = spark.readStream.schema(schema).parquet(in_dir)
    return _run(RU.scan_rules(units, rules), spark)


def stream_verdicts(spark: SparkSession, in_dir: str, schema: str, rules=None) -> DataFrame:
    """T1 with the unit verdict: each micro-batch of units is scanned and reduced to one
    verdict a unit (a unit arrives in one file, so its findings are in one batch)."""
    out = shared_path(spark, "stream-out")

    def write(batch: DataFrame, batch_id: int) -> None:
        verdict = FD.unit_verdict(RU.scan_rules(batch, rules))
        # a batch that runs again overwrites its own folder
        verdict.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = (spark.readStream.schema(schema).parquet(in_dir).writeStream.foreachBatch(write)
         .option("checkpointLocation", shared_path(spark, "stream-ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out).drop("batch")


class _Verdicts(StatefulProcessor):
    """Verdict of a unit over all its findings so far, given out when none has come for a while.

    State: number, greatest confidence, worst severity and its rank, revision, the timer that is
    set.  The timer stands ``quiet`` after the latest finding; findings after a verdict set it
    again, and the next verdict, a revision, counts the earlier ones too."""

    def __init__(self, quiet_ms: int):
        self.quiet = quiet_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("verdict", "n long, confidence double, severity string, rank int, revision long, timer long")

    def handleInputRows(self, key, rows, timerValues):
        # each call to the state is a round trip, which a unit of few findings costs more than its rows
        n, confidence, severity, rank, revision, timer = self.state.get() or (0, None, None, -1, 0, 0)
        latest = timer - self.quiet if timer else 0
        for r in rows:
            n += r.n
            if r.confidence is not None and not math.isnan(r.confidence):
                confidence = r.confidence if confidence is None else max(confidence, r.confidence)
            if r.rank > rank:
                rank, severity = r.rank, r.severity
            latest = max(latest, r.latest)
        if timer != latest + self.quiet:
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(latest + self.quiet)
        self.state.update((n, confidence, severity, rank, revision, latest + self.quiet))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        n, confidence, severity, rank, revision, _ = self.state.get()
        self.state.update((n, confidence, severity, rank, revision + 1, 0))
        yield Row(uid=key[0], n_findings=n, max_confidence=confidence, max_severity=severity, revision=revision + 1)

    def close(self) -> None:
        pass


_PARTIAL = "uid string, n long, confidence double, severity string, rank int, latest long, event_time timestamp"


def _partial_verdicts(batches):
    """One row per unit of a batch of findings, so that a hot unit sends few rows to its task."""
    for f in batches:
        g = f.sort_values("rank", ascending=False, kind="stable").groupby("uid", sort=False, dropna=False)
        out = g.agg(n=("rank", "size"), confidence=("confidence", "max"), severity=("severity", "first"), rank=("rank", "max"), latest=("latest", "max"), event_time=("event_time", "max"))
        yield out.reset_index()[[c.split()[0] for c in _PARTIAL.split(", ")]]


def stream_unit_verdicts(spark: SparkSession, in_dir: str, schema: str, quiet: str = "10 minutes", delay: str = "10 minutes", at: str | None = None,
                         files_per_batch: int | None = None) -> DataFrame:
    """T1, stateful: findings (uid, severity, confidence, event_time) that arrive in any number of
    files -> uid, n_findings, max_confidence, max_severity, revision, is_vulnerable.

    A unit gets a verdict once the watermark (latest time less ``delay``) is ``quiet`` past its
    latest finding; if more findings come, a further verdict (the next revision) over all of
    them.  ``last_verdicts`` has the latest of each unit.  Findings without a uid are left out,
    those later than the watermark too, as Spark drops them."""
    f = _files(spark, in_dir, schema, files_per_batch).filter("uid is not null")
    f = f.withColumn("rank", FD.severity_rank("severity").cast("int")).withColumn("latest", F.unix_millis("event_time"))
    partial = f.select("uid", "severity", F.col("confidence").cast("double"), "rank", "latest", "event_time").mapInPandas(_partial_verdicts, _PARTIAL)
    millis = spark.range(1).select(F.unix_millis(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {quiet}"))).first()[0]
    keyed = partial.withWatermark("event_time", delay).groupBy("uid")
    # rows, as a data frame for each unit and verdict would cost more than all else
    out = keyed.transformWithState(_Verdicts(millis), "uid string, n_findings long, max_confidence double, max_severity string, revision long", "Append", "EventTime")
    with _rocksdb(spark):
        done = _run(out, spark, at=at)
    return done.withColumn("is_vulnerable", F.col("n_findings") > 0)


def last_verdicts(verdicts: DataFrame) -> DataFrame:
    """The latest revision of each unit's verdict."""
    rest = [c for c in verdicts.columns if c not in ("uid", "revision")]
    last = verdicts.groupBy("uid").agg(F.max_by(F.struct(*rest), "revision").alias("v"))
    return last.select("uid", "v.*")


def stream_dedup(spark: SparkSession, in_dir: str, schema: str, delay: str = "1 hour") -> DataFrame:
    """First-seen content within the watermark delay (duplicates older than
    the delay can pass; ``stream_dedup_exact`` catches them)."""
    s = spark.readStream.schema(schema).parquet(in_dir).withColumn("hash", TX.content_hash("code"))
    d = s.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["hash"])
    return _run(d.drop("code"), spark)


def stream_dedup_exact(spark: SparkSession, in_dir: str, schema: str, at: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """T2 beyond any watermark: a content passes once, however late it comes again.

    Every hash seen stays in RocksDB, whose own Bloom filters answer for most new hashes
    without a read and which asks the stored keys before anything is dropped, so no new row is
    lost.  State grows by a hash per distinct content, on the executors' disks and in the
    checkpoint.  Of equal contents in one micro-batch any one passes."""
    s = _files(spark, in_dir, schema, files_per_batch).withColumn("hash", TX.content_hash("code"))
    with _rocksdb(spark):
        return _run(s.dropDuplicates(["hash"]).drop("code"), spark, at=at)


def log_rollup(df: DataFrame, width: str = "10 minutes", watermark: str | None = None) -> DataFrame:
    """Tumbling-window counts per level (batch or stream)."""
    if watermark:
        df = df.withWatermark("ts", watermark)
    return df.groupBy(F.window("ts", width).alias("w"), "level").agg(F.count(F.lit(1)).alias("n"))


def stream_log_rollup(spark: SparkSession, in_dir: str, schema: str, width: str = "10 minutes",
                      delay: str = "1 hour") -> DataFrame:
    """T3 in append mode: a window is emitted once the watermark (latest time less
    ``delay``) has passed its end; rows later than that are dropped by Spark."""
    s = spark.readStream.schema(schema).parquet(in_dir)
    return _run(log_rollup(s, width, watermark=delay).select(
        F.unix_timestamp(F.col("w.start")).alias("window_start"), "level", "n"), spark)


def log_tail(logs: DataFrame, since: int, job: str = "job_id") -> DataFrame:
    """T4: entries after offset ``since`` per job, plus the job's total.

    Keys alone are numbered and counted, a job split over buckets of time, so no job's
    rows meet in one task; entries join back by their own id."""
    keys = logs.select(F.col(job).alias("_job"), "ts", "entry_id")
    numbered = ordered_scan(keys, ["ts", "entry_id"], None, ["_job"], "offset", total_col="total")
    return logs.join(numbered.filter(F.col("offset") > since).select("entry_id", "offset", "total"), "entry_id")


class _Offsets(StatefulProcessor):
    """Numbers the entries of a job in order of arrival; state: how many there have been."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues):
        n = self.state.get()[0] if self.state.exists() else 0
        entries = pd.concat(list(rows)).sort_values(["ts", "entry_id"], kind="stable")
        self.state.update((n + len(entries),))
        entries["offset"] = range(n + 1, n + len(entries) + 1)
        yield entries[["job_id", "entry_id", "offset"]]

    def close(self) -> None:
        pass


def stream_log_offsets(spark: SparkSession, in_dir: str, schema: str, at: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """T4, stateful: job_id, entry_id, offset of log entries as they arrive.

    A job's entries are numbered from 1 across files, batches and restarts; inside a micro-batch
    by time, then id.  Only keys go through the state's shuffle; a job's entries of one
    micro-batch meet in one task, so ``files_per_batch`` bounds them.  Entries without a job
    share the offsets of the null job."""
    s = _files(spark, in_dir, schema, files_per_batch).select("job_id", "entry_id", "ts")
    out = s.groupBy("job_id").transformWithStateInPandas(_Offsets(), "job_id long, entry_id long, offset long", "Append", "None")
    with _rocksdb(spark):
        return _run(out, spark, at=at)


def offsets_tail(offsets: DataFrame, since: int) -> DataFrame:
    """job_id, entry_id, offset, total: entries after offset ``since`` with the job's total so far."""
    total = offsets.groupBy("job_id").agg(F.max("offset").alias("total"))
    return join_null_safe(offsets.filter(F.col("offset") > since), total, ["job_id"])
