"""Incremental forms: station sums by batches of hours, appended samples, live overpasses.

State lives in written tables, one partition per micro-batch, overwritten when a batch is repeated;
so a restart after a lost driver or executor gives the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumeframe.functions.scalars import local_day, timestamp_from_minute
from plumeframe.operators.incidents import latest_index
from plumeframe.operators.observations import attach_day_means
from plumeframe.scale import stage, stored
from plumeframe.sources.sinks import table_exists

# ---- station sums ----------------------------------------------------------------------------


def fingerprint(stations: DataFrame, **settings) -> str:
    """Text that changes with the set of stations or any setting; stations are hashed without ordering them."""
    row = stations.agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("station_id")).alias("x"), F.sum(F.xxhash64("station_id").cast("decimal(38,0)")).alias("s")
    )
    parts = [F.lit(f"{k}={settings[k]}") for k in sorted(settings)]
    return row.select(F.sha2(F.concat_ws("|", "n", "x", "s", *parts), 256).alias("f")).first()["f"]


def state_path(base: str, stations: DataFrame, **settings) -> str:
    """Folder of the state for these inputs; other inputs start an empty one."""
    return f"{base}/state={fingerprint(stations, **settings)}"


def _others(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """Rows written by other batches."""
    if not table_exists(spark, path):
        return None
    return spark.read.parquet(path).filter(F.col("batch") != batch_id)


def add_hours(hours: DataFrame, batch_id: int, stations: DataFrame, state: str) -> None:
    """Add one batch of station hours (``station_id, hour_utc, value0, value1``) to the state.

    A station's hour that was processed before is skipped; it counts as processed even when a value is missing.
    """
    spark = hours.sparkSession
    seen = _others(spark, f"{state}/hours", batch_id)
    new = hours.dropDuplicates(["station_id", "hour_utc"])
    if seen is not None:
        new = new.join(seen.select("station_id", "hour_utc"), ["station_id", "hour_utc"], "left_anti")
    # Read by the sums and by the list of hours.
    new = stored(new)
    both = new.filter(F.col("value0").isNotNull() & F.col("value1").isNotNull())
    sums = (
        both.join(stations.select("station_id", "timezone"), "station_id")
        .groupBy("station_id", local_day("hour_utc", "timezone").alias("date_local"))
        .agg(F.sum("value0").alias("sum0"), F.sum("value1").alias("sum1"), F.count("*").alias("n"))
    )
    sums.write.mode("overwrite").parquet(f"{state}/sums/batch={batch_id}")
    # Hours last: without them a batch that failed half-way is done again.
    new.select("station_id", "hour_utc").write.mode("overwrite").parquet(f"{state}/hours/batch={batch_id}")


def run_hours(stream: DataFrame, stations: DataFrame, state: str) -> None:
    """Process everything that has arrived, then stop; call again for what comes later."""
    query = (
        stream.writeStream.foreachBatch(lambda df, batch_id: add_hours(df, batch_id, stations, state))
        .option("checkpointLocation", f"{state}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def current_sums(spark: SparkSession, state: str) -> DataFrame:
    return (
        spark.read.parquet(f"{state}/sums")
        .groupBy("station_id", "date_local")
        .agg(F.sum("sum0").alias("sum0"), F.sum("sum1").alias("sum1"), F.sum("n").alias("n"))
    )


def station_snapshot(observations: DataFrame, stations: DataFrame, state: str) -> DataFrame:
    """Station-days from the state so far."""
    return attach_day_means(observations, current_sums(observations.sparkSession, state), stations)


def progress(spark: SparkSession, state: str, wanted_hours: DataFrame) -> DataFrame:
    """One row: hours processed, hours of the run, share done."""
    done = spark.read.parquet(f"{state}/hours").select("hour_utc").distinct()
    total = wanted_hours.select("hour_utc").distinct()
    both = total.join(done.withColumn("_done", F.lit(1)), "hour_utc", "left")
    return both.agg(F.count("_done").alias("processed_hours"), F.count("*").alias("total_hours")).withColumn(
        "share", F.col("processed_hours") / F.greatest("total_hours", F.lit(1))
    )


# ---- samples ---------------------------------------------------------------------------------


def check_resume(log: DataFrame, mode: str, hours: Sequence[int] | None) -> None:
    """Raise when a log was written with another mode or other source hours."""
    found = log.agg(F.count_if(F.coalesce("aggregation_mode", F.lit("hourly")) != mode).alias("mode")).first()
    if found["mode"]:
        raise ValueError(f"resume mode mismatch: the log is not {mode}")
    if hours is not None:
        wanted = ",".join(str(h) for h in sorted(hours))
        other = log.agg(F.count_if(F.coalesce("source_hours_utc", F.lit("")) != wanted).alias("n")).first()
        if other["n"]:
            raise ValueError(f"resume hours mismatch: the log does not use {wanted}")


def add_samples(rows: DataFrame, batch_id: int, path: str) -> None:
    """Append index rows of samples that are not there yet, one partition per batch."""
    spark = rows.sparkSession
    done = _others(spark, path, batch_id)
    new = latest_index(rows.withColumn("seq", F.lit(0).cast("bigint")) if "seq" not in rows.columns else rows)
    if done is not None:
        new = new.join(done.select("sample_key").distinct(), "sample_key", "left_anti")
    new.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def run_samples(stream: DataFrame, path: str) -> None:
    query = (
        stream.writeStream.foreachBatch(lambda df, batch_id: add_samples(df, batch_id, path))
        .option("checkpointLocation", f"{path}-checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def sample_table(spark: SparkSession, path: str) -> DataFrame:
    """Index over all batches; of repeated samples the latest batch counts."""
    rows = spark.read.parquet(path).withColumn("seq", F.col("batch") * 1_000_000_000_000 + F.coalesce("seq", F.lit(0)))
    return latest_index(rows).drop("batch", "seq")


# ---- overpasses ------------------------------------------------------------------------------


SPANS = ("incident_id", "start_minute", "end_minute", "pixels", "weighted_minutes")


def _merged_spans(spans: DataFrame, gap_minutes: int) -> DataFrame:
    """Spans of an incident that lie within the gap of each other become one; ``_old`` are the batches of those it replaces."""
    by_start = Window.partitionBy("incident_id").orderBy("start_minute", "end_minute")
    reached = F.max("end_minute").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reached.isNull() | (F.col("start_minute") - reached > gap_minutes), 1).otherwise(0)
    marked = spans.withColumn("_new", fresh).withColumn("_island", F.sum("_new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    replaced = F.collect_list(F.when(F.col("_batch") >= 0, F.struct(F.col("_batch").alias("batch"), "start_minute")))
    return marked.groupBy("incident_id", "_island").agg(
        F.min("start_minute").alias("start_minute"),
        F.max("end_minute").alias("end_minute"),
        F.sum("pixels").alias("pixels"),
        F.sum("weighted_minutes").alias("weighted_minutes"),
        replaced.alias("_old"),
    )


def _standing(spark: SparkSession, state: str, before: int | None = None) -> DataFrame | None:
    """Sessions that no later batch has replaced, each with the batch that wrote it; only batches below ``before`` count."""
    if not table_exists(spark, f"{state}/sessions"):
        return None
    rows, gone = spark.read.parquet(f"{state}/sessions"), spark.read.parquet(f"{state}/replaced")
    if before is not None:
        rows, gone = rows.filter(F.col("batch") < before), gone.filter(F.col("batch") < before)
    gone = gone.select("incident_id", "start_minute", F.col("old_batch").alias("batch"))
    return rows.join(gone, ["incident_id", "start_minute", "batch"], "left_anti")


def add_detections(detections: DataFrame, batch_id: int, state: str, gap_minutes: int = 45) -> None:
    """Merge one batch of assigned detections (``incident_id, acq_ts``) into the session table.

    The batch is counted by minute first. Its minutes extend sessions, start new ones or, when they are late, join
    sessions of earlier batches; a joined session is written anew and the old rows are listed as replaced. Only sessions
    within reach of the batch's minutes are read: the bounds are pushed into the scan. Sessions of one incident are at
    most its minutes. Written by batch, so a repeated batch overwrites itself.
    """
    spark = detections.sparkSession
    minute = F.floor(F.unix_seconds("acq_ts") / 60).cast("bigint")
    counted = detections.filter("incident_id is not null and acq_ts is not null").groupBy("incident_id", minute.alias("start_minute")).agg(F.count("*").alias("pixels"))
    spans = stage(
        counted.select(
            "incident_id", "start_minute", F.col("start_minute").alias("end_minute"), "pixels", (F.col("start_minute") * F.col("pixels")).alias("weighted_minutes")
        )
    )
    first, last = spans.agg(F.min("start_minute"), F.max("end_minute")).first()
    new = spans.withColumn("_batch", F.lit(-1).cast("bigint"))
    standing = None if first is None else _standing(spark, state, batch_id)
    if standing is not None:
        near = standing.filter((F.col("end_minute") >= first - gap_minutes) & (F.col("start_minute") <= last + gap_minutes))
        touched = spans.select("incident_id").distinct()
        near = near.join(touched, "incident_id", "left_semi").select(*SPANS, F.col("batch").cast("bigint").alias("_batch"))
        new = new.unionByName(near)
    merged = stage(_merged_spans(new, gap_minutes))
    old = merged.select("incident_id", F.explode("_old").alias("o")).select("incident_id", F.col("o.start_minute").alias("start_minute"), F.col("o.batch").alias("old_batch"))
    old.write.mode("overwrite").parquet(f"{state}/replaced/batch={batch_id}")
    # Sessions last: without them a batch that failed half-way is done again.
    merged.select(*SPANS).write.mode("overwrite").parquet(f"{state}/sessions/batch={batch_id}")


def run_detections(stream: DataFrame, state: str, gap_minutes: int = 45) -> None:
    """Process everything that has arrived, then stop; call again for what comes later."""
    query = (
        stream.writeStream.foreachBatch(lambda df, batch_id: add_detections(df, batch_id, state, gap_minutes))
        .option("checkpointLocation", f"{state}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def live_overpasses(spark: SparkSession, state: str, gap_minutes: int = 45, late_minutes: int = 30, ended: bool = False) -> DataFrame:
    """Overpass events of the feed so far, as ``overpass_events`` gives them, and whether each is still ``open``.

    A session is open while a detection that is at most ``late_minutes`` behind the newest one could join it; later
    ones still reopen it when they come. ``ended`` says that the feed is over: all sessions are closed.
    """
    sessions = _standing(spark, state)
    newest = sessions.agg(F.max("end_minute")).first()[0]
    # The minutes of a late detection start at the bound; at the end of a feed there is none.
    bound = newest - late_minutes if newest is not None else 0
    middle = F.rint(F.col("weighted_minutes") / F.col("pixels")).cast("bigint")
    in_order = Window.partitionBy("incident_id").orderBy("start_minute")
    return sessions.select(
        "incident_id",
        (F.row_number().over(in_order) - 1).cast("int").alias("event_idx"),
        F.col("start_minute").alias("event_start_minute"),
        F.col("end_minute").alias("event_end_minute"),
        middle.alias("event_mid_minute"),
        F.col("pixels").alias("event_pixel_count"),
        timestamp_from_minute(middle).alias("event_time_utc"),
        (F.lit(not ended) & (F.col("end_minute") + gap_minutes >= bound)).alias("open"),
    )
