"""File-arrival alerts and keyed posterior state with Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from larkspan.functions.text import fmt_line
from larkspan.operators.aggregates import digest
from larkspan.operators.filters import RUNNING, Rules
from larkspan.sources.writers import write_partitioned

# Fixed value: the message when no hour passes.
NOTHING = "No Times to Run Today!"


def stream_json(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """New JSON files in a folder, each read once."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def stream_parquet(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def run_available(writer: DataStreamWriter, checkpoint: str) -> StreamingQuery:
    """Process everything that has arrived since the last run, then stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def daily_message(hours: DataFrame, key: Sequence[str], rules: Rules = RUNNING) -> DataFrame:
    """One message per day from hourly readings (one row per day and hour)."""
    text = fmt_line(F.col("hour"), F.col("temp"), F.col("wind_speed"), F.col("status"))
    lines = hours.select(*key, "hour", F.when(rules.condition(), text).alias("line"))
    return digest(lines, key, "hour", "line", NOTHING)


def alert_stream(hours: DataFrame, key: Sequence[str], sink: str, rules: Rules = RUNNING, kept: str | None = None) -> DataStreamWriter:
    """Write the messages of every arriving batch of hourly readings, one folder per day.

    A day may arrive in any number of batches: readings are kept in ``kept``
    (next to the sink unless given), a folder per day and batch, and a batch
    rebuilds the messages of its days from all their readings. Of several
    readings of an hour the latest batch's counts, within a batch the greatest
    row. A batch repeated after a failure replaces what it wrote before.
    """
    key, kept = list(key), kept or f"{sink.rstrip('/')}_readings"
    rest = [c for c in hours.columns if c not in (*key, "hour")]

    def emit(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        write_partitioned(batch.withColumn("epoch", F.lit(epoch)), kept, [*key, "epoch"])
        if not (days := spark.read.schema(batch.schema.add("epoch", "long")).parquet(kept).filter(F.col("epoch") <= epoch)).limit(1).count():
            return
        touched = days.filter(F.col("epoch") == epoch).select(*key).distinct()
        readings = days.join(touched, key, "left_semi").groupBy(*key, "hour").agg(F.max(F.struct("epoch", *rest)).alias("last"))
        write_partitioned(daily_message(readings.select(*key, "hour", *[f"last.{c}" for c in rest]), key, rules), sink, key, fmt="json")

    return hours.writeStream.foreachBatch(emit)


def beta_stream(events: DataFrame, key: Sequence[str], success: str, prior_alpha: float = 1, prior_beta: float = 1) -> DataFrame:
    """Posterior per key as running state: counts fold by key, order of arrival does not matter."""
    s = F.sum(F.col(success).cast("bigint"))
    counts = events.groupBy(*key).agg(s.alias("successes"), (F.count(F.lit(1)) - s).alias("failures"))
    a, b = F.col("successes") + prior_alpha, F.col("failures") + prior_beta
    return counts.select(*key, "successes", "failures", a.alias("alpha"), b.alias("beta"), (a / (a + b)).alias("mean"))


def keep_updates(state: DataFrame, sink: str) -> DataStreamWriter:
    """Append the keys each batch changed, one folder per batch; a repeated batch replaces its own."""

    def emit(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")

    return state.writeStream.outputMode("update").foreachBatch(emit)


def latest_state(updates: DataFrame, key: Sequence[str]) -> DataFrame:
    """Current value per key from the kept updates: the one of the latest batch."""
    rest = [c for c in updates.columns if c not in (*key, "epoch")]
    newest = F.max_by(F.struct(*rest), F.col("epoch"))
    return updates.groupBy(*key).agg(newest.alias("s")).select(*key, "s.*")
