"""SRC-1..3: stream readers. Kafka needs the spark-sql-kafka connector on
the classpath (not present in the test image); the parquet file stream is
the replay path used in tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intentlane import params as P
from intentlane.operators.normalize import decode_intents, normalize_behavior
from intentlane.session import scratch_path

#: a time after every event, in microseconds: 2200-01-01 00:00:00 UTC
END_OF_TIME_US = 7_258_118_400_000_000


#: records that one micro-batch takes from a topic, unless the caller says otherwise
MAX_OFFSETS_PER_TRIGGER = 5_000_000


def kafka_source(spark: SparkSession, servers: str, topic: str,
                 starting_offsets: str = "earliest", max_offsets_per_trigger: int = MAX_OFFSETS_PER_TRIGGER) -> DataFrame:
    """Raw Kafka records (key, value as strings, partition, offset, timestamp);
    offsets are tracked by the query checkpoint instead of manual commits."""
    return (spark.readStream.format("kafka")
            .option("kafka.bootstrap.servers", servers)
            .option("subscribe", topic)
            .option("startingOffsets", starting_offsets)
            .option("maxOffsetsPerTrigger", str(max_offsets_per_trigger))   # the first batch is not the whole topic
            .load()
            .select(F.col("key").cast("string").alias("key"),
                    F.col("value").cast("string").alias("value"),
                    "partition", "offset", "timestamp"))


def kafka_behavior(spark: SparkSession, servers: str, topic: str = P.TOPIC_BEHAVIOR) -> DataFrame:
    """SRC-1 + NRM-1: behaviour stream from the earliest offset, normalised."""
    return normalize_behavior(kafka_source(spark, servers, topic, "earliest"), keep_raw=True)


def kafka_intents(spark: SparkSession, servers: str, topic: str = P.TOPIC_INTENT) -> DataFrame:
    """SRC-2 + NRM-2: intent stream from the latest offset, decoded, with reason, context and the raw payload."""
    return decode_intents(kafka_source(spark, servers, topic, "latest"), keep_payload=True)


def kafka_retries(spark: SparkSession, servers: str, topic: str = P.TOPIC_RETRY) -> DataFrame:
    """SRC-3: the retry topic; its own query, hence its own checkpoint."""
    return kafka_source(spark, servers, topic, "earliest")


def dedupe_intents(intents: DataFrame, watermark: str = "1 hour",
                   keys: tuple[str, ...] = ("user_id", "event_time_us")) -> DataFrame:
    """Consumer side of the at-least-once intent topic: drop replayed
    promotions by (user, event time). On a stream the de-duplication state is
    bounded by the watermark (``dropDuplicatesWithinWatermark``); on a batch
    it is a plain ``dropDuplicates`` (one shuffle on the keys)."""
    if intents.isStreaming:
        return (intents.withColumn("_ts", F.timestamp_micros(F.col("event_time_us")))
                .withWatermark("_ts", watermark)
                .dropDuplicatesWithinWatermark(list(keys)).drop("_ts"))
    return intents.dropDuplicates(list(keys))


def with_closing_row(events: DataFrame, time_col: str = "t_us", at_us: int = END_OF_TIME_US) -> DataFrame:
    """A replayed stream that ends: one more row, with the time ``at_us`` and empty or zero values elsewhere, moves the watermark
    past all events, so that operators which hold rows until the watermark let
    all of them go. The replay must be one micro-batch (no limit per trigger),
    as the row comes with the first one and what came after it would be late. A live
    stream needs no such row; its next events move the watermark."""
    spark = events.sparkSession
    path = scratch_path(spark, "closing-row")
    row = [F.lit(at_us if f.name == time_col else "" if f.dataType.simpleString() == "string" else 0).cast(f.dataType).alias(f.name)
           for f in events.schema]
    spark.range(1).select(*row).write.parquet(path)
    return events.unionByName(spark.readStream.schema(events.schema).parquet(path))
