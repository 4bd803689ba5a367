"""SNK-1..4: writers. Every write goes to a new directory (never over the
path being read) and returns that path; callers switch readers to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert_vectors(vectors: DataFrame, path: str, existing_path: str | None = None,
                   key: str = "id") -> str:
    """SNK-4: keyed upsert of (id, document, metadata, embedding) into a new
    version directory; rows of the new batch replace rows of the same id."""
    out = vectors
    if existing_path is not None:
        old = vectors.sparkSession.read.parquet(existing_path)
        out = old.join(vectors.select(key), key, "left_anti").unionByName(vectors)
    out.write.mode("errorifexists").parquet(path)
    return path


def write_snapshot(snapshot: DataFrame, path: str) -> str:
    """SNK-3: one document per user, keyed; a full rebuild is a new version."""
    snapshot.write.mode("errorifexists").parquet(path)
    return path


def intents_to_wire(intents: DataFrame) -> DataFrame:
    """SNK-1 payload: key = user id, value = JSON of the promotion."""
    return intents.select(
        F.col("user_id").cast("string").alias("key"),
        F.to_json(F.struct(
            F.col("user_id").alias("userId"), F.col("event_type").alias("eventType"),
            "reason", "context", F.col("event_time_us").alias("timestamp"))).alias("value"))


def write_stream_sink(df: DataFrame, fmt: str, checkpoint: str, **options):
    """SNK-1/SNK-2 for streams: Kafka (``fmt='kafka'``, needs the connector
    jar) or any file format; the checkpoint makes offsets and state commit
    together."""
    w = df.writeStream.format(fmt).option("checkpointLocation", checkpoint)
    for k, v in options.items():
        w = w.option(k, v)
    return w


def retry_envelopes(routed: DataFrame, events: DataFrame, key: str = "event_id") -> DataFrame:
    """SNK-2 payloads: ``routed`` (output of ``route_results``) joined back to
    the original ``events`` rows, as JSON envelopes per route: retry ->
    {event, attempt, next_retry_at, last_error[, source]}; dead letter ->
    {event, attempt, failed_at, last_error, source}. Columns: route, key,
    value."""
    ev = events.select(key, F.struct(*[c for c in events.columns]).alias("event"))
    j = routed.filter(F.col("route").isin("retry", "dead_letter")).join(ev, key)
    retry = F.to_json(F.struct("event", "attempt", F.col("next_retry_at_ms").alias("next_retry_at"),
                               "last_error", "source"))
    dead = F.to_json(F.struct("event", "attempt", F.col("failed_at_ms").alias("failed_at"),
                              "last_error", "source"))
    return j.select("route", F.col("user_id").cast("string").alias("key"),
                    F.when(F.col("route") == "retry", retry).otherwise(dead).alias("value"))


def kafka_intent_sink(intents: DataFrame, servers: str, checkpoint: str,
                      topic: str | None = None):
    """SNK-1: promotions keyed by user id (per-user order within a partition)
    to the intent topic with the producer settings of the reference (acks
    all, 3 retries, 10 ms linger, 16 KiB batches). The query checkpoint
    commits offsets and state together; delivery is at least once, so
    consumers de-duplicate on (user_id, event time). Needs the Kafka
    connector on the classpath."""
    from intentlane import params as P
    return write_stream_sink(
        intents_to_wire(intents), "kafka", checkpoint,
        **{"kafka.bootstrap.servers": servers, "topic": topic or P.TOPIC_INTENT,
           "kafka.acks": P.PRODUCER_ACKS, "kafka.retries": str(P.PRODUCER_RETRIES),
           "kafka.linger.ms": str(P.PRODUCER_LINGER_MS),
           "kafka.batch.size": str(P.PRODUCER_BATCH_BYTES)})
