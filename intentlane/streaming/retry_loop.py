"""RTY-1..5 closed: failures go to a pending table, which a job drains when
they fall due, runs again and refills, until they succeed or die.

The pending table holds retry envelopes (the JSON that the retry topic carries)
in folders by writer and by the time they fall due, so a round reads only
the folders of the time that has passed since the round before it, and those
of new writers. Nothing is deleted or changed in place. A writer is a micro-batch of the main topic or
a round; it replaces its own folders if it is run again and then adds its
line to the log. A round takes the envelopes that have fallen due since the
round before, and all due ones of writers that no round has seen yet, so each
envelope is taken by exactly one round, also if writers and rounds overlap or
fail half way. The driver reads the log only: a line per writer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from intentlane import params as P
from intentlane.operators.retry import decode_envelopes, envelope, route_results

#: (event, user_id, attempt, last_error) -> the same with success and error
Process = Callable[[DataFrame], DataFrame]

BUCKET_MS = 60_000
PENDING = "key string, value string, next_retry_at_ms bigint, writer string, due bigint"
LOG = "writer string, round bigint, now_ms bigint, seen array<string>, n_retry bigint, first_due_ms bigint"
OUTCOME = "event string, user_id string, attempt int, last_error string, failed_at_ms bigint, source string, writer string"


class RetryLoop:
    def __init__(self, spark: SparkSession, base: str, process: Process, max_retries: int = P.MAX_RETRIES,
                 backoff_base: float = P.RETRY_BASE_SECONDS, backoff_cap: float = P.RETRY_MAX_SECONDS, bucket_ms: int = BUCKET_MS):
        self.spark, self.base, self.process = spark, base.rstrip("/"), process
        self.max_retries, self.backoff, self.bucket_ms = max_retries, (backoff_base, backoff_cap), bucket_ms

    # -- tables -------------------------------------------------------------------

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.base}/{name}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def pending(self) -> DataFrame:
        """All envelopes ever written, with writer and due time bucket."""
        return self._read("pending", PENDING)

    def outcome(self, route: str) -> DataFrame:
        """What has ended as ``done``, ``dead_letter`` or ``invalid``, by committed writers."""
        return self._read(route, OUTCOME).join(F.broadcast(self._read("log", LOG).select("writer")), "writer")

    def dead_letters(self) -> DataFrame:
        """SNK-2: (key, value) of the dead-letter topic, from committed writers."""
        return self.outcome("dead_letter").select(F.col("user_id").alias("key"), envelope("dead_letter").alias("value"))

    def log(self) -> list:
        """A line per committed writer: few, and read by the driver as a stream's metadata log is."""
        return self._read("log", LOG).collect()

    # -- writers ------------------------------------------------------------------

    def ingest(self, events: DataFrame, batch_id: int, now_ms: int) -> None:
        """RTY-1: run a micro-batch of the main topic, (event as JSON text,
        user_id), for the first time. Fits ``foreachBatch``."""
        first = events.select("event", "user_id", F.lit(0).alias("attempt"), F.lit(None).cast("string").alias("last_error"))
        self._commit(self._run(first), f"main-{batch_id}", None, now_ms, [])

    def drain(self, now_ms: int, round_id: int | None = None) -> dict:
        """RTY-3..5: one round at ``now_ms``; returns its log line. A round that
        failed is run again under its own ``round_id``."""
        log = self.log()
        done = {r["round"]: r for r in log if r["round"] is not None}
        number = round_id if round_id is not None else max(done, default=0) + 1
        before = [r for n, r in done.items() if n < number]
        if number in done and round_id is None:
            raise ValueError(f"round {number} is committed")
        last = max((r["now_ms"] for r in before), default=-1)
        now_ms = max(now_ms, last)
        seen = {w for r in before for w in r["seen"]}
        # a round that is run again sees what its first run saw
        fresh = sorted(done[number]["seen"] if number in done else {r["writer"] for r in log} - seen)
        due = self._due(now_ms, last, sorted(seen), fresh)
        envelopes = decode_envelopes(due.select("key", "value")).withColumn("user_id", F.coalesce("user_id", "key"))
        ok = F.col("status") == "ok"
        ran = self._run(envelopes.where(ok).select("event", "user_id", "attempt", "last_error"))
        bad = envelopes.where(~ok).select(F.lit("invalid").alias("route"), "event", "user_id", "attempt",
                                          F.lit(None).cast("bigint").alias("next_retry_at_ms"), F.lit(None).cast("bigint").alias("failed_at_ms"),
                                          "last_error", "source")
        return self._commit(ran, f"round-{number}", number, now_ms, fresh, bad)

    def run_until_empty(self, now_ms: int, max_rounds: int = 1_000) -> int:
        """Drain at each time at which something falls due; returns the rounds run."""
        for rounds in range(max_rounds):
            log = self.log()
            seen = {w for r in log for w in (r["seen"] or [])}
            last = max((r["now_ms"] for r in log if r["round"] is not None), default=-1)
            wake = [r["first_due_ms"] for r in log if r["writer"] not in seen and r["n_retry"]]
            old = [w for w in seen]
            later = self.pending().where(F.col("writer").isin(old) & (F.col("due") >= last // self.bucket_ms) & (F.col("next_retry_at_ms") > last))
            nearest = later.agg(F.min("next_retry_at_ms")).first()[0] if old else None
            wake += [nearest] if nearest is not None else []
            if not wake:
                return rounds
            self.drain(max(now_ms, min(wake)))
        return max_rounds

    # -- one run ------------------------------------------------------------------

    def _due(self, now_ms: int, last: int, seen: list[str], fresh: list[str]) -> DataFrame:
        """Envelopes of this round; both conditions prune folders."""
        upto = (F.col("due") <= now_ms // self.bucket_ms) & (F.col("next_retry_at_ms") <= now_ms)
        new = F.col("writer").isin(fresh)
        old = F.col("writer").isin(seen) & (F.col("due") >= last // self.bucket_ms) & (F.col("next_retry_at_ms") > last)
        return self.pending().where(upto & (new | old))

    def _run(self, events: DataFrame) -> DataFrame:
        return self.process(events)

    def _commit(self, results: DataFrame, writer: str, number: int | None, now_ms: int, seen: list[str], bad: DataFrame | None = None) -> dict:
        routed = route_results(results, now_ms, self.max_retries, *self.backoff, carry=("event",))
        if bad is not None:
            routed = routed.unionByName(bad.select(routed.columns))
        path = f"{self.base}/routed/writer={writer}"
        routed.write.mode("overwrite").parquet(path)       # run once: the process may be dear, and its outcome is one
        routed = self.spark.read.schema(routed.schema).parquet(path)
        retry = routed.where("route = 'retry'").select(
            F.col("user_id").alias("key"), envelope("retry").alias("value"), "next_retry_at_ms",
            F.floor(F.col("next_retry_at_ms") / F.lit(self.bucket_ms)).cast("bigint").alias("due"))
        retry.write.mode("overwrite").partitionBy("due").parquet(f"{self.base}/pending/writer={writer}")
        for route in ("done", "dead_letter", "invalid"):
            (routed.where(F.col("route") == route).select("event", "user_id", "attempt", "last_error", "failed_at_ms", "source")
             .write.mode("overwrite").parquet(f"{self.base}/{route}/writer={writer}"))
        sums = retry.agg(F.count(F.lit(1)).alias("n"), F.min("next_retry_at_ms").alias("first")).first()
        line = {"writer": writer, "round": number, "now_ms": now_ms, "seen": seen, "n_retry": sums["n"], "first_due_ms": sums["first"]}
        cols = [c.split()[0] for c in LOG.split(", ")]
        (self.spark.createDataFrame([tuple(line[c] for c in cols)], LOG).drop("writer").coalesce(1)
         .write.mode("overwrite").parquet(f"{self.base}/log/writer={writer}"))
        return line


def event_json(*cols: str | Column) -> Column:
    """The event object of an envelope from columns."""
    return F.to_json(F.struct(*cols))


def start_main_topic(events: DataFrame, loop: RetryLoop, checkpoint: str, now_ms: int | None = None):
    """The main topic as a stream: every micro-batch runs once and feeds the loop."""
    import time

    def run(batch: DataFrame, batch_id: int) -> None:
        loop.ingest(batch, batch_id, now_ms if now_ms is not None else int(time.time() * 1000))
    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
