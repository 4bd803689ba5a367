"""RTY-1/4/5 on a stream: ``foreachBatch`` routes each micro-batch of results
into done / retry / dead-letter / invalid outputs.

The batch is persisted once and split by route; every output is written to
``<base>/<route>/batch=<id>`` with overwrite, so a replayed batch (the sink
is at-least-once) rewrites the same files instead of duplicating them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intentlane import params as P
from intentlane.operators.retry import route_results

ROUTES = ("done", "retry", "dead_letter", "invalid")


def route_batch(base: str, now_ms: int | None = None, max_retries: int = P.MAX_RETRIES):
    """A ``foreachBatch`` function. ``now_ms`` None = the batch's wall clock."""

    def run(batch: DataFrame, batch_id: int) -> None:
        now = now_ms
        if now is None:
            import time
            now = int(time.time() * 1000)
        routed = route_results(batch, now, max_retries).persist()
        try:
            for r in ROUTES:
                (routed.filter(F.col("route") == r).write.mode("overwrite")
                 .parquet(f"{base}/{r}/batch={batch_id}"))
        finally:
            routed.unpersist()

    return run


def start_retry_router(results: DataFrame, base: str, checkpoint: str,
                       now_ms: int | None = None, available_now: bool = True):
    w = results.writeStream.foreachBatch(route_batch(base, now_ms)).option(
        "checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()
