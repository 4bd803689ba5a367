"""RTY-1..5: failure routing with exponential backoff, as column logic over
result tables (narrow: no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intentlane import params as P


def backoff_seconds(attempt: Column, base: float = P.RETRY_BASE_SECONDS,
                    cap: float = P.RETRY_MAX_SECONDS) -> Column:
    """RTY-2: attempt <= 0 -> 0; else min(cap, base * 2^(attempt - 1))."""
    return (F.when(attempt <= 0, F.lit(0.0))
            .otherwise(F.least(F.lit(float(cap)), F.lit(float(base)) * F.pow(F.lit(2.0), attempt - 1))))


def route_results(results: DataFrame, now_ms: int, max_retries: int = P.MAX_RETRIES,
                  base: float = P.RETRY_BASE_SECONDS, cap: float = P.RETRY_MAX_SECONDS,
                  carry: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """RTY-1 / RTY-4 / RTY-5: one route per result row.

    results: user_id (the event), attempt (0 = main topic), success, error and,
    optionally, last_error of the envelope, kept when the new error is empty;
    the columns ``carry`` go along.
    Routes: invalid (no event: dropped, counted as consumed), done, retry
    (attempt + 1, next_retry_at = now + backoff, source 'main' on the first
    retry), dead_letter (attempt + 1 > max_retries; failed_at = now, source
    'retry')."""
    attempt = F.coalesce(F.col("attempt"), F.lit(0))
    new_attempt = attempt + 1
    invalid = F.col("user_id").isNull()
    done = F.coalesce(F.col("success"), F.lit(False))
    dead = (new_attempt > max_retries) & (attempt > 0)     # a main-topic failure is always retried once
    before = F.col("last_error") if "last_error" in results.columns else F.lit(None).cast("string")
    text = F.coalesce(F.nullif(F.col("error"), F.lit("")), F.nullif(before, F.lit("")), F.lit("unknown"))
    route = (F.when(invalid, F.lit("invalid")).when(done, F.lit("done"))
             .when(dead, F.lit("dead_letter")).otherwise(F.lit("retry")))
    delay_ms = (backoff_seconds(new_attempt, base, cap) * 1000).cast("long")
    return results.select(
        *carry, "user_id", route.alias("route"),
        F.when(invalid | done, attempt).otherwise(new_attempt).alias("attempt"),
        F.when(route == "retry", F.lit(now_ms) + delay_ms).alias("next_retry_at_ms"),
        F.when(route == "dead_letter", F.lit(now_ms)).alias("failed_at_ms"),
        F.when(route.isin("retry", "dead_letter"), text).alias("last_error"),
        F.when(route == "dead_letter", F.lit("retry"))
        .when((route == "retry") & (attempt == 0), F.lit("main")).alias("source"))


def due(pending: DataFrame, now_ms: int, next_col: str = "next_retry_at_ms") -> DataFrame:
    """RTY-3: NULL next_retry_at counts as 0; due when <= now. Rows not yet
    due stay pending (head-of-line blocking is not reproduced)."""
    return pending.withColumn("due", F.coalesce(F.col(next_col), F.lit(0)) <= F.lit(now_ms))


def envelope(route: str) -> Column:
    """SNK-2: the JSON envelope of a routed row whose ``event`` is JSON text,
    which goes in as it is. ``retry`` or ``dead_letter``."""
    names = {"retry": ("attempt", "next_retry_at", "last_error", "source"),
             "dead_letter": ("attempt", "failed_at", "last_error", "source")}[route]
    source = {"next_retry_at": "next_retry_at_ms", "failed_at": "failed_at_ms"}
    rest = F.to_json(F.struct(*[F.col(source.get(n, n)).alias(n) for n in names]))
    return F.concat(F.lit('{"event":'), F.col("event"), F.lit(","), F.substring(rest, 2, 1 << 30))


def decode_envelopes(raw: DataFrame, value_col: str = "value") -> DataFrame:
    """RTY-5: retry-topic envelopes from JSON text. ``status`` is 'ok', or
    'invalid' (unparsable JSON, or ``event`` missing / not an object): such
    messages are dropped and counted as consumed. Columns: event (JSON text
    of the event object), user_id, attempt (NULL -> 0), next_retry_at_ms
    (NULL -> 0), last_error, source, status."""
    v = F.try_parse_json(F.col(value_col))
    ev = F.try_variant_get(v, "$.event", "variant")
    is_obj = F.coalesce(F.schema_of_variant(ev).startswith("OBJECT"), F.lit(False))
    ok = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)) & is_obj
    text = F.from_json(F.col(value_col), "event string")["event"]     # the object as it was written
    others = [c for c in raw.columns if c != value_col]
    return raw.select(
        *others,
        F.when(ok, text).alias("event"),
        F.when(ok, F.coalesce(F.try_variant_get(ev, "$.user_id", "string"),
                              F.try_variant_get(ev, "$.userId", "string"))).alias("user_id"),
        F.when(ok, F.coalesce(F.try_variant_get(v, "$.attempt", "int"), F.lit(0))).alias("attempt"),
        F.when(ok, F.coalesce(F.try_variant_get(v, "$.next_retry_at", "long"), F.lit(0)))
        .alias("next_retry_at_ms"),
        F.when(ok, F.try_variant_get(v, "$.last_error", "string")).alias("last_error"),
        F.when(ok, F.try_variant_get(v, "$.source", "string")).alias("source"),
        F.when(ok, F.lit("ok")).otherwise(F.lit("invalid")).alias("status"))
