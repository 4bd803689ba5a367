"""GOV-1..7: message limit check (as-of), send log, check-then-record gate,
compound cap, action logs and the message length rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intentlane import params as P
from intentlane.functions.text import is_blank
from intentlane.operators.asof import prev_within
from intentlane.operators.folds import compound_cap, greedy_cooldown


def message_limit_check(requests: DataFrame, sends: DataFrame, period_us: int = P.MESSAGE_LIMIT_US,
                        t_col: str = "t_us") -> DataFrame:
    """GOV-1: blank user -> (false, missing_user_id); a send at s blocks
    requests in [s, s + period) -> (false, limit_reached, ttl_seconds, the
    store's rounding of the remaining milliseconds); else allowed."""
    ok_user = ~is_blank(F.col("user_id"))
    valid = requests.filter(ok_user)
    checked = prev_within(valid, sends.filter(~is_blank(F.col("user_id"))), ["user_id"], t_col,
                          period_us, out_col="_last_send")
    blank = requests.filter(~ok_user).withColumn("_last_send", F.lit(None).cast("long"))
    both = checked.unionByName(blank.select(*checked.columns))
    remaining_ms = F.floor((F.col("_last_send") + F.lit(period_us) - F.col(t_col)) / 1000)
    return both.select(
        *requests.columns,
        (ok_user & F.col("_last_send").isNull()).alias("allowed"),
        F.when(~ok_user, F.lit("missing_user_id"))
        .when(F.col("_last_send").isNotNull(), F.lit("limit_reached")).alias("reason"),
        F.when(ok_user & F.col("_last_send").isNotNull(),
               F.floor((remaining_ms + 500) / 1000)).cast("long").alias("ttl_seconds"))


def last_message_sent(sends: DataFrame, period_us: int = P.MESSAGE_LIMIT_US,
                      t_col: str = "t_us") -> DataFrame:
    """GOV-2: the last send per user restarts the period (last write wins);
    blank users are reported with status 'error'. Partial aggregation."""
    ok = sends.filter(~is_blank(F.col("user_id")))
    agg = ok.groupBy("user_id").agg(F.max(t_col).alias("last_sent_us"),
                                    F.count(F.lit(1)).alias("n_sends"))
    good = agg.select("user_id", "last_sent_us",
                      (F.col("last_sent_us") + F.lit(period_us)).alias("expires_at_us"),
                      "n_sends", F.lit("success").alias("status"))
    # a send record without a user is rejected, one error row per record
    bad = sends.filter(is_blank(F.col("user_id"))).select(
        "user_id", F.lit(None).cast("long").alias("last_sent_us"),
        F.lit(None).cast("long").alias("expires_at_us"), F.lit(None).cast("long").alias("n_sends"),
        F.lit("error").alias("status"))
    return good.unionByName(bad)


def send_gate(requests: DataFrame, period_us: int = P.MESSAGE_LIMIT_US, t_col: str = "t_us",
              tie_col: str = "event_id") -> DataFrame:
    """GOV-3: check-then-record over a stream of attempts: an allowed attempt
    becomes a send and blocks the period after it (the greedy cooldown)."""
    return greedy_cooldown(requests, ["user_id"], t_col, tie_col, period_us, mark_col="allowed")


def compound_gate(requests: DataFrame, gap_us: int = P.COMPOUND_GAP_US,
                  window_us: int = P.COMPOUND_WINDOW_US,
                  max_in_window: int = P.COMPOUND_MAX_IN_WINDOW, t_col: str = "t_us",
                  tie_col: str = "event_id", strict_more_than: bool = True) -> DataFrame:
    """GOV-4: skip when a message was sent in the last ``gap`` or more than
    ``max_in_window`` in the last ``window``; counts sent messages only."""
    return compound_cap(requests, ["user_id"], t_col, tie_col, gap_us, window_us, max_in_window,
                        strict_more_than)


def action_log(actions: DataFrame) -> DataFrame:
    """GOV-5 / GOV-6: validate send and skip actions into log rows.

    ``actions``: kind ('sms' | 'skip'), user_id, phone, message, reason,
    t_us. Sends need user, phone and message; skips need user and reason."""
    sms = F.col("kind") == "sms"
    ok_sms = ~is_blank(F.col("user_id")) & ~is_blank(F.col("phone")) & ~is_blank(F.col("message"))
    ok_skip = ~is_blank(F.col("user_id")) & ~is_blank(F.col("reason"))
    ok = F.when(sms, ok_sms).otherwise(ok_skip)
    others = [c for c in actions.columns if c not in ("kind", "phone", "message", "reason")]
    return actions.select(
        *others,
        F.when(sms, F.lit(P.ACTION_SMS)).otherwise(F.lit(P.ACTION_SKIP)).alias("action"),
        ok.alias("success"),
        F.when(sms, F.col("phone")).alias("phone"),
        F.when(sms, F.col("message")).alias("message"),
        F.when(~sms, F.col("reason")).alias("reason"),
        F.when(~ok, F.lit("INVALID_TOOL_INPUT")).alias("error"))


def message_length_check(messages: DataFrame, text_col: str = "content",
                         max_chars: int = P.MESSAGE_MAX_CHARS) -> DataFrame:
    """GOV-7: at most ``max_chars`` characters (code points)."""
    n = F.char_length(F.col(text_col))
    return messages.withColumn("n_chars", n).withColumn("ok", n <= max_chars)
