"""Parameters.

The FIXED VALUES block holds constants that must equal the reference's for
identical results; everything else is a job parameter with a default.
"""

from __future__ import annotations

from dataclasses import dataclass

US_PER_SECOND = 1_000_000
US_PER_MINUTE = 60 * US_PER_SECOND
US_PER_HOUR = 60 * US_PER_MINUTE
US_PER_DAY = 24 * US_PER_HOUR

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reference)
# ---------------------------------------------------------------------------
WINDOW_US = 5 * US_PER_MINUTE            # sliding window of the intent detector
THRESHOLD = 10                           # events in the window that qualify
COOLDOWN_US = 1 * US_PER_HOUR            # lock after a promotion
MESSAGE_LIMIT_US = 30 * US_PER_MINUTE    # message limit period
ACTIVITY_LOOKBACK_US = 30 * US_PER_DAY   # recent activity horizon
COMPOUND_GAP_US = 1 * US_PER_HOUR        # "sent in the last hour" rule
COMPOUND_WINDOW_US = 24 * US_PER_HOUR    # "more than 3 in 24 hours" rule
COMPOUND_MAX_IN_WINDOW = 3
RETRY_BASE_SECONDS = 1.0
RETRY_MAX_SECONDS = 60.0
MAX_RETRIES = 3
SEARCH_K = 3
RECALL_FACTOR = 3
MESSAGE_MAX_CHARS = 70
INTENT_EVENT_TYPE = "high_interest_detected"
INTENT_REASON = "clicked_10_times_in_5min"
DEFAULT_INTENT_TYPE = "HIGH_INTENT"
CONTEXT_DEFAULT_ACTION = "unknown"
CONTEXT_DEFAULT_SKU = "unknown"
CONTEXT_DEFAULT_PRICE = 0.0
DEFAULT_SCRIPT_SCENARIO = "general"
PRICE_TIER_AFFORDABLE = "便宜 Affordable"
PRICE_TIER_STANDARD = "性价比 Standard"
PRICE_TIER_EXPENSIVE = "昂贵 Expensive"
PRICE_TIER_MODERATE = "中等 Moderate"
FLAG_NEW = " 新品 New"
FLAG_LIMITED = " 限量 Limited"
FLAG_SALE = " 特价 Sale"
PRODUCT_DOC_TEMPLATE = "分类: %s. 商品: %s. 价格等级: %s. 特点: %s. 描述: %s"
SCRIPT_DOC_TEMPLATE = "场景: %s. 内容: %s"
SCENARIO_BY_EVENT = {
    "view_item": "browse",
    "high_interest_detected": "browse",
    "add_to_cart": "cart",
    "cart_abandon": "cart",
    "purchase": "purchase",
}
CART_SCRIPT_SCENARIOS = ("cart_abandon", "price_drop")
CONTEXT_TEXT_LABELS = ("用户ID: ", "姓名: ", "消费等级: ", "标签: ", "近期活动: ")
CONTEXT_TEXT_MISSING = "未找到用户 %s 的信息"
SEARCH_TEXT_LABELS = ("商品 ", "- 名称: ", "- 分类: ", "- 价格: ", "- 卖点: ")
SEARCH_TEXT_MISSING = "未找到与 '%s' 相关的商品"
ACTION_SMS = "SMS_SENT"
ACTION_SKIP = "SKIP_MARKETING"
TOPIC_BEHAVIOR = "behavior-normal"
TOPIC_INTENT = "intent-high"
TOPIC_RETRY = "intent-high-retry"
TOPIC_DEAD_LETTER = "intent-high-dlq"
PRODUCER_ACKS = "all"
PRODUCER_RETRIES = 3
PRODUCER_LINGER_MS = 10
PRODUCER_BATCH_BYTES = 16384
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class IntentParams:
    window_us: int = WINDOW_US
    threshold: int = THRESHOLD
    cooldown_us: int = COOLDOWN_US
    event_type: str = INTENT_EVENT_TYPE
    reason: str = INTENT_REASON


# Scaled parameters used on the driver's tables: the reference defaults give
# zero promotions there (the densest five minutes hold three events).
TEST_INTENT = IntentParams(window_us=1 * US_PER_DAY, threshold=3, cooldown_us=3 * US_PER_DAY)
TEST_AS_OF = "2024-01-31 00:00:00"
TEST_AS_OF_US = 1706659200 * US_PER_SECOND
TEST_ACTIVITY_LOOKBACK_US = 7 * US_PER_DAY
TEST_MESSAGE_LIMIT_US = 12 * US_PER_HOUR
TEST_COMPOUND_GAP_US = 4 * US_PER_HOUR
TEST_COMPOUND_WINDOW_US = 4 * US_PER_DAY
TEST_MESSAGE_MAX_CHARS = 200             # the fixture's shortest script has 95
TEST_CART_TIMEOUT_US = 2 * US_PER_DAY
TEST_REALTIME_HORIZON_US = 1 * US_PER_DAY
TEST_NOW_MS = 1705276800000              # 2024-01-15 00:00:00 UTC, for retry jobs
