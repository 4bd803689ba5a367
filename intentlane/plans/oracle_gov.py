"""DuckDB oracles for governance, decision, retry, audit and document-only keys."""

from __future__ import annotations

from intentlane import params as P
from intentlane.plans.oracle import _greedy_ctes, _tags, _uid, high_intent_ctes
from intentlane.plans.oracle_catalog import CATALOG_CTE, RERANK, knn_ctes, score
from intentlane.plans.oracle_views import with_views

ORACLE: dict[str, str] = {}

LIM = P.TEST_MESSAGE_LIMIT_US
REQ = ("r", "SELECT event_id, user_id, epoch_us(ts) AS t_us FROM v_requests")
SND = ("s", "SELECT user_id, epoch_us(ts) AS t_us FROM v_sends")
BT = ("bt", "SELECT *, epoch_us(event_time) AS t_us FROM v_behavior")


def _limit_ctes(req: str) -> list[tuple[str, str]]:
    return [("lim", f"""SELECT q.*, CASE WHEN s.t_us > q.t_us - {LIM} THEN s.t_us END AS last_send
FROM {req} q ASOF LEFT JOIN s ON q.user_id = s.user_id AND q.t_us >= s.t_us""")]


ORACLE["message_limit_check"] = with_views(["v_requests", "v_sends"], [REQ, SND] + _limit_ctes("r"), f"""
SELECT event_id, user_id, last_send IS NULL AS allowed,
  CASE WHEN last_send IS NOT NULL THEN 'limit_reached' END AS reason,
  CAST(floor((floor((last_send + {LIM} - t_us) / 1000.0) + 500) / 1000.0) AS DOUBLE) AS ttl_seconds
FROM lim""")

ORACLE["last_message_sent"] = with_views(["v_sends"], [SND], f"""
SELECT user_id, max(t_us) AS last_sent_us, max(t_us) + {LIM} AS expires_at_us, count(*) AS n_sends,
  'success' AS status FROM s WHERE user_id IS NOT NULL AND trim(user_id) <> '' GROUP BY user_id
UNION ALL
SELECT user_id, NULL, NULL, NULL, 'error' FROM s WHERE user_id IS NULL OR trim(user_id) = ''""")

ORACLE["send_gate"] = with_views(["v_requests"], [REQ] + _greedy_ctes("r", LIM, "g"), """
SELECT q.event_id, q.user_id, q.t_us, f.rk IS NOT NULL AS allowed
FROM g_q q LEFT JOIN g_fires f ON f.user_id = q.user_id AND f.rk = q.rk""", recursive=True)

GAP, WIN, CAP = P.TEST_COMPOUND_GAP_US, P.TEST_COMPOUND_WINDOW_US, P.COMPOUND_MAX_IN_WINDOW
ORACLE["compound_cap"] = with_views(["v_behavior"], [
    BT,
    ("rq", "SELECT event_id, user_id, t_us, row_number() OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS rk FROM bt"),
    ("walk", f"""SELECT user_id, rk, event_id, true AS allowed, [t_us] AS sends, t_us AS last_send FROM rq WHERE rk = 1
  UNION ALL
  SELECT user_id, rk, event_id, ok, CASE WHEN ok THEN list_append(kept, t_us) ELSE kept END,
         CASE WHEN ok THEN t_us ELSE last_send END
  FROM (SELECT q.user_id, q.rk, q.event_id, q.t_us, w.last_send,
               list_filter(w.sends, lambda x: x > q.t_us - {WIN}) AS kept,
               (w.last_send IS NULL OR w.last_send <= q.t_us - {GAP})
                 AND len(list_filter(w.sends, lambda x: x > q.t_us - {WIN})) <= {CAP} AS ok
        FROM walk w JOIN rq q ON q.user_id = w.user_id AND q.rk = w.rk + 1)""")],
    "SELECT event_id, user_id, allowed FROM walk", recursive=True)

ORACLE["action_log"] = with_views(["v_behavior", "v_users"], [BT, (
    "a", """SELECT b.event_id, b.user_id, b.t_us,
  CASE WHEN b.action = 'search' THEN 'skip' ELSE 'sms' END AS kind,
  CASE WHEN u.id % 13 = 0 THEN '' ELSE '1' || lpad(CAST(u.id AS VARCHAR), 10, '0') END AS phone,
  CASE WHEN b.event_id % 17 = 0 THEN ' ' ELSE 'Offer for ' || u.name END AS message,
  CASE WHEN b.event_id % 19 = 0 THEN '' ELSE 'browse_only' END AS reason
FROM bt b LEFT JOIN v_users u ON u.id = CAST(b.user_id AS BIGINT)
WHERE b.action IN ('purchase', 'add_to_cart', 'search')"""), (
    "v", """SELECT *, CASE WHEN kind = 'sms' THEN
    coalesce(trim(user_id) <> '' AND trim(phone) <> '' AND trim(message) <> '', false)
  ELSE coalesce(trim(user_id) <> '' AND trim(reason) <> '', false) END AS ok FROM a""")], f"""
SELECT event_id, user_id, t_us, CASE WHEN kind = 'sms' THEN '{P.ACTION_SMS}' ELSE '{P.ACTION_SKIP}' END AS action,
  ok AS success, CASE WHEN kind = 'sms' THEN phone END AS phone, CASE WHEN kind = 'sms' THEN message END AS message,
  CASE WHEN kind <> 'sms' THEN reason END AS reason, CASE WHEN NOT ok THEN 'INVALID_TOOL_INPUT' END AS error
FROM v""")

ORACLE["message_length_check"] = with_views(["v_scripts"], [], f"""
SELECT id, length(content) AS n_chars, length(content) <= {P.MESSAGE_MAX_CHARS} AS ok FROM v_scripts""")


def route_sql(col: str) -> str:
    whens = " ".join(f"WHEN {col} = '{e}' THEN '{s}'" for e, s in P.SCENARIO_BY_EVENT.items())
    return f"CASE {whens} ELSE 'unrouted' END"


ORACLE["scenario_routing"] = with_views(["v_behavior"], [], f"""
SELECT event_id, user_id, action, {route_sql('action')} AS scenario FROM v_behavior""")


def seg_list(tier: str, tags: str) -> str:
    return (f"list_filter([CASE WHEN {tier} = 'HIGH' THEN 'premium' END, "
            f"CASE WHEN list_contains({tags}, 'price_sensitive') THEN 'value' END, "
            f"CASE WHEN list_contains({tags}, 'new_user') THEN 'welcome' END, "
            f"CASE WHEN list_contains({tags}, 'vip') THEN 'member' END], lambda x: x IS NOT NULL)")


UT = ("ut", f"SELECT id, spending_tier, coalesce({_tags('identity_tags')}, CAST([] AS VARCHAR[])) AS tags FROM v_users")

ORACLE["offer_segments"] = with_views(["v_users"], [UT, ("sg", f"SELECT id, {seg_list('spending_tier', 'tags')} AS segs FROM ut")], """
SELECT id, array_to_string(segs, ',') AS segments, coalesce(segs[1], 'standard') AS primary_segment FROM sg""")

ORACLE["eligible_offers"] = with_views(["v_users", "v_products"], [
    ("tiers", "SELECT DISTINCT spending_tier FROM v_users")], """
SELECT t.spending_tier, p.sku_id, CAST(p.price AS DOUBLE) AS price,
  t.spending_tier = 'HIGH' AND coalesce(p.price, 0.0) > 500 AS preferred
FROM v_products p JOIN tiers t ON t.spending_tier <> 'HIGH' OR coalesce(p.price, 0.0) >= 100""")

_BY_PRODUCT = "scenario IN ('browse', 'purchase')"
ORACLE["campaign_decision"] = with_views(
    ["v_behavior", "v_users", "v_products", "v_scripts", "v_sends", "v_index"], high_intent_ctes() + [
        SND, UT, CATALOG_CTE,
        ("x", f"""SELECT h.event_id, h.user_id, h.event_time_us AS t_us, h.sku_id, u.spending_tier,
  CASE WHEN {route_sql('h.last_action')} <> 'unrouted' THEN {route_sql('h.last_action')}
       ELSE {route_sql('h.event_type')} END AS scenario,
  coalesce({seg_list('u.spending_tier', 'u.tags')}[1], 'standard') AS segment
FROM hi h LEFT JOIN ut u ON u.id = {_uid('h.user_id')}"""),
        ("live", f"""SELECT i.id, i.embedding, c.document AS query_text FROM v_index i
JOIN cat c ON c.id = 'sku_' || CAST(i.id AS VARCHAR)
WHERE 'sku_' || CAST(i.id AS VARCHAR) IN (SELECT sku_id FROM x WHERE {_BY_PRODUCT})""")]
    + knn_ctes("live", "v_index", P.SEARCH_K * P.RECALL_FACTOR) + [
        ("scored", f"""SELECT h.query_id, h.id, h.rank AS recall_rank, c.m_product_id AS product_id,
  {score('q.query_text', 'c.document')} AS score
FROM hits h JOIN live q ON q.id = h.query_id LEFT JOIN cat c ON c.id = 'sku_' || CAST(h.id AS VARCHAR)"""),
        RERANK,
        ("offer", f"""SELECT 'sku_' || CAST(r.query_id AS VARCHAR) AS sku_id, r.new_rank, r.product_id,
  coalesce(p.price, 0.0) AS price FROM rr r JOIN v_products p ON p.sku_id = r.product_id
WHERE r.new_rank <= {P.SEARCH_K} AND p.stock > 0 AND r.product_id <> 'sku_' || CAST(r.query_id AS VARCHAR)"""),
        ("best", """SELECT x.event_id, arg_min(o.product_id,
    (CASE WHEN x.spending_tier = 'HIGH' AND o.price > 500 THEN 0 ELSE 1 END, o.new_rank)) AS product_id
FROM x JOIN offer o ON o.sku_id = x.sku_id AND (x.spending_tier IS NULL OR x.spending_tier <> 'HIGH' OR o.price >= 100)
GROUP BY x.event_id"""),
        ("script", f"""SELECT sku_id, arg_min(sid, (pos, d, sid)) AS script_id FROM (
  SELECT 'sku_' || CAST(q.id AS VARCHAR) AS sku_id, sc.id AS sid,
    CASE sc.scenario WHEN 'cart_abandon' THEN 0 ELSE 1 END AS pos,
    round(1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) AS d
  FROM v_scripts sc JOIN v_index v ON v.id = sc.id
  JOIN v_index q ON 'sku_' || CAST(q.id AS VARCHAR) IN (SELECT sku_id FROM x WHERE scenario = 'cart')
  WHERE sc.scenario IN ('cart_abandon', 'price_drop') AND sc.content IS NOT NULL AND trim(sc.content) <> ''
    AND length(sc.content) <= {P.TEST_MESSAGE_MAX_CHARS}) GROUP BY sku_id"""),
        ("y", f"""SELECT x.*, CASE WHEN {_BY_PRODUCT} THEN 'sku:' || b.product_id
      WHEN scenario = 'cart' THEN 'script:' || CAST(s.script_id AS VARCHAR) END AS content,
  CASE WHEN spending_tier IS NULL THEN 'no_profile' WHEN scenario = 'unrouted' THEN 'unrouted_event' END AS early
FROM x LEFT JOIN best b ON b.event_id = x.event_id LEFT JOIN script s ON s.sku_id = x.sku_id"""),
        ("items", """SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t_us, NOT logged, event_id) AS rk FROM (
  SELECT event_id, user_id, t_us, false AS logged, early IS NULL AND scenario IN ('cart', 'purchase') AS governed,
    early IS NULL AND content IS NOT NULL AS can_send FROM y
  UNION ALL SELECT NULL, user_id, t_us, true, true, true FROM s WHERE user_id IN (SELECT user_id FROM y))"""),
        ("walk", f"""SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS rk, CAST(NULL AS BIGINT) AS event_id, '' AS verdict,
    CAST([] AS BIGINT[]) AS sends, CAST(NULL AS BIGINT) AS last_gov FROM items
  UNION ALL
  SELECT user_id, rk, event_id, verdict, CASE WHEN verdict = 'sent' THEN list_append(sends, t_us) ELSE sends END,
    CASE WHEN verdict = 'sent' AND governed THEN t_us ELSE last_gov END
  FROM (SELECT q.*, w.sends, w.last_gov, CASE WHEN q.logged THEN 'sent'
      WHEN q.governed AND w.last_gov > q.t_us - {LIM} THEN 'limit_reached'
      WHEN NOT q.can_send THEN 'held'
      WHEN len(list_filter(w.sends, lambda z: z > q.t_us - {GAP})) > 0
        OR len(list_filter(w.sends, lambda z: z > q.t_us - {WIN})) > {CAP} THEN 'frequency_cap'
      ELSE 'sent' END AS verdict
    FROM walk w JOIN items q ON q.user_id = w.user_id AND q.rk = w.rk + 1)""")], """
SELECT y.event_id, y.user_id, y.scenario, y.segment, CASE WHEN w.verdict = 'sent' THEN 'SEND' ELSE 'SKIP' END AS action,
  coalesce(y.early, CASE w.verdict WHEN 'held' THEN 'no_content' WHEN 'sent' THEN NULL ELSE w.verdict END) AS reason,
  CASE WHEN w.verdict = 'sent' THEN y.content END AS content, true AS success
FROM y JOIN walk w ON w.event_id = y.event_id""", recursive=True)


ORACLE["campaign_decision_stream"] = ORACLE["campaign_decision"]


def backoff(att: str) -> str:
    return (f"CASE WHEN {att} <= 0 THEN 0.0 ELSE least({P.RETRY_MAX_SECONDS}, "
            f"{P.RETRY_BASE_SECONDS} * pow(2.0, {att} - 1)) END")


NOW = P.TEST_NOW_MS
ORACLE["retry_routing"] = with_views(["v_results"], [("rt", f"""SELECT *, coalesce(attempt, 0) AS a,
  CASE WHEN user_id IS NULL THEN 'invalid' WHEN coalesce(success, false) THEN 'done'
       WHEN coalesce(attempt, 0) + 1 > {P.MAX_RETRIES} THEN 'dead_letter' ELSE 'retry' END AS route
FROM v_results""")], f"""
SELECT event_id, user_id, route, CAST(CASE WHEN route IN ('invalid', 'done') THEN a ELSE a + 1 END AS INTEGER) AS attempt,
  CAST(CASE WHEN route = 'retry' THEN {NOW} + CAST({backoff('a + 1')} * 1000 AS BIGINT) END AS DOUBLE) AS next_retry_at_ms,
  CAST(CASE WHEN route = 'dead_letter' THEN {NOW} END AS DOUBLE) AS failed_at_ms,
  CASE WHEN route IN ('retry', 'dead_letter') THEN coalesce(error, 'unknown') END AS last_error,
  CASE WHEN route = 'dead_letter' THEN 'retry' WHEN route = 'retry' AND a = 0 THEN 'main' END AS source
FROM rt""")

ORACLE["retry_backoff"] = with_views(["v_results"], [], f"""
SELECT event_id, attempt, {backoff('attempt')} AS backoff_seconds FROM v_results""")

ORACLE["retry_loop"] = f"""
WITH e AS (SELECT *, CAST(event_id % 6 AS INTEGER) AS fails FROM events)
SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, event_type, value,
  CASE WHEN fails <= {P.MAX_RETRIES} THEN 'done' ELSE 'dead_letter' END AS route,
  CAST(CASE WHEN fails <= {P.MAX_RETRIES} THEN fails ELSE {P.MAX_RETRIES} + 1 END AS INTEGER) AS attempt,
  CASE WHEN fails > {P.MAX_RETRIES} THEN 'boom {P.MAX_RETRIES}' END AS last_error,
  CASE WHEN fails > {P.MAX_RETRIES} THEN CAST({P.TEST_NOW_MS} + 1000 + 2000 + 4000 AS DOUBLE) END AS failed_at_ms,
  CASE WHEN fails > {P.MAX_RETRIES} THEN 'retry' END AS source
FROM e"""

ORACLE["retry_due"] = with_views(["v_results"], [("p", f"""SELECT event_id,
  CAST(floor(epoch_us(ts) / 1000.0) AS BIGINT) + CAST({backoff('attempt')} * 1000 AS BIGINT) AS next_retry_at_ms
FROM v_results""")], f"SELECT event_id, next_retry_at_ms, coalesce(next_retry_at_ms, 0) <= {NOW} AS due FROM p")

ORACLE["promotion_audit"] = with_views(["v_behavior", "v_users"], high_intent_ctes() + [
    ("per", "SELECT CAST(user_id AS BIGINT) AS uid, count(*) AS n, min(event_time_us) AS first_us FROM hi GROUP BY 1"),
    ("fs", f"""SELECT p.uid, min(b.t_us) AS from_us FROM per p JOIN b ON CAST(b.user_id AS BIGINT) = p.uid
  AND b.t_us <= p.first_us AND b.t_us > p.first_us - {P.TEST_INTENT.window_us} GROUP BY 1""")], f"""
SELECT u.id AS user_id, p.n IS NOT NULL AS emitted, coalesce(p.n, 0) AS n_intents,
  CASE WHEN p.n IS NOT NULL THEN '{P.TEST_INTENT.event_type}' END AS event_type,
  CAST(p.first_us AS DOUBLE) AS first_intent_us, CAST(p.first_us - f.from_us AS DOUBLE) AS latency_us
FROM v_users u LEFT JOIN per p ON p.uid = u.id LEFT JOIN fs f ON f.uid = u.id""", recursive=True)
ORACLE["promotion_audit_stream"] = ORACLE["promotion_audit"]

TMO, ASOF = P.TEST_CART_TIMEOUT_US, P.TEST_AS_OF_US
ORACLE["cart_abandon"] = with_views(["v_behavior"], [BT], f"""
SELECT c.event_id, c.user_id, c.t_us, c.t_us + {TMO} AS deadline_us FROM bt c
WHERE c.action = 'add_to_cart' AND c.t_us + {TMO} <= {ASOF}
  AND NOT EXISTS (SELECT 1 FROM bt p WHERE p.action = 'purchase' AND p.user_id = c.user_id
                  AND p.t_us > c.t_us AND p.t_us <= c.t_us + {TMO})""")

HOR = P.TEST_REALTIME_HORIZON_US
ORACLE["realtime_profile"] = with_views(["v_behavior"], [
    BT, ("rc", f"SELECT * FROM bt WHERE t_us >= {ASOF - HOR} AND t_us < {ASOF}"),
    ("ps", "SELECT user_id, sku_id, count(*) AS c FROM rc GROUP BY 1, 2"),
    ("top", "SELECT user_id, arg_min(sku_id, (-c, sku_id)) AS realtime_interest FROM ps GROUP BY 1"),
    ("st", "SELECT user_id, max(t_us) AS last_active_us, count(*) AS n_events_window, avg(price) < 20.0 AS price_sensitive FROM rc GROUP BY 1")], """
SELECT s.user_id, s.last_active_us, s.n_events_window, s.price_sensitive, t.realtime_interest
FROM st s JOIN top t ON t.user_id = s.user_id""")

ORACLE["in_stock_offers"] = with_views(["v_behavior", "v_products"], [], """
SELECT sku_id, name, price, stock FROM v_products
WHERE stock > 0 AND sku_id IN (SELECT sku_id FROM v_behavior)""")

ORACLE["promotion_eligibility"] = with_views(["v_users"], [
    ("rules", "SELECT * FROM (VALUES (1, 1000.0), (2, 5000.0), (3, 20000.0), (4, 100000.0), (5, 500000.0)) t(rule_id, min_spend)"),
    ("spend", "SELECT o_custkey AS user_id, sum(o_totalprice) AS spend FROM orders GROUP BY 1"),
    ("tagged", f"SELECT id FROM v_users WHERE list_contains(coalesce({_tags('identity_tags')}, CAST([] AS VARCHAR[])), 'price_sensitive')")], """
SELECT s.user_id, round(s.spend, 2) AS spend, CAST(r.rule_id AS INTEGER) AS rule_id, CAST(r.min_spend AS DOUBLE) AS min_spend
FROM tagged t JOIN spend s ON s.user_id = t.id JOIN rules r ON s.spend >= r.min_spend""")

ORACLE["send_gate_stream"] = ORACLE["send_gate"]
ORACLE["retry_routing_stream"] = ORACLE["retry_routing"]

ORACLE["cart_abandon_stream"] = with_views(["v_behavior"], [
    BT, ("mx", "SELECT CAST(floor(max(t_us) / 1000.0) AS BIGINT) * 1000 AS as_of FROM bt")], f"""
SELECT c.event_id, c.user_id, c.t_us, c.t_us + {TMO} AS deadline_us FROM bt c JOIN mx ON c.t_us + {TMO} <= mx.as_of
WHERE c.action = 'add_to_cart'
  AND NOT EXISTS (SELECT 1 FROM bt p WHERE p.action = 'purchase' AND p.user_id = c.user_id
                  AND p.t_us > c.t_us AND p.t_us <= c.t_us + {TMO})""")

ORACLE["realtime_profile_stream"] = ORACLE["realtime_profile"]
