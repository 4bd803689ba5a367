"""DuckDB text of the fixture views (twins of ``intentlane.sources.views``)."""

from __future__ import annotations

VIEWS: dict[str, str] = {
    "v_behavior": """
SELECT event_id, CAST(user_id AS VARCHAR) AS user_id,
       CASE event_type WHEN 'click' THEN 'view_item' WHEN 'view' THEN 'search'
            WHEN 'signup' THEN 'add_to_cart' WHEN 'purchase' THEN 'purchase' END AS action,
       'sku_' || regexp_extract(props, '([0-9]+)', 1) AS sku_id, value AS price, ts AS event_time
FROM events""",
    "v_behavior_json": """
SELECT event_id, CASE event_id % 5
  WHEN 0 THEN '{"user_id":"' || CAST(user_id AS VARCHAR) || '","action":"view_item","sku_id":"s1","timestamp":' || CAST(1704067200 + event_id AS VARCHAR) || '}'
  WHEN 1 THEN '{"userId":"' || CAST(user_id AS VARCHAR) || '","action":"purchase","skuId":"s2","timestamp":' || CAST((1704067200 + event_id) * 1000 AS VARCHAR) || '}'
  WHEN 2 THEN '{"userId":"' || CAST(user_id AS VARCHAR) || '","eventType":"CLICK","skuId":"s3","timestamp":' || CAST(1704067200 + event_id AS VARCHAR) || '.5}'
  WHEN 3 THEN '{"action":"search","timestamp":1704067200}'
  ELSE 'not valid json' END AS value
FROM events""",
    "v_users": """
SELECT c_custkey AS id, c_name AS name,
       CASE WHEN c_acctbal >= 6600 THEN 'HIGH' WHEN c_acctbal >= 3300 THEN 'MEDIUM' ELSE 'LOW' END AS spending_tier,
       CASE WHEN c_custkey % 11 = 0 THEN 'oops' WHEN c_custkey % 11 = 1 THEN NULL
            ELSE '["' || lower(c_mktsegment) || '"' ||
                 CASE WHEN c_custkey % 3 = 0 THEN ',"price_sensitive"' ELSE '' END ||
                 CASE WHEN c_custkey % 5 = 0 THEN ',"vip"' ELSE '' END ||
                 CASE WHEN c_custkey % 7 = 0 THEN ',"new_user"' ELSE '' END || ']' END AS identity_tags
FROM customer""",
    "v_users_dated": """
SELECT *, TIMESTAMP '2020-01-01 00:00:00' + to_hours(id) AS created_at, TIMESTAMP '2020-01-01 00:00:00' + to_hours(id * 2) AS updated_at FROM v_users""",
    "v_products": """
SELECT 'sku_' || CAST(p_partkey AS VARCHAR) AS sku_id, p_name AS name, p_type AS category,
       CAST(p_partkey % 60 AS DOUBLE) * 10 AS price, CAST(p_size % 3 AS INTEGER) AS stock,
       CASE p_partkey % 4 WHEN 0 THEN 'light; strong;;' WHEN 1 THEN 'light；strong, cheap'
            WHEN 2 THEN ' ' END AS selling_points,
       CASE p_partkey % 6 WHEN 0 THEN 'New arrival' WHEN 1 THEN 'LIMITED run' WHEN 2 THEN 'On Sale'
            WHEN 3 THEN 'Discount week' WHEN 4 THEN 'half off 新品' END AS description
FROM part""",
    "v_scripts": """
SELECT item_id AS id,
       CASE item_id % 5 WHEN 0 THEN 'cart_abandon' WHEN 1 THEN 'price_drop' WHEN 2 THEN 'new_user' WHEN 3 THEN 'general_promotion' END AS scenario,
       CASE WHEN item_id % 9 = 0 THEN '  ' ELSE text END AS content,
       CASE WHEN item_id % 4 = 0 THEN NULL ELSE 'tag_a, tag_b' END AS tags
FROM benchmark""",
    "v_index": """
SELECT vec_id AS id, 's' || CAST(label AS VARCHAR) AS scenario, embedding FROM embeddings""",
    "v_queries": """
SELECT vec_id AS id, 's' || CAST(label AS VARCHAR) AS scenario, embedding FROM embeddings""",
    "v_sends": """
SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, ts FROM events WHERE event_type = 'purchase'""",
    "v_requests": """
SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, ts FROM events WHERE event_type = 'click'""",
    "v_results": """
SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, CAST(event_id % 5 AS INTEGER) AS attempt,
       event_type <> 'error' AS success, CASE WHEN event_type = 'error' THEN 'boom' END AS error, ts
FROM events""",
    "v_profile_requests": """
SELECT DISTINCT CASE event_id % 4 WHEN 0 THEN CAST(user_id AS VARCHAR)
  WHEN 1 THEN 'user-' || CAST(user_id AS VARCHAR) WHEN 2 THEN 'u-' || CAST(user_id AS VARCHAR) || '-x'
  ELSE ' ' || CAST(user_id AS VARCHAR) END AS request_id
FROM events""",
}


def with_views(names: list[str], ctes: list[tuple[str, str]], body: str,
               recursive: bool = False) -> str:
    """Compose ``WITH [RECURSIVE] view..., cte... body``."""
    parts = [f"{n} AS ({VIEWS[n]}\n)" for n in names]
    parts += [f"{n} AS (\n{sql}\n)" for n, sql in ctes]
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(parts) + "\n" + body
