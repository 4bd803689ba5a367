"""DuckDB oracle SQL per query key, over the driver's pre-registered tables."""

from __future__ import annotations

from intentlane import params as P
from intentlane.plans.oracle_views import with_views

ORACLE: dict[str, str] = {}

_W1 = P.TEST_INTENT.window_us - 1


def _time_ctes() -> list[tuple[str, str]]:
    return [("b", "SELECT *, epoch_us(event_time) AS t_us FROM v_behavior")]


def _count_expr(part: str) -> str:
    return (f"count(*) OVER (PARTITION BY {part} ORDER BY t_us RANGE BETWEEN {_W1} PRECEDING AND CURRENT ROW)"
            f" - (count(*) OVER (PARTITION BY {part}, t_us)"
            f" - row_number() OVER (PARTITION BY {part}, t_us ORDER BY event_id))")


ORACLE["sliding_click_count"] = with_views(
    ["v_behavior"], _time_ctes(),
    f"SELECT event_id, user_id, {_count_expr('user_id')} AS n FROM b")

ORACLE["sliding_count_by_action"] = with_views(
    ["v_behavior"], _time_ctes(),
    f"SELECT event_id, user_id, action, {_count_expr('user_id, action')} AS n FROM b")


def _greedy_ctes(src: str, cooldown_us: int, prefix: str) -> list[tuple[str, str]]:
    """Recursive greedy cooldown over ``src`` (user_id, event_id, t_us):
    ``{prefix}_fires(user_id, rk)`` with ``{prefix}_q`` ranked candidates."""
    return [
        (f"{prefix}_q", f"SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS rk FROM {src}"),
        (f"{prefix}_nx", f"""SELECT a.user_id, a.rk, min(b.rk) AS nrk FROM {prefix}_q a JOIN {prefix}_q b
  ON a.user_id = b.user_id AND b.t_us >= a.t_us + {cooldown_us} GROUP BY a.user_id, a.rk"""),
        (f"{prefix}_fires", f"""SELECT user_id, rk FROM {prefix}_q WHERE rk = 1
  UNION ALL
  SELECT n.user_id, n.nrk FROM {prefix}_fires f JOIN {prefix}_nx n ON n.user_id = f.user_id AND n.rk = f.rk"""),
    ]


def high_intent_ctes() -> list[tuple[str, str]]:
    """CTEs ending in ``hi`` (the high_intent result); needs v_behavior."""
    p = P.TEST_INTENT
    return _time_ctes() + [
        ("c", f"SELECT *, {_count_expr('user_id')} AS n FROM b"),
        ("cand", f"SELECT * FROM c WHERE n >= {p.threshold}"),
    ] + _greedy_ctes("cand", p.cooldown_us, "hi") + [
        ("hi", f"""SELECT q.user_id, q.event_id, '{p.event_type}' AS event_type, '{p.reason}' AS reason,
  q.t_us AS event_time_us, coalesce(q.action, '{P.CONTEXT_DEFAULT_ACTION}') AS last_action,
  coalesce(q.sku_id, '{P.CONTEXT_DEFAULT_SKU}') AS sku_id,
  coalesce(CAST(q.price AS DOUBLE), {P.CONTEXT_DEFAULT_PRICE}) AS price, q.n AS recent_clicks
FROM hi_q q JOIN hi_fires f ON q.user_id = f.user_id AND q.rk = f.rk""")]


def _high_intent_sql() -> str:
    return with_views(["v_behavior"], high_intent_ctes(), "SELECT * FROM hi", recursive=True)


ORACLE["high_intent"] = _high_intent_sql()
ORACLE["high_intent_stream"] = _high_intent_sql()


_J = [("j", "SELECT event_id, CASE WHEN json_valid(value) AND json_type(value) = 'OBJECT' THEN value END AS v FROM v_behavior_json")]


def _first_nonempty(*paths: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(json_extract_string(v, '{p}'), '')" for p in paths) + ")"


def _ts_us(num: str) -> str:
    return f"CAST(CASE WHEN {num} < 1e11 THEN round({num} * 1e6) ELSE round({num} * 1e3) END AS BIGINT)"


ORACLE["normalize_behavior"] = with_views(["v_behavior_json"], _J + [
    ("n", f"""SELECT event_id, v, {_first_nonempty('$.user_id', '$.userId')} AS user_id,
  TRY_CAST(json_extract(v, '$.timestamp') AS DOUBLE) AS ts_num FROM j""")],
    f"""SELECT event_id, user_id,
  coalesce(json_extract_string(v, '$.action'), json_extract_string(v, '$.eventType')) AS action,
  coalesce(json_extract_string(v, '$.sku_id'), json_extract_string(v, '$.skuId')) AS sku_id,
  TRY_CAST(json_extract(v, '$.price') AS DOUBLE) AS price,
  CAST({_ts_us('ts_num')} AS DOUBLE) AS event_time_us,
  CASE WHEN v IS NULL THEN 'invalid_json' WHEN user_id IS NULL THEN 'missing_user'
       WHEN ts_num IS NULL THEN 'missing_time' ELSE 'ok' END AS status
FROM n""")


ORACLE["normalize_rejects"] = with_views(["v_behavior_json"], _J + [
    ("n", f"""SELECT j.event_id, j.v, b.value, {_first_nonempty('$.user_id', '$.userId')} AS user_id,
  TRY_CAST(json_extract(v, '$.timestamp') AS DOUBLE) AS ts_num FROM j JOIN v_behavior_json b ON b.event_id = j.event_id""")],
    """SELECT event_id, CASE WHEN v IS NULL THEN 'invalid_json' WHEN user_id IS NULL THEN 'missing_user' ELSE 'missing_time' END AS status, value AS raw
FROM n WHERE v IS NULL OR user_id IS NULL OR ts_num IS NULL""")

ORACLE["intent_topic"] = with_views(["v_behavior"], high_intent_ctes(), """
SELECT user_id AS key, user_id, event_type, reason, last_action, sku_id, price, event_time_us, 'ok' AS status, TRUE AS payload_kept FROM hi""", recursive=True)


def _truthy(path: str) -> str:
    t = f"json_type(v, '{path}')"
    s = f"json_extract_string(v, '{path}')"
    return (f"CASE WHEN {t} = 'VARCHAR' THEN nullif({s}, '') "
            f"WHEN {t} IN ('BIGINT', 'UBIGINT') THEN CASE WHEN TRY_CAST({s} AS DOUBLE) <> 0 THEN {s} END "
            f"WHEN {t} = 'BOOLEAN' THEN CASE WHEN {s} = 'true' THEN 'True' END END")


ORACLE["decode_intents"] = with_views(["v_behavior_json"], _J + [
    ("d", f"""SELECT event_id, v, coalesce({_truthy('$.userId')}, {_truthy('$.user_id')}) AS user_id,
  coalesce({_truthy('$.eventType')},
           CASE WHEN json_exists(v, '$.event_type') THEN json_extract_string(v, '$.event_type')
                ELSE '{P.DEFAULT_INTENT_TYPE}' END) AS et,
  CASE WHEN coalesce(TRY_CAST(json_extract(v, '$.timestamp') AS DOUBLE), 0) <> 0
       THEN TRY_CAST(json_extract(v, '$.timestamp') AS DOUBLE)
       ELSE TRY_CAST(json_extract(v, '$.eventTimestamp') AS DOUBLE) END AS ts FROM j""")],
    """SELECT event_id, user_id,
  CASE WHEN user_id IS NOT NULL THEN et END AS event_type,
  CASE WHEN user_id IS NOT NULL THEN ts END AS timestamp_num,
  CASE WHEN v IS NULL THEN 'invalid_json' WHEN user_id IS NULL THEN 'missing_user' ELSE 'ok' END AS status
FROM d""")


def _tags(col: str) -> str:
    return (f"CASE WHEN json_valid({col}) THEN CASE WHEN json_type({col}) = 'ARRAY' "
            f"THEN CAST(CAST({col} AS JSON) AS VARCHAR[]) END ELSE CAST([] AS VARCHAR[]) END")


def _uid(col: str) -> str:
    piece = f"split_part({col}, '-', 2)"
    return (f"CASE WHEN regexp_full_match({col}, '[+-]?[0-9]+') THEN TRY_CAST({col} AS BIGINT) "
            f"WHEN {col} LIKE '%-%' AND regexp_full_match({piece}, '[+-]?[0-9]+') "
            f"THEN TRY_CAST({piece} AS BIGINT) END")


_ACT_FROM = "TIMESTAMP '2024-01-24 00:00:00'"   # as_of 2024-01-31 minus 7 days
_ACT = ("act", f"""SELECT CAST(user_id AS BIGINT) AS uid, count(*) AS total_clicks_30d,
  count(DISTINCT sku_id) AS unique_products_viewed_30d
FROM v_behavior WHERE event_time >= {_ACT_FROM} GROUP BY 1""")
_PROF = ("prof", f"""SELECT id, name, spending_tier, coalesce({_tags('identity_tags')}, CAST([] AS VARCHAR[])) AS tags FROM v_users""")

ORACLE["activity_30d"] = with_views(["v_users", "v_behavior"], [_ACT], """
SELECT u.id AS user_id, coalesce(a.total_clicks_30d, 0) AS total_clicks_30d,
  coalesce(a.unique_products_viewed_30d, 0) AS unique_products_viewed_30d
FROM v_users u LEFT JOIN act a ON a.uid = u.id""")

ORACLE["activity_30d_history"] = ORACLE["activity_30d"]
ORACLE["activity_30d_sketch"] = ORACLE["activity_30d"].replace(_ACT_FROM, "TIMESTAMP '2024-01-23 12:00:00'")

ORACLE["high_intent_category"] = with_views(["v_behavior", "v_products"], high_intent_ctes() + [
    ("met", f"""SELECT h.user_id, h.event_id, p.category, count(*) AS n, max(b.t_us) AS last FROM hi h
JOIN b ON b.user_id = h.user_id AND b.t_us <= h.event_time_us AND b.t_us > h.event_time_us - {P.TEST_INTENT.window_us}
JOIN v_products p ON p.sku_id = b.sku_id WHERE p.category IS NOT NULL GROUP BY ALL"""),
    ("best", "SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY user_id, event_id ORDER BY n DESC, last DESC, category) = 1")],
    """SELECT h.user_id, h.event_id, h.event_time_us, h.recent_clicks, m.category AS target_category
FROM hi h LEFT JOIN best m ON m.user_id = h.user_id AND m.event_id = h.event_id""", recursive=True)

ORACLE["snapshot_lookup"] = with_views(["v_users", "v_profile_requests"], [_PROF], """
SELECT r.request_id, p.name, p.spending_tier, array_to_string(p.tags, ',') AS identity_tags, p.id IS NOT NULL AS has_cached
FROM v_profile_requests r LEFT JOIN prof p ON CAST(p.id AS VARCHAR) = r.request_id""")

_PERS = ("pers", f"""SELECT r.request_id, p.id, p.name, p.spending_tier, p.tags,
  CASE WHEN p.id IS NOT NULL THEN coalesce(a.total_clicks_30d, 0) END AS total_clicks_30d,
  CASE WHEN p.id IS NOT NULL THEN coalesce(a.unique_products_viewed_30d, 0) END AS unique_products_viewed_30d,
  p.id IS NOT NULL AS has_profile
FROM v_profile_requests r LEFT JOIN prof p ON p.id = {_uid('r.request_id')}
LEFT JOIN act a ON a.uid = p.id""")

ORACLE["user_profile"] = with_views(["v_users", "v_behavior", "v_profile_requests"],
                                    [_ACT, _PROF, _PERS], """
SELECT request_id, CAST(id AS DOUBLE) AS id, name, spending_tier,
  CASE WHEN has_profile THEN array_to_string(tags, ',') END AS identity_tags,
  CAST(total_clicks_30d AS DOUBLE) AS total_clicks_30d,
  CAST(unique_products_viewed_30d AS DOUBLE) AS unique_products_viewed_30d, has_profile
FROM pers""")

ORACLE["profile_snapshot"] = with_views(["v_users"], [_PROF], """
SELECT CAST(id AS VARCHAR) AS key, id, name, spending_tier, array_to_string(tags, ',') AS identity_tags
FROM prof""")

_ISO = "'%Y-%m-%dT%H:%M:%S'"
ORACLE["profile_document"] = with_views(["v_users", "v_users_dated", "v_behavior", "v_profile_requests"], [_ACT, _PROF, _PERS], f"""
SELECT p.request_id, CAST(p.id AS DOUBLE) AS id, p.name, p.spending_tier, CASE WHEN has_profile THEN array_to_string(tags, ',') END AS identity_tags,
  strftime(d.created_at, {_ISO}) AS created_at, strftime(d.updated_at, {_ISO}) AS updated_at,
  CAST(total_clicks_30d AS DOUBLE) AS total_clicks_30d, CAST(unique_products_viewed_30d AS DOUBLE) AS unique_products_viewed_30d
FROM pers p LEFT JOIN v_users_dated d ON d.id = p.id""")

ORACLE["snapshot_document"] = with_views(["v_users", "v_users_dated"], [], f"""
SELECT CAST(id AS VARCHAR) AS key, id, name, strftime(created_at, {_ISO}) AS created_at, strftime(updated_at, {_ISO}) AS updated_at FROM v_users_dated""")

_SNAP = ("snap", """SELECT CAST(id AS VARCHAR) AS key, to_json(struct_pack(id := id, name := name,
  spending_tier := spending_tier, identity_tags := tags)) AS doc, tags, spending_tier
FROM prof""")
_CTX = ("ctx", """SELECT p.*, s.doc, s.tags AS s_tags, s.spending_tier AS s_tier, s.key IS NOT NULL AS has_cached,
  s.key IS NOT NULL AND p.has_profile AS both_
FROM pers p LEFT JOIN snap s ON s.key = p.request_id""")

ORACLE["user_context"] = with_views(["v_users", "v_behavior", "v_profile_requests"],
                                    [_ACT, _PROF, _PERS, _SNAP, _CTX], """
SELECT request_id, has_cached, has_profile AS has_persistent, both_ AS has_combined,
  CAST(CASE WHEN both_ THEN id END AS DOUBLE) AS c_id,
  CASE WHEN both_ THEN name END AS c_name,
  CASE WHEN both_ THEN spending_tier END AS c_spending_tier,
  CASE WHEN both_ THEN array_to_string(tags, ',') END AS c_tags,
  CAST(CASE WHEN both_ THEN total_clicks_30d END AS DOUBLE) AS c_total_clicks_30d,
  CAST(CASE WHEN both_ THEN unique_products_viewed_30d END AS DOUBLE) AS c_unique_products_viewed_30d,
  CASE WHEN both_ THEN array_to_string(s_tags, ',') END AS cached_tags,
  CASE WHEN both_ THEN s_tier END AS cached_spending_tier
FROM ctx""")

_L = P.CONTEXT_TEXT_LABELS


def _fill(template: str, *args: str) -> str:
    from intentlane.plans.oracle_catalog import fill_template
    return fill_template(template, *args)


ORACLE["context_text"] = with_views(["v_users", "v_behavior", "v_profile_requests"],
                                    [_ACT, _PROF, _PERS, _SNAP, _CTX], f"""
SELECT request_id, CASE WHEN has_profile THEN
  chr(10) || '{_L[0]}' || coalesce(CAST(id AS VARCHAR), 'None') ||
  chr(10) || '{_L[1]}' || coalesce(name, 'None') ||
  chr(10) || '{_L[2]}' || coalesce(spending_tier, 'None') ||
  chr(10) || '{_L[3]}' || array_to_string(tags, ', ') ||
  chr(10) || '{_L[4]}' || coalesce(CAST(doc AS VARCHAR), 'None') || chr(10)
  ELSE {_fill(P.CONTEXT_TEXT_MISSING, 'request_id')} END AS text
FROM ctx""")


def all_oracles() -> dict[str, str]:
    from intentlane.plans import oracle_catalog, oracle_gov
    out = dict(ORACLE)
    out.update(oracle_catalog.ORACLE)
    out.update(oracle_gov.ORACLE)
    return out
