"""DuckDB oracles for catalogue and retrieval keys."""

from __future__ import annotations

from intentlane import params as P
from intentlane.plans.oracle_views import with_views

ORACLE: dict[str, str] = {}

PK = "CAST(substr(sku_id, 5) AS BIGINT)"

ORACLE["product_upsert"] = with_views(["v_products"], [
    ("base", f"""SELECT sku_id, name, selling_points, price, stock FROM v_products WHERE {PK} % 3 = 0"""),
    ("batch", f"""SELECT CASE WHEN {PK} % 10 = 7 THEN NULL ELSE sku_id END AS sku_id, name, selling_points,
  price, stock, 1 AS seq FROM v_products
  UNION ALL
  SELECT sku_id, name || ' v2', selling_points, price + 1, stock + 1, 2 FROM v_products WHERE {PK} % 2 = 0"""),
    ("latest", """SELECT sku_id, arg_max(name, seq) AS name, arg_max(selling_points, seq) AS selling_points,
  arg_max(coalesce(CAST(price AS DOUBLE), 0.0), seq) AS price, arg_max(coalesce(stock, 0), seq) AS stock
FROM batch WHERE sku_id IS NOT NULL GROUP BY sku_id"""),
], """SELECT coalesce(n.sku_id, e.sku_id) AS sku_id,
  CASE WHEN n.sku_id IS NOT NULL THEN n.name ELSE e.name END AS name,
  CASE WHEN n.sku_id IS NOT NULL THEN n.selling_points ELSE e.selling_points END AS selling_points,
  CASE WHEN n.sku_id IS NOT NULL THEN n.price ELSE CAST(e.price AS DOUBLE) END AS price,
  CAST(CASE WHEN n.sku_id IS NOT NULL THEN n.stock ELSE e.stock END AS INTEGER) AS stock,
  CASE WHEN e.sku_id IS NOT NULL THEN CAST(1701388800000000 AS BIGINT) ELSE CAST(1706745600000000 AS BIGINT) END AS created_at_us,
  CASE WHEN n.sku_id IS NOT NULL THEN CAST(1706745600000000 AS BIGINT) ELSE CAST(1701388800000000 AS BIGINT) END AS updated_at_us
FROM base e FULL OUTER JOIN latest n ON e.sku_id = n.sku_id""")


def split_points(col: str) -> str:
    return (f"coalesce(list_filter(list_transform(string_split(replace(replace({col}, '；', ';'), ',', ';'), ';'), "
            f"lambda x: trim(x)), lambda x: x <> ''), CAST([] AS VARCHAR[]))")


ORACLE["product_details"] = with_views(["v_behavior", "v_products"], [
    ("skus", "SELECT DISTINCT sku_id FROM v_behavior")],
    f"""SELECT p.sku_id AS product_id, p.name, CAST(NULL AS VARCHAR) AS category, CAST(p.price AS DOUBLE) AS price,
  array_to_string({split_points('p.selling_points')}, '|') AS selling_points
FROM skus s JOIN v_products p ON p.sku_id = s.sku_id""")


def tier(price: str) -> str:
    p = f"coalesce(CAST({price} AS DOUBLE), 0.0)"
    return (f"CASE WHEN {p} < 100 THEN '{P.PRICE_TIER_AFFORDABLE}' WHEN {p} >= 100 AND {p} <= 300 "
            f"THEN '{P.PRICE_TIER_STANDARD}' WHEN {p} > 500 THEN '{P.PRICE_TIER_EXPENSIVE}' "
            f"ELSE '{P.PRICE_TIER_MODERATE}' END")


ORACLE["price_tier"] = with_views(["v_products"], [],
                                  f"SELECT sku_id, price, {tier('price')} AS price_tier FROM v_products")


def flags(desc: str) -> str:
    d = f"coalesce({desc}, '')"
    return (f"(CASE WHEN contains(lower({d}), 'new') OR contains({d}, '新品') THEN '{P.FLAG_NEW}' ELSE '' END || "
            f"CASE WHEN contains(lower({d}), 'limited') OR contains({d}, '限量') THEN '{P.FLAG_LIMITED}' ELSE '' END || "
            f"CASE WHEN contains(lower({d}), 'sale') OR contains({d}, 'discount') OR contains({d}, 'off') "
            f"THEN '{P.FLAG_SALE}' ELSE '' END)")


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fill_template(template: str, *args: str) -> str:
    """SQL concatenation filling the ``%s`` slots of a fixed template."""
    parts = template.split("%s")
    assert len(parts) == len(args) + 1
    out = [_sql_text(parts[0])]
    for a, lit in zip(args, parts[1:]):
        out += [a, _sql_text(lit)]
    return " || ".join(x for x in out if x != "''")


def docs_sql(src: str, points: str) -> str:
    """CAT-5 over ``src`` with ``points`` = SQL for the joined selling points."""
    doc = fill_template(P.PRODUCT_DOC_TEMPLATE, "coalesce(category, '')", "coalesce(name, 'null')",
                        tier("price"), f"{points} || {flags('description')}",
                        "coalesce(description, '')")
    return f"""SELECT sku_id AS id, {doc} AS document,
  sku_id AS m_product_id, name AS m_name, coalesce(category, '') AS m_category,
  CAST(coalesce(CAST(price AS DOUBLE), 0.0) AS VARCHAR) AS m_price, {points} AS m_selling_points_str
FROM {src}"""


ORACLE["catalog_documents"] = with_views(["v_products"], [], docs_sql("v_products", "''"))

CATALOG_CTE = ("cat", docs_sql("v_products", f"array_to_string({split_points('selling_points')}, '; ')"))

ORACLE["catalog_sync"] = with_views(["v_products"], [], """
SELECT CASE WHEN count(*) > 0 THEN 'success' ELSE 'skipped' END AS status, count(DISTINCT sku_id) AS n_products,
  count(*) AS n_vectors, CAST(64 AS INTEGER) AS dim FROM v_products""")

ORACLE["script_documents"] = with_views(["v_scripts"], [
    ("s", f"""SELECT coalesce(scenario, '{P.DEFAULT_SCRIPT_SCENARIO}') AS scenario, coalesce(tags, '') AS tags,
  {fill_template(P.SCRIPT_DOC_TEMPLATE, f"coalesce(scenario, '{P.DEFAULT_SCRIPT_SCENARIO}')", "content")} AS text
FROM v_scripts WHERE content IS NOT NULL AND NOT regexp_full_match(content, '\\s*')""")],
    "SELECT sha256(text) AS id, scenario, tags, text FROM s")

K = 9


def knn_ctes(queries: str, index: str, k: int, same: str | None = None) -> list[tuple[str, str]]:
    cond = f"WHERE q.{same} = i.{same}" if same else ""
    return [
        ("pairs", f"""SELECT q.id AS query_id, i.id AS id,
  1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])) AS d
FROM {queries} q, {index} i {cond}"""),
        ("hits", f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), id) AS rank
FROM pairs QUALIFY rank <= {k}"""),
    ]


ORACLE["vector_topk"] = with_views(["v_queries", "v_index"], knn_ctes("v_queries", "v_index", K),
                                   "SELECT query_id, rank, id, round(d, 6) + 0.0 AS distance FROM hits")

# vector_topk_approx has no SQL form; this is the check of its recall on all queries
ORACLE["vector_topk_recall"] = with_views(["v_queries"], [], "SELECT count(*) AS n_queries, TRUE AS recall_reached FROM v_queries")

ORACLE["script_search"] = with_views(
    ["v_queries", "v_index"],
    knn_ctes("(SELECT * FROM v_queries WHERE scenario IS NOT NULL AND trim(scenario) <> '')", "v_index",
             P.SEARCH_K, same="scenario"),
    "SELECT h.query_id, h.rank, h.id, i.scenario, round(h.d, 6) + 0.0 AS distance "
    "FROM hits h JOIN v_index i ON i.id = h.id")


def tokens(col: str) -> str:
    return (f"list_distinct(list_filter(regexp_split_to_array(lower({col}), '[^\\p{{L}}\\p{{N}}]+'), "
            f"lambda t: t <> ''))")


def score(q: str, d: str) -> str:
    return (f"CASE WHEN {q} IS NOT NULL AND {d} IS NOT NULL THEN "
            f"CAST(len(list_intersect({tokens(q)}, {tokens(d)})) AS DOUBLE) END")


QT = ("qt", """SELECT q.id, q.embedding, d.text AS query_text FROM v_queries q
LEFT JOIN documents d ON d.doc_id = q.id""")

RERANK = ("rr", """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY
  CASE WHEN ok THEN -score ELSE 0.0 END, recall_rank) AS new_rank FROM (
  SELECT *, bool_and(score IS NOT NULL) OVER (PARTITION BY query_id) AS ok FROM scored)""")

ORACLE["rerank"] = with_views(["v_queries", "v_index"], [QT] + knn_ctes("qt", "v_index", K) + [
    ("scored", f"""SELECT h.query_id, h.id, h.rank AS recall_rank, h.d, {score('q.query_text', 'd.text')} AS score
FROM hits h JOIN qt q ON q.id = h.query_id LEFT JOIN documents d ON d.doc_id = h.id"""),
    RERANK],
    "SELECT query_id, new_rank AS rank, id, recall_rank, score, round(d, 6) + 0.0 AS distance FROM rr")

_PS_CTES = [QT, ("live", "SELECT * FROM qt WHERE query_text IS NOT NULL AND trim(query_text) <> ''"),
            CATALOG_CTE] + knn_ctes("live", "v_index", P.SEARCH_K * P.RECALL_FACTOR) + [
    ("scored", f"""SELECT h.query_id, h.id, h.rank AS recall_rank, h.d, c.m_product_id AS product_id,
  c.m_name AS name, c.m_category AS category, coalesce(TRY_CAST(c.m_price AS DOUBLE), 0.0) AS price,
  {split_points('c.m_selling_points_str')} AS points, {score('q.query_text', 'c.document')} AS score
FROM hits h JOIN live q ON q.id = h.query_id LEFT JOIN cat c ON c.id = 'sku_' || CAST(h.id AS VARCHAR)"""),
    RERANK, ("ps", f"SELECT * FROM rr WHERE new_rank <= {P.SEARCH_K}")]

ORACLE["product_search"] = with_views(["v_queries", "v_index", "v_products"], _PS_CTES, """
SELECT query_id, new_rank AS rank, product_id, name, category, price, array_to_string(points, '|') AS selling_points,
  round(d, 6) + 0.0 AS distance, score FROM ps""")

_SL = P.SEARCH_TEXT_LABELS
ORACLE["search_text"] = with_views(["v_queries", "v_index", "v_products"], _PS_CTES + [
    ("blocks", f"""SELECT query_id, string_agg(chr(10) || '{_SL[0]}' || CAST(new_rank AS VARCHAR) || ':' ||
  chr(10) || '{_SL[1]}' || coalesce(name, 'None') || chr(10) || '{_SL[2]}' || coalesce(category, 'None') ||
  chr(10) || '{_SL[3]}' || CAST(price AS VARCHAR) || chr(10) || '{_SL[4]}' || array_to_string(points, '; ') || chr(10),
  chr(10) ORDER BY new_rank) AS text FROM ps GROUP BY query_id""")], f"""
SELECT q.id AS query_id,
  coalesce(b.text, {fill_template(P.SEARCH_TEXT_MISSING, "coalesce(q.query_text, 'None')")}) AS text
FROM qt q LEFT JOIN blocks b ON b.query_id = q.id""")

_CHANGED = "CAST(substr(sku_id, 5) AS BIGINT)"
ORACLE["catalog_upsert"] = with_views(["v_products"], [
    ("upserted", f"""SELECT sku_id, CASE WHEN {_CHANGED} % 100 = 7 THEN name || ' v2' ELSE name END AS name, category,
  CASE WHEN {_CHANGED} % 100 = 7 THEN price + 5 ELSE price END AS price, selling_points, description FROM v_products
UNION ALL SELECT sku_id || '-b', name, category, price, selling_points, description FROM v_products WHERE {_CHANGED} % 50 = 3""")],
    f"""SELECT *, CAST(64 AS INTEGER) AS dim FROM ({docs_sql("upserted", f"array_to_string({split_points('selling_points')}, '; ')")})""")

_LIBRARY = f"""SELECT coalesce(scenario, '{P.DEFAULT_SCRIPT_SCENARIO}') AS scenario, coalesce(tags, '') AS tags,
  {fill_template(P.SCRIPT_DOC_TEMPLATE, f"coalesce(scenario, '{P.DEFAULT_SCRIPT_SCENARIO}')", "content")} AS content
FROM {{src}} WHERE content IS NOT NULL AND NOT regexp_full_match(content, '\\s*')"""
ORACLE["script_ingest"] = with_views(["v_scripts"], [
    ("again", "SELECT scenario, tags, CASE WHEN id % 5 = 0 THEN content || ' (new)' ELSE content END AS content FROM v_scripts"),
    ("both_", f"{_LIBRARY.format(src='v_scripts')} UNION ALL {_LIBRARY.format(src='again')}"),
    ("once", "SELECT content, max(scenario) AS scenario, max(tags) AS tags FROM both_ GROUP BY content")],
    "SELECT sha256(content) AS id, scenario, tags, content, CAST(64 AS INTEGER) AS dim FROM once")

ORACLE["script_hits"] = with_views(["v_queries", "v_index", "v_scripts"], [
    ("lib", """SELECT s.id, s.content, coalesce(s.scenario, 'none') AS scenario, coalesce(s.tags, '') AS tags, i.embedding
FROM v_scripts s JOIN v_index i ON i.id = s.id"""),
    ("sq", """SELECT q.id, q.embedding, CASE q.id % 3 WHEN 0 THEN ' ' WHEN 1 THEN 'cart_abandon' ELSE 'price_drop' END AS scenario
FROM v_queries q LEFT JOIN documents d ON d.doc_id = q.id
WHERE q.id % 7 <> 0 AND d.text IS NOT NULL AND NOT regexp_full_match(d.text, '\\s*')"""),
    ("pairs", """SELECT q.id AS query_id, l.id, l.scenario, l.tags, l.content,
  1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(l.embedding AS DOUBLE[])) AS d
FROM sq q, lib l WHERE trim(q.scenario) = '' OR q.scenario = l.scenario""")], f"""
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), id) AS rank, id, scenario, tags, content,
  round(d, 6) + 0.0 AS distance FROM pairs QUALIFY rank <= {P.SEARCH_K}""")
