"""DuckDB SQL of the operators whose result SQL can express."""

from __future__ import annotations

#: crc32 by its table of 256 remainders, which SQL derives from the polynomial
CRC_TABLE_SQL = """crc_table AS (
  SELECT list(list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]),
                          lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256)))"""


def crc_sql(code_points: str) -> str:
    """crc32 of the UTF-8 bytes of a list of code points up to U+00FF, with ``t`` in scope."""
    utf8 = (f"flatten(list_transform({code_points}, lambda x: CASE WHEN x < 128 THEN [CAST(x AS BIGINT)] "
            "ELSE [CAST(192 + (x >> 6) AS BIGINT), CAST(128 + (x & 63) AS BIGINT)] END))")
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {utf8}), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"


def code_points_sql(text: str) -> str:
    return f"list_transform(string_split({text}, ''), lambda x: CAST(unicode(x) AS BIGINT))"


#: Of payloads of at least 100 bytes that several pages share, the smallest page_id is the response.
OP11_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""


def merkle_sql(levels: int = 8, group_levels: int = 4) -> str:
    """Trees of up to 8 ** levels leaves a group and 8 ** group_levels groups, one step per level."""
    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(
            f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
            for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = crc_sql(code_points_sql("CAST(doc_id AS VARCHAR)"))
    steps = [CRC_TABLE_SQL, f"""leaves AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS c
  FROM (SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS g, {leaf("text")} AS leaf,
               CASE WHEN doc_id IS NOT NULL AND ({crc}) % 3 = 0 THEN {leaf(lowered)} END AS other
        FROM documents, crc_table))""",
             "n0 AS (SELECT g, pos, leaf AS h, c FROM leaves)"]

    def climb(name: str, runs: str, count: int) -> None:
        for k in range(count):
            steps.append(f"{runs}{k} AS (SELECT g, pos // 8 AS pos, string_agg(h, '' ORDER BY pos) AS s, (any_value(c) + 7) // 8 AS c "
                         f"FROM {name}{k} WHERE c > 1 GROUP BY g, pos // 8)")
            steps.append(f"{name}{k + 1} AS (SELECT g, pos, sha256(s) AS h, c FROM {runs}{k})")

    def walk(name: str, runs: str, count: int, key: str) -> None:
        for k in range(count):
            steps.append(f"""{name}{k + 1} AS (
  SELECT d.* EXCLUDE (pos, folded, proof), d.pos // 8 AS pos,
         CASE WHEN r.s IS NULL THEN folded ELSE sha256(left(r.s, 64 * (d.pos % 8)) || folded || substr(r.s, 64 * (d.pos % 8) + 65)) END AS folded,
         CASE WHEN r.s IS NULL THEN proof ELSE proof || left(r.s, 64 * (d.pos % 8)) || substr(r.s, 64 * (d.pos % 8) + 65) END AS proof
  FROM {name}{k} d LEFT JOIN {runs}{k} r ON r.g = d.{key} AND r.pos = d.pos // 8)""")

    climb("n", "r", levels)
    steps.append("subroots AS (" + " UNION ALL ".join(f"SELECT g, h FROM n{k} WHERE c = 1" for k in range(levels + 1)) + ")")
    steps.append("m0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, g AS own, h, count(*) OVER () AS c FROM subroots)")
    climb("m", "q", group_levels)
    steps.append("top AS (" + " UNION ALL ".join(f"SELECT h FROM m{k} WHERE c = 1" for k in range(group_levels + 1)) + ")")
    steps.append("d0 AS (SELECT doc_id, leaf, g, pos, coalesce(other, leaf) AS folded, '' AS proof FROM leaves)")
    walk("d", "r", levels, "g")
    steps.append(f"e0 AS (SELECT d.* EXCLUDE (pos), m.pos AS pos, m.h AS subroot, 0 AS one FROM d{levels} d JOIN m0 m ON m.own = d.g)")
    walk("e", "q", group_levels, "one")
    return ("WITH " + ",\n".join(steps) + f"""
SELECT doc_id, leaf, subroot, top.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = top.h AS verified
FROM e{group_levels}, top""")


#: Near words share a word with one code point cut out at the same place, or one is the other with one cut out.
OP13_SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
runs AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
    FROM documents) GROUP BY ALL),
hashed AS (SELECT run, times, {crc_sql(code_points_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run"))} AS h FROM runs, crc_table),
seen AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed),
words AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM seen WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
cuts AS (
  SELECT word, n, place, left(word, place - 1) || substr(word, place + 1) AS cut
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS place FROM words)),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.place = b.place AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.cut = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.cut = b.word),
ranked AS (
  SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near,
         row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) AS place FROM near),
grouped AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.near_n >= 2 * w.n THEN r.near END AS form,
         CASE WHEN r.near_n >= 2 * w.n THEN r.near_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1),
chain AS (
  SELECT word, word AS last FROM grouped
  UNION ALL SELECT c.word, g.form FROM chain c JOIN grouped g ON g.word = c.last WHERE g.form IS NOT NULL)
SELECT g.word, g.form, c.last AS root, g.n, CAST(g.n_near AS BIGINT) AS n_near, CAST(g.form_n AS BIGINT) AS form_n
FROM grouped g JOIN chain c ON c.word = g.word JOIN grouped l ON l.word = c.last AND l.form IS NULL
"""
