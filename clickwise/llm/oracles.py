"""DuckDB SQL for the registered queries that SQL can express, over whole tables."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed value: the polynomial of CRC-32, reflected.
CRC32_POLYNOMIAL = 0xEDB88320


def decontamination(window: int = 10) -> str:
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH items AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {words} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), {window}) AS size, array_to_string(w[i:i + least(len(w), {window}) - 1], ' ') AS key
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {window}, 0) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
docs AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
places AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM docs),
found AS (
  SELECT r, i, p.size, item FROM (
    SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS key FROM places, sizes WHERE i + size - 1 <= len(w)) p
  JOIN windows v ON v.key = p.key AND v.size = p.size),
hit AS (SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest(range(i, i + size)) AS place FROM found) GROUP BY r),
named AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM found GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)"""


def merkle() -> str:
    def leaf(text: str) -> str:
        fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
        return "sha256(" + " || ".join(f"CASE WHEN {f} IS NULL THEN '-' ELSE strlen({f}) || ':' || {f} END" for f in fields) + ")"

    # The table of CRC-32, one bit after the other.
    bits = "SELECT range AS i, range AS c FROM range(256)"
    for _ in range(8):
        bits = f"SELECT i, xor(c >> 1, (c & 1) * {CRC32_POLYNOMIAL}) AS c FROM ({bits})"

    def up(name: str, base: str) -> str:
        return f"""
{name} AS (
  {base}
  UNION ALL
  SELECT lvl + 1, tree, pos // 16, (any_value(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY lvl, tree, pos // 16)"""

    def steps(nodes: str, tree: str, pos: str, order: int) -> str:
        # Of each run on the way: the digests left and right of the own node.
        return f"""
  SELECT l.r, {order} + d.lvl AS ord, array_to_string(d.digests[1:(({pos} // (16 ** d.lvl)::BIGINT) % 16)], '') || '|'
         || array_to_string(d.digests[(({pos} // (16 ** d.lvl)::BIGINT) % 16) + 2:], '') AS step
  FROM placed l JOIN (SELECT lvl, tree, pos // 16 AS run, list(digest ORDER BY pos) AS digests FROM {nodes} WHERE n > 1 GROUP BY ALL) d
    ON d.tree = {tree} AND d.run = {pos} // (16 ** (d.lvl + 1))::BIGINT"""

    return f"""
WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS t FROM ({bits})),
leaves AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('s' || source, 'n') AS tree, {leaf('text')} AS leaf,
         CASE WHEN doc_id IS NOT NULL AND xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ord(x)::BIGINT)),
                lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 5 = 0
              THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {leaf('text')} END AS changed
  FROM documents, crc),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves),{up(
        "nodes", "SELECT 0 AS lvl, tree, pos, n, leaf AS digest FROM numbered")},
subroots AS (SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),{up(
        "tops", "SELECT 0 AS lvl, '' AS tree, pos, n, digest FROM subroots")},
placed AS (SELECT l.*, s.digest AS subroot, s.pos AS top FROM numbered l JOIN subroots s USING (tree)),
steps AS ({steps("nodes", "l.tree", "l.pos", 0)}
  UNION ALL {steps("tops", "''", "l.top", 100)}),
ways AS (SELECT r, list(step ORDER BY ord) AS way FROM steps GROUP BY r),
whole AS (
  SELECT doc_id, leaf, subroot, (SELECT digest FROM tops WHERE n = 1) AS root, sha256(replace(array_to_string(coalesce(way, []), ''), '|', '')) AS proof_sha256,
         list_reduce(list_prepend(changed, coalesce(way, [])), lambda a, s: sha256(split_part(s, '|', 1) || a || split_part(s, '|', 2))) AS folded_root
  FROM placed LEFT JOIN ways USING (r))
SELECT *, folded_root = root AS verified FROM whole"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": decontamination(), "op13_merkle": merkle()}
