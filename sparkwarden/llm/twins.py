"""DuckDB twins of the operators that need longer SQL."""

from __future__ import annotations


def crc32_sql(digits: str) -> str:
    """The unsigned crc32 of an ASCII text, bit by bit."""
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({digits}, ''), lambda ch: ascii(ch)::BIGINT)),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))))"""


def _field(name: str) -> str:
    return f"coalesce(strlen({name}::VARCHAR) || ':' || {name}::VARCHAR, '-')"


_FIELDS = " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars")))
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _tree(up: str, nodes: str) -> str:
    return f"""{up} AS (
  SELECT 0 AS level, grp, i, n, h FROM {nodes}
  UNION ALL
  SELECT level + 1, grp, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM {up} WHERE n > 1 GROUP BY level, grp, i // 8, n
), {up}_runs AS (SELECT level, grp, i // 8 AS p, list(h ORDER BY i) AS hs FROM {up} WHERE n > 1 GROUP BY level, grp, i // 8
)"""


def _walk(walk: str, start: str, up: str) -> str:
    return f"""{walk} AS (
  SELECT rid, grp, 0 AS level, i, h, proof FROM {start}
  UNION ALL
  SELECT w.rid, w.grp, w.level + 1, w.i // 8, sha256(array_to_string(hs[1:w.i % 8], '') || h || array_to_string(hs[w.i % 8 + 2:], '')),
    proof || array_to_string(hs[1:w.i % 8], '') || array_to_string(hs[w.i % 8 + 2:], '')
  FROM {walk} w JOIN {up}_runs r ON r.level = w.level AND r.grp = w.grp AND r.p = w.i // 8
)"""


MERKLE = f"""
WITH RECURSIVE rows_ AS (SELECT *, row_number() OVER () AS rid FROM documents
), leaves AS (
  SELECT rid, doc_id, coalesce('=' || lang, '') AS grp, sha256({_FIELDS} || {_field('text')}) AS leaf,
    CASE WHEN {crc32_sql('doc_id::VARCHAR')} % 3 = 0 THEN sha256({_FIELDS} || {_field(_LOWER)}) ELSE sha256({_FIELDS} || {_field('text')}) END AS presented
  FROM rows_
), base AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n, leaf AS h FROM leaves
), {_tree('up', 'base')}, subroots AS (SELECT grp AS lang_key, h AS subroot FROM up WHERE n = 1
), tops AS (
  SELECT lang_key, '' AS grp, row_number() OVER (ORDER BY encode(lang_key)) - 1 AS i, count(*) OVER () AS n, subroot AS h FROM subroots
), {_tree('top', 'tops')}, root AS (SELECT h AS root FROM top WHERE n = 1
), starts AS (SELECT rid, grp, i, presented AS h, '' AS proof FROM base
), {_walk('walk', 'starts', 'up')}, ends AS (SELECT rid, grp, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM walk GROUP BY rid, grp
), starts2 AS (SELECT e.rid, '' AS grp, t.i, e.h, e.proof FROM ends e JOIN tops t ON t.lang_key = e.grp
), {_walk('walk2', 'starts2', 'top')}, found AS (SELECT rid, arg_max(h, level) AS folded_root, arg_max(proof, level) AS proof FROM walk2 GROUP BY rid
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
FROM base JOIN subroots ON lang_key = grp JOIN found USING (rid), root
"""

TRIE = f"""
WITH turns AS (
  SELECT conv_id, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, length(coalesce(text, '')) AS chars
  FROM conversations WHERE conv_id IS NOT NULL
), lists AS (SELECT conv_id, list(struct_pack(k, chars) ORDER BY turn NULLS FIRST, k) AS l FROM turns GROUP BY conv_id
), shared AS (SELECT conv_id, l, {crc32_sql('conv_id::VARCHAR')} % 6 AS h FROM lists
), rebuilt AS (
  SELECT s.conv_id, list_concat(coalesce(b.l[1:s.h], []), s.l[s.h + 1:]) AS l FROM shared s LEFT JOIN lists b ON b.conv_id = s.conv_id - s.conv_id % 100
), steps AS (SELECT conv_id, len(l) AS n, unnest(range(0, len(l) + 1)) AS depth, l FROM rebuilt
), prefixes AS (SELECT conv_id, n, depth, list_transform(l[1:depth], lambda t: t.k) AS path, CASE WHEN depth > 0 THEN l[depth].chars ELSE 0 END AS chars FROM steps
), nodes AS (
  SELECT array_to_string(path, ',') AS key, array_to_string(path[1:depth - 1], ',') AS parent, path, depth, any_value(chars) AS chars, count(*) AS n_convs,
    min(conv_id) AS conv_id, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256
  FROM prefixes GROUP BY path, depth
), children AS (SELECT parent AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent
), own AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (key)
), spread AS (SELECT *, unnest(range(0, depth + 1)) AS top_depth FROM own
), sums AS (
  SELECT array_to_string(path[1:top_depth], ',') AS key, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens
  FROM spread GROUP BY 1
)
SELECT o.conv_id, o.depth, CASE WHEN o.depth > 0 THEN p.conv_id END AS parent_conv_id, o.n_convs, o.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens,
  o.ends_sha256
FROM own o JOIN sums s USING (key) LEFT JOIN own p ON p.key = o.parent
"""
