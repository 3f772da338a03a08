"""SQL that the clustering and the manifest must equal, without bounds, histograms or tries."""

from __future__ import annotations


def clusters_sql(rounds: int = 3, clusters: int = 16, size: int = 64) -> str:
    """Every round as it is defined: all distances, the nearest centroid, floors of means."""
    square = "list_sum([(v.x[i] - c.x[i]) * (v.x[i] - c.x[i]) FOR i IN range(1, {n} + 1)])".format(n=size)
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [floor(64 * e::DOUBLE)::BIGINT FOR e IN embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {size} AND len([e FOR e IN embedding IF e IS NULL OR NOT isfinite(e::DOUBLE)]) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR), x) - 1 AS k, x FROM v ORDER BY sha256('1:' || vec_id::VARCHAR), x LIMIT {clusters})",
    ]
    for n in range(rounds + 1):
        parts.append(f"a{n} AS MATERIALIZED (SELECT v.r, arg_min(c.k, ({square}, c.k)) AS k, min({square}) AS d FROM v, c{n} c GROUP BY v.r)")
        if n < rounds:
            total = "list_transform(range(1, {n} + 1), lambda i: s.x[i])".format(n=size)
            sums = ", ".join(f"sum(x[{i}])" for i in range(1, size + 1))
            parts.append(f"s{n} AS MATERIALIZED (SELECT k, count(*)::HUGEINT AS n, [{sums}] AS x FROM a{n} JOIN v USING (r) GROUP BY k)")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT c.k, CASE WHEN s.n IS NULL THEN c.x ELSE [((t - ((t % s.n) + s.n) % s.n) // s.n)::BIGINT FOR t IN {total}] END AS x FROM c{n} c LEFT JOIN s{n} s USING (k))")
    return f"""WITH {', '.join(parts)}
SELECT vec_id, k::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} c USING (k)"""


def _framed(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"


#: CRC-32 bit by bit, with the polynomial of the standard.
_CRC = """(xor(list_reduce([4294967295::BIGINT] || [ascii(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')],
  lambda c, b: list_reduce([xor(c, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END)), 4294967295::BIGINT))"""

_LEAF = " || ".join(_framed(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
_FORGED = " || ".join(_framed(c) for c in ("doc_id", "source", "lang", "(n_chars + 1)", "text"))

#: Trees level by level; then every leaf climbs, one level a step, with the sibling that stands there.
MERKLE = f"""
WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS g, sha256({_LEAF}) AS leaf, CASE WHEN doc_id IS NOT NULL AND {_CRC} % 7 = 0 THEN sha256({_FORGED}) ELSE sha256({_LEAF}) END AS forged FROM documents
), placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
tree(g, level, i, node, n) AS (
  SELECT g, 0, i, leaf, count(*) OVER (PARTITION BY g) FROM placed
  UNION ALL
  SELECT g, level + 1, i // 2, sha256(string_agg(node, '' ORDER BY i)), (max(n) + 1) // 2 FROM tree WHERE n > 1 GROUP BY g, level, i // 2
), subroots AS MATERIALIZED (SELECT g, node AS subroot, row_number() OVER (ORDER BY g) - 1 AS i FROM tree WHERE n = 1),
top(level, i, node, n) AS (
  SELECT 0, i, subroot, count(*) OVER () FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, sha256(string_agg(node, '' ORDER BY i)), (max(n) + 1) // 2 FROM top WHERE n > 1 GROUP BY level, i // 2
), nodes AS MATERIALIZED (SELECT g, level, i, node, n FROM tree UNION ALL SELECT NULL, level, i, node, n FROM top),
depth AS (SELECT g, max(level) AS levels FROM nodes GROUP BY g),
way AS MATERIALIZED (
  SELECT p.doc_id, p.leaf, p.i AS leaf_i, p.g AS of, p.forged, s.subroot, d.levels AS own, t.levels AS above, s.i AS place FROM placed p JOIN subroots s ON s.g = p.g JOIN depth d ON d.g = p.g, (SELECT levels FROM depth WHERE g IS NULL) t
), climb(of, leaf_i, step, node, said) AS (
  SELECT of, leaf_i, 0, forged, '' FROM way
  UNION ALL
  SELECT c.of, c.leaf_i, step + 1, CASE WHEN x.node IS NULL THEN sha256(c.node) WHEN x.i < c.spot THEN sha256(x.node || c.node) ELSE sha256(c.node || x.node) END, said || coalesce(x.node, '')
  FROM (SELECT c.*, CASE WHEN step < own THEN c.of END AS g, CASE WHEN step < own THEN step ELSE step - own END AS level, CASE WHEN step < own THEN c.leaf_i >> step ELSE place >> (step - own) END AS spot
        FROM climb c JOIN way w ON w.of = c.of AND w.leaf_i = c.leaf_i WHERE step < own + above) c
  LEFT JOIN nodes x ON x.g IS NOT DISTINCT FROM c.g AND x.level = c.level AND x.i = xor(c.spot, 1)
)
SELECT w.doc_id, w.leaf, w.subroot, r.node AS root, sha256(c.said) AS proof_sha256, c.node AS folded_root, c.node = r.node AS verified
FROM way w JOIN climb c ON c.of = w.of AND c.leaf_i = w.leaf_i AND c.step = w.own + w.above, (SELECT node FROM top WHERE n = 1) r
"""
