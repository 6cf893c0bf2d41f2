"""The thin registered queries of vectors and conversations, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import prefixtrie, util, vectorcode, vectordup


def op11_hilbert_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcode.encode(util.table(spark, sf_dir, "embeddings"))


def _op11_sql() -> str:
    """Plain rounds over all parts and entries."""
    parts, entries, rounds = vectorcode.PARTS, vectorcode.ENTRIES, vectorcode.ROUNDS
    steps = [f"""
v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({vectorcode.SCALE} * x::DOUBLE)::BIGINT) AS z FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, z[part * (len(z) // {parts}) + 1 : (part + 1) * (len(z) // {parts})] AS z FROM v, (SELECT unnest(range({parts})) AS part)),
c0 AS MATERIALIZED (SELECT part, entry, z FROM (SELECT part, z, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM p) WHERE entry < {entries})"""]
    near = """
d{k} AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, (far, entry)) AS entry, min(far) AS far, any_value(z) AS z FROM (
  SELECT p.vec_id, p.part, c.entry, p.z, list_sum(list_transform(range(1, len(p.z) + 1), lambda i: (p.z[i] - c.z[i]) * (p.z[i] - c.z[i])))::BIGINT AS far
  FROM p JOIN c{k} c ON p.part = c.part) GROUP BY vec_id, part)"""
    new = """
c{n} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(u.z, c.z) AS z FROM c{k} c LEFT JOIN (
  SELECT part, entry, list(((s - (((s % n) + n) % n)) // n)::BIGINT ORDER BY pos) AS z FROM (
    SELECT part, entry, pos, sum(x) AS s, count(*) AS n FROM (SELECT part, entry, generate_subscripts(z, 1) AS pos, unnest(z) AS x FROM d{k}) GROUP BY part, entry, pos)
  GROUP BY part, entry) u ON c.part = u.part AND c.entry = u.entry)"""
    for k in range(rounds):
        steps += [near.format(k=k), new.format(k=k, n=k + 1)]
    steps += [near.format(k=rounds), f"""
r AS MATERIALIZED (SELECT vec_id, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM d{rounds} GROUP BY vec_id),
b AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM (
  SELECT part, entry, generate_subscripts(z, 1) AS pos, unnest(z) AS x FROM c{rounds}))"""]
    return "WITH " + ",".join(steps) + """
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN r USING (vec_id), b"""


def op12_cross_polytope_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectordup.groups(util.table(spark, sf_dir, "embeddings"))


OP12_SQL = f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= {vectordup.LEAST}),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
k AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN k ON vec_id = k.a LEFT JOIN n ON vec_id = n.a
"""


def op13_centroid_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.build(util.table(spark, sf_dir, "conversations"))


#: Nodes are lists of turns; a subtree is summed by giving each node's figures to all its prefixes.
OP13_SQL = """
WITH o AS (SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT c, own, c - c % 5 AS b, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda s, x: list_reduce(list_prepend(xor(s, x), list_transform(range(8), lambda i: i::BIGINT)), lambda s, i: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END)),
    4294967295::BIGINT) % 9 AS h FROM o),
t AS MATERIALIZED (SELECT h.c, list_concat(coalesce(b.own, [])[1:h.h], h.own[h.h + 1 :]) AS turns FROM h LEFT JOIN o b ON h.b = b.c),
m AS (SELECT c, d, turns[1:d] AS node, d = len(turns) AS ends FROM t, LATERAL (SELECT unnest(range(len(turns) + 1)) AS d)),
n AS MATERIALIZED (SELECT node, d, min(c) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY node, d),
k AS (SELECT p.node, count(*) AS n_children FROM n JOIN n p ON n.d = p.d + 1 AND n.node[1:p.d] = p.node GROUP BY p.node),
a AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.d > 0 THEN (n.n_convs - 1) * strlen(n.node[n.d].t) ELSE 0 END AS own FROM n LEFT JOIN k ON n.node = k.node),
s AS (SELECT node[1:up] AS node, up AS d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum(own)::BIGINT AS saved_tokens
  FROM a, LATERAL (SELECT unnest(range(a.d + 1)) AS up) GROUP BY 1, 2)
SELECT a.conv_id, a.d AS depth, p.conv_id AS parent_conv_id, a.n_convs, a.n_children, s.n_leaves, s.saved_tokens, a.ends_sha256
FROM a JOIN s ON a.node = s.node AND a.d = s.d LEFT JOIN n p ON a.d = p.d + 1 AND a.node[1:p.d] = p.node
"""


QUERIES = {
    "op11_hilbert_vector_codes": op11_hilbert_vector_codes,
    "op12_cross_polytope_groups": op12_cross_polytope_groups,
    "op13_centroid_prefix_trie": op13_centroid_prefix_trie,
}
ORACLE_SQL = {
    "op11_hilbert_vector_codes": _op11_sql(),
    "op12_cross_polytope_groups": OP12_SQL,
    "op13_centroid_prefix_trie": OP13_SQL,
}
