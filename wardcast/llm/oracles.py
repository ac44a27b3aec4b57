"""SQL for the queries that SQL can express, written from the contracts."""

from __future__ import annotations

from wardcast.llm import url_rules
from wardcast.llm.queries import URL_RULES


def exact_dedup() -> str:
    return r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
FROM n JOIN g USING (t)
"""


def url_verdicts() -> str:
    """Rules by text; terms of the vocabulary by one pattern each."""
    upper, lower = url_rules.UPPER, url_rules.LOWER
    words = url_rules.Vocabulary()
    test = lambda term: f"regexp_matches(low, '(^|[^a-z0-9]){term}($|[^a-z0-9])')"  # noqa: E731
    strict = " + ".join(f"{test(t)}::INT" for t in words.strict)
    soft = " + ".join(f"{test(t)}::INT" for t, _ in words.soft)
    weight = " + ".join(f"CASE WHEN {test(t)} THEN {w}::DOUBLE ELSE 0 END" for t, w in words.soft)
    rules = ", ".join(
        f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in URL_RULES
    )
    return rf"""
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{upper}', '{lower}'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         translate(coalesce(url, ''), '{upper}', '{lower}') AS low, row_number() OVER () AS k
  FROM pages
), rules(verdict, name, rule_host, rule_path) AS (VALUES {rules}
), best AS (
  SELECT k, arg_max(name, length(name)) AS rule, arg_max(verdict, length(name)) AS rule_verdict
  FROM u JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY k
), hits AS (
  SELECT *, ({strict})::INT AS n_strict, ({soft})::INT AS n_soft, {weight} AS soft_weight FROM u
)
SELECT page_id, host, path, rule,
       coalesce(rule_verdict, CASE WHEN n_strict > 0 OR n_soft >= {words.distinct} AND soft_weight >= {words.limit}
                              THEN 'block' ELSE 'allow' END) AS verdict,
       n_strict, n_soft, soft_weight
FROM hits LEFT JOIN best USING (k)
"""


def hard_negatives() -> str:
    """Every row scored against every anchor of the table, component by component."""
    return """
WITH rows AS (
  SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS parts
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.k AS anchor, a.vec_id AS anchor_id, a.label = r.label AS same, r.k, r.vec_id,
         coalesce(list_sum(list_transform(list_zip(a.parts, r.parts), lambda p: coalesce(p[1] * p[2], 0))), 0)::BIGINT AS score
  FROM rows a JOIN rows r ON a.vec_id % 100 = 0
), positives AS (
  SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, k) AS nth
  FROM scored WHERE same AND k <> anchor QUALIFY nth <= 5
), negatives AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.nth ORDER BY n.score DESC, n.vec_id, n.k) AS rank
  FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same
   AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE rank <= 10
"""


def prefix_trie() -> str:
    """Prefixes as chained digests; subtree sums by the members' paths below each node."""
    return r"""
WITH RECURSIVE steps AS (
  SELECT b, 0 AS k, b::BIGINT AS c FROM range(256) t(b)
  UNION ALL
  SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8
), ids AS (SELECT DISTINCT conv_id, conv_id::VARCHAR AS digits FROM conversations WHERE conv_id IS NOT NULL
), crcs AS (
  SELECT conv_id, digits, 0 AS k, 4294967295::BIGINT AS c FROM ids
  UNION ALL
  SELECT conv_id, digits, k + 1, xor(c >> 8, t[1 + (xor(c, ascii(substr(digits, k + 1, 1))::BIGINT) & 255)])
  FROM crcs, crc_table WHERE k < length(digits)
), heads AS (SELECT conv_id, xor(c, 4294967295) % 4 AS h FROM crcs WHERE k = length(digits)
), own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), rebuilt AS (
  SELECT h.conv_id, o.i, 0 AS part, role, text FROM heads h JOIN own o ON o.conv_id = h.conv_id - h.conv_id % 20 AND o.i <= h.h
  UNION ALL
  SELECT h.conv_id, o.i, 1 AS part, role, text FROM heads h JOIN own o ON o.conv_id = h.conv_id AND o.i > h.h
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, i) AS depth, count(*) OVER (PARTITION BY conv_id) AS len,
         len(list_filter(regexp_split_to_array(text, '[ 	-]+'), lambda w: w <> '')) AS words,
         md5(length(role)::VARCHAR || ':' || role || text) AS turn_key
  FROM rebuilt
), paths AS (
  SELECT conv_id, depth, len, words, md5(string_agg(turn_key, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM placed
  UNION ALL
  SELECT conv_id, 0, (SELECT count(*) FROM placed p WHERE p.conv_id = h.conv_id), 0, '' FROM heads h
), nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words, count(*) = count(*) FILTER (len = depth) AS leaf,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len = depth), '')) AS ends_sha256
  FROM paths GROUP BY node, depth
), up AS (
  SELECT p.node, p.depth, q.node AS above FROM nodes n JOIN paths p ON p.node = n.node AND p.depth = n.depth AND p.conv_id = n.conv_id
  JOIN paths q ON q.conv_id = p.conv_id AND q.depth <= p.depth
), sums AS (
  SELECT above AS node, count(*) FILTER (leaf) AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens
  FROM up JOIN nodes USING (node) GROUP BY above
), links AS (
  SELECT p.node, q.node AS parent FROM nodes n JOIN paths p ON p.node = n.node AND p.depth = n.depth AND p.conv_id = n.conv_id
  JOIN paths q ON q.conv_id = p.conv_id AND q.depth = p.depth - 1
), kids AS (SELECT parent AS node, count(*) AS n_children FROM links GROUP BY parent)
SELECT n.conv_id, n.depth::BIGINT AS depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
       n_leaves, saved_tokens, n.ends_sha256
FROM nodes n JOIN sums USING (node) LEFT JOIN kids USING (node) LEFT JOIN links l ON l.node = n.node LEFT JOIN nodes m ON m.node = l.parent
"""


def all_sql() -> dict[str, str]:
    return {
        "op10_exact_dedup": exact_dedup(),
        "op11_hard_negatives": hard_negatives(),
        "op12_prefix_trie": prefix_trie(),
        "op5_url_rules": url_verdicts(),
    }
