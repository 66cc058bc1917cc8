"""DuckDB SQL for the queries whose whole result SQL can say; the tables' ids are unique there."""

_WORDS = r"""w AS (SELECT doc_id, [x for x in string_split_regex({text}, '[\x20\x09-\x0D]+') if x <> ''] AS ws FROM documents)"""
_REACH = """e AS (SELECT a, b FROM link UNION SELECT b, a FROM link), r(node, top) AS (SELECT a, a FROM e UNION SELECT e.b, r.top FROM r JOIN e ON r.node = e.a),
c AS (SELECT node, min(top) AS top FROM r GROUP BY 1)"""

OP3 = f"""WITH RECURSIVE {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")},
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN [array_to_string(ws[i:i+4], ' ') for i in range(1, len(ws) - 3)] WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
p AS (SELECT doc_id, unnest(s) AS sh FROM s),
meets AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM p x JOIN p y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM meets JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * k >= 85 * (len(x.s) + len(y.s) - k)), {_REACH}
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(top, doc_id) AS component_id, doc_id = coalesce(top, doc_id) AS kept FROM s LEFT JOIN c ON node = doc_id"""

OP8 = f"""WITH {_WORDS.format(text="coalesce(text, '')")},
v AS (SELECT doc_id, i, array_to_string(ws[i:i+19], ' ') AS words FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)),
late AS (SELECT doc_id, i FROM v QUALIFY row_number() OVER (PARTITION BY words ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM late),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS t FROM each ANTI JOIN gone USING (doc_id, pos) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

OP9 = f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
 AND list_bool_and([y IS NOT NULL AND isfinite(y) for y in embedding]) AND list_bool_or([y <> 0 for y in embedding])),
u AS (SELECT *, sqrt(list_dot_product(x, x)) AS size FROM v),
link AS (SELECT p.vec_id AS a, q.vec_id AS b FROM u p JOIN u q ON p.label = q.label AND p.vec_id < q.vec_id AND len(p.x) = len(q.x) WHERE list_dot_product(p.x, q.x) / (p.size * q.size) >= 0.93), {_REACH},
n AS (SELECT a, count(*) AS n FROM e GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(top, vec_id) AS component_id, vec_id = coalesce(top, vec_id) AS kept FROM embeddings LEFT JOIN c ON node = vec_id LEFT JOIN n ON n.a = vec_id"""
