"""The training-data operators as registered queries, and their SQL where SQL can express them."""

from __future__ import annotations

from wiresift.llm import byte_bpe, exact_dedup, filter_audit, langid, line_dedup, merkle, mixing, nearest, ngram_join, packing, sharding, substring_dedup, toxicity

QUERIES = {
    "op1_best_two_fit": packing.op1_best_two_fit,
    "op2_subset_sum_mix": mixing.op2_subset_sum_mix,
    "op3_gear_chunk_dedup": substring_dedup.op3_gear_chunk_dedup,
    "op4_prefix_line_dedup": line_dedup.op4_prefix_line_dedup,
    "op5_one_bit_neighbours": nearest.op5_one_bit_neighbours,
    "op6_feistel_shards": sharding.op6_feistel_shards,
    "op7_minhash_forest_join": ngram_join.op7_minhash_forest_join,
    "op8_stream_dedup": exact_dedup.op8_stream_dedup,
    "op9_byte_gru_language": langid.op9_byte_gru_language,
    "op10_ordinal_toxicity": toxicity.op10_ordinal_toxicity,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_byte_bpe": byte_bpe.op12_byte_bpe,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

OP8 = """
WITH rows AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text) AS kept, sha256(text) AS text_sha256
FROM rows
"""

OP4 = r"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents),
lines AS (SELECT doc_id, no, s[no + 1] AS line FROM (SELECT doc_id, s, unnest(range(len(s))) AS no FROM split)),
each_word AS (
  SELECT DISTINCT doc_id, no, word
  FROM (SELECT doc_id, no, unnest(regexp_split_to_array(lower(line), '[\x20\x09-\x0D]+')) AS word FROM lines) WHERE word <> ''
),
sets AS (SELECT doc_id, no, list(word ORDER BY word) AS words FROM each_word GROUP BY doc_id, no),
firsts AS (SELECT words, min({'doc_id': doc_id, 'no': no}) AS spot FROM sets GROUP BY words),
numbered AS (SELECT row_number() OVER (ORDER BY spot) AS id, spot, words, len(words) AS n FROM firsts),
each AS (SELECT id, n, unnest(words) AS word FROM numbered),
common AS (SELECT word, count(*) AS df FROM each GROUP BY word),
placed AS (SELECT id, n, word, row_number() OVER (PARTITION BY id ORDER BY df, word) AS place FROM each JOIN common USING (word)),
prefix AS (SELECT * FROM placed WHERE place <= n - ceil(0.8 * n - 1e-9) + 1),
pairs AS (
  SELECT DISTINCT a.id AS x, b.id AS y FROM prefix a JOIN prefix b ON a.word = b.word AND a.id < b.id
  WHERE least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) - 1e-9
),
gone AS (
  SELECT DISTINCT y FROM pairs JOIN numbered a ON a.id = x JOIN numbered b ON b.id = y
  WHERE len(list_intersect(a.words, b.words)) >= 0.8 * (a.n + b.n - len(list_intersect(a.words, b.words))) - 1e-9
),
kept AS (SELECT spot.doc_id AS doc_id, spot.no AS no FROM numbered WHERE id NOT IN (SELECT y FROM gone)),
marked AS (
  SELECT l.doc_id, l.no, l.line, s.words IS NULL OR k.no IS NOT NULL AS stays FROM lines l
  LEFT JOIN sets s ON s.doc_id = l.doc_id AND s.no = l.no LEFT JOIN kept k ON k.doc_id = l.doc_id AND k.no = l.no
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE stays), '') AS text,
       count(*)::INTEGER AS lines, count(*) FILTER (WHERE NOT stays)::INTEGER AS removed_lines
FROM marked GROUP BY doc_id
"""

OP11 = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
measured AS (
  SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, length(text) AS points,
         length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS capitals, min(doc_id) OVER (PARTITION BY text) AS least
  FROM texts
),
masks AS (
  SELECT doc_id, part, (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT + 4 * (100 * capitals > 10 * points)::INT
           + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > least, false)::INT AS fails
  FROM measured
),
said AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
cells AS (
  SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM masks LEFT JOIN said USING (doc_id) GROUP BY part, fails
),
filters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS f(name, bit)),
orders AS (
  SELECT [a, b, c, d, e] AS o FROM filters a, filters b, filters c, filters d, filters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
),
steps AS (
  SELECT array_to_string(list_transform(o, lambda f: f.name), '') AS filter_order, step, o[step].bit AS own,
         coalesce(list_sum(list_transform(o[1:step - 1], lambda f: f.bit)), 0)::INT AS earlier
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
),
each AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (WHERE fails & (own | earlier) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (WHERE fails & own <> 0 AND fails & earlier = 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE fails & own <> 0 AND fails & earlier <> 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (WHERE fails = own), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (WHERE fails & own <> 0 AND fails & earlier = 0), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (WHERE fails & own <> 0 AND fails & earlier = 0), 0)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley
FROM each
"""

OP13 = """
WITH RECURSIVE
polynomial AS (SELECT 3988292384::BIGINT AS p),
marked AS (
  SELECT doc_id, lang, source, n_chars, text, coalesce(xor(list_reduce(
           list_transform(range(1, strlen(doc_id::VARCHAR) + 1), lambda i: ord(substr(doc_id::VARCHAR, i::INTEGER, 1))::BIGINT),
           lambda crc, byte: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, p) ELSE c >> 1 END, xor(crc, byte)),
           4294967295::BIGINT), 4294967295) % 7 = 0, false) AS hit
  FROM documents, polynomial
),
part AS (
  SELECT doc_id, lang, hit, n_chars,
         coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source)::VARCHAR || ':' || source, '-')
           || coalesce(strlen(lang)::VARCHAR || ':' || lang, '-') AS head,
         coalesce(strlen(text)::VARCHAR || ':' || text, '-') AS tail
  FROM marked
),
leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') || tail) AS leaf,
         sha256(head || coalesce(strlen((n_chars + hit::INT)::VARCHAR)::VARCHAR || ':' || (n_chars + hit::INT)::VARCHAR, '-') || tail) AS claimed
  FROM part
),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS LAST, leaf) - 1 AS idx
  FROM leaves
),
nodes AS (
  SELECT tree, 0 AS level, idx, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM placed
  UNION ALL
  SELECT tree, level + 1, idx // 2, digest, (n + 1) // 2
  FROM (SELECT tree, level, idx, n, sha256(digest || coalesce(lead(digest) OVER (PARTITION BY tree ORDER BY idx), '')) AS digest FROM nodes WHERE n > 1)
  WHERE idx % 2 = 0
),
subroots AS (SELECT tree, digest FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, tree AS idx, digest, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, idx // 2, digest, (n + 1) // 2
  FROM (SELECT level, idx, n, sha256(digest || coalesce(lead(digest) OVER (ORDER BY idx), '')) AS digest FROM tops WHERE n > 1)
  WHERE idx % 2 = 0
),
steps AS (
  SELECT p.tree, p.idx, a.level AS step, (p.idx >> a.level) % 2 AS side, b.digest AS sibling
  FROM placed p JOIN nodes a ON a.tree = p.tree AND a.idx = p.idx >> a.level AND a.n > 1
  LEFT JOIN nodes b ON b.tree = a.tree AND b.level = a.level AND b.idx = xor(a.idx, 1)
  UNION ALL
  SELECT p.tree, p.idx, 1000 + a.level, (p.tree >> a.level) % 2, b.digest
  FROM placed p JOIN tops a ON a.idx = p.tree >> a.level AND a.n > 1
  LEFT JOIN tops b ON b.level = a.level AND b.idx = xor(a.idx, 1)
),
proofs AS (
  SELECT tree, idx, list({'side': side, 'sibling': coalesce(sibling, '')} ORDER BY step) AS proof, string_agg(coalesce(sibling, ''), '' ORDER BY step) AS siblings
  FROM steps GROUP BY tree, idx
),
folded AS (
  SELECT p.*, s.digest AS subroot, r.digest AS root, sha256(coalesce(q.siblings, '')) AS proof_sha256,
         coalesce(list_reduce(list_transform(q.proof, lambda x: x.side::VARCHAR || x.sibling),
                              lambda d, x: sha256(CASE x[1] WHEN '0' THEN d || x[2:] ELSE x[2:] || d END), claimed), claimed) AS folded_root
  FROM placed p JOIN subroots s USING (tree) CROSS JOIN (SELECT digest FROM tops WHERE n = 1) r LEFT JOIN proofs q ON q.tree = p.tree AND q.idx = p.idx
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified, lang, idx AS leaf_idx FROM folded
"""

ORACLE: dict[str, str] = {
    "op4_prefix_line_dedup": OP4,
    "op8_stream_dedup": OP8,
    "op11_filter_audit": OP11,
    "op13_merkle_manifest": OP13,
}
