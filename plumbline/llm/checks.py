"""SQL of the operators whose results DuckDB can compute on its own: set joins, hash trees, hashed n-gram weights."""

# CRC-32 is folded bit by bit over the bytes of every distinct n-gram.
RESAMPLING = r"""
WITH split AS (
  SELECT 0 AS target, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
found AS (SELECT target, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS gram FROM split),
per_gram AS (SELECT gram, count(*) FILTER (WHERE target = 0) AS raw, count(*) FILTER (WHERE target = 1) AS wanted FROM found GROUP BY gram),
bytes AS (SELECT *, hex(encode(gram)) AS hexed FROM per_gram),
hashed AS (
  SELECT gram, raw, wanted, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(hexed), 2), lambda k: ('0x' || hexed[k:k + 1])::UBIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::UBIGINT[]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))),
    4294967295::UBIGINT) % 10000 AS bucket FROM bytes),
shares AS (SELECT bucket, sum(raw)::DOUBLE AS s, sum(wanted)::DOUBLE AS t FROM hashed GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM shares),
weighed AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight
  FROM found JOIN hashed USING (gram) JOIN gains USING (bucket) WHERE target = 0 GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || d.doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM split d LEFT JOIN weighed USING (doc_id) WHERE d.target = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_words >= 20 AND place <= 5 * (SELECT count(*) FROM scored WHERE n_words >= 20) // 100 THEN place END AS rank
FROM ranked"""

# Trees grow level by level; a path lists the sibling of each level, or none, and is folded from the leaf.
MERKLE = r"""
WITH RECURSIVE
hashed AS (
  SELECT doc_id, lang, n_chars, sha256(coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id::VARCHAR, '-') || coalesce(octet_length(encode(source::VARCHAR)) || ':' || source::VARCHAR, '-') || coalesce(octet_length(encode(lang::VARCHAR)) || ':' || lang::VARCHAR, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars::VARCHAR, '-') || coalesce(octet_length(encode(text::VARCHAR)) || ':' || text::VARCHAR, '-')) AS leaf, sha256(coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id::VARCHAR, '-') || coalesce(octet_length(encode(source::VARCHAR)) || ':' || source::VARCHAR, '-') || coalesce(octet_length(encode(lang::VARCHAR)) || ':' || lang::VARCHAR, '-') || coalesce(octet_length(encode((n_chars + 1)::VARCHAR)) || ':' || (n_chars + 1)::VARCHAR, '-') || coalesce(octet_length(encode(text::VARCHAR)) || ':' || text::VARCHAR, '-')) AS changed,
    list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: ascii((doc_id::VARCHAR)[k])::UBIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::UBIGINT[]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))) AS crc
  FROM documents),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place
  FROM hashed),
nodes AS (
  SELECT tree, 0 AS level, place, leaf AS h, count(*) OVER (PARTITION BY tree) AS width FROM placed
  UNION ALL
  SELECT tree, level + 1, place // 2, sha256(string_agg(h, '' ORDER BY place)), any_value((width + 1) // 2)
  FROM nodes WHERE width > 1 GROUP BY tree, level, place // 2),
subroots AS (SELECT tree, h FROM nodes WHERE width = 1),
tops AS (
  SELECT 0 AS level, tree AS place, h, count(*) OVER () AS width FROM subroots
  UNION ALL
  SELECT level + 1, place // 2, sha256(string_agg(h, '' ORDER BY place)), any_value((width + 1) // 2)
  FROM tops WHERE width > 1 GROUP BY level, place // 2),
low AS (
  SELECT p.tree, p.place, l.level, s.h, s.place < (p.place >> l.level) AS before
  FROM placed p JOIN (SELECT DISTINCT tree, level FROM nodes WHERE width > 1) l ON l.tree = p.tree
  LEFT JOIN nodes s ON s.tree = l.tree AND s.level = l.level AND s.place = xor(p.place >> l.level, 1)),
high AS (
  SELECT p.tree, p.place, 1000 + l.level AS level, s.h, s.place < (p.tree >> l.level) AS before
  FROM placed p CROSS JOIN (SELECT DISTINCT level FROM tops WHERE width > 1) l
  LEFT JOIN tops s ON s.level = l.level AND s.place = xor(p.tree >> l.level, 1)),
paths AS (
  SELECT tree, place, list({'h': coalesce(h, ''), 'before': coalesce(before, false)} ORDER BY level) AS path FROM (FROM low UNION ALL FROM high) GROUP BY tree, place),
proven AS (
  SELECT p.*, coalesce(path, []) AS path, if(xor(crc, 4294967295::UBIGINT) % 7 = 0 AND n_chars IS NOT NULL, changed, leaf) AS begins
  FROM placed p LEFT JOIN paths USING (tree, place)),
folded AS (
  SELECT *, list_reduce(list_prepend({'h': begins, 'before': false}, path),
    lambda a, x: {'h': sha256(if(x.before, x.h || a.h, a.h || x.h)), 'before': false}).h AS folded_root FROM proven)
SELECT doc_id, leaf, s.h AS subroot, t.h AS root, sha256(array_to_string(list_transform(path, lambda x: x.h), '')) AS proof_sha256,
  folded_root, folded_root = t.h AS verified
FROM folded JOIN subroots s USING (tree) CROSS JOIN (SELECT h FROM tops WHERE width = 1) t"""

# All sets that share a shingle are compared; the least id that links reach is the component.
NEAR = r"""
WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS grams FROM split),
kinds AS (SELECT list_sort(grams) AS grams, min(doc_id) AS first, list(doc_id) AS members FROM sets WHERE len(grams) > 0 GROUP BY list_sort(grams)),
flat AS (SELECT first, len(grams) AS n, unnest(grams) AS gram FROM kinds),
pairs AS (
  SELECT a.first AS a, b.first AS b FROM flat a JOIN flat b ON a.gram = b.gram AND a.first < b.first AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.first, b.first, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT first AS node, first AS least FROM kinds UNION SELECT e.b, r.least FROM reach r JOIN edges e ON e.a = r.node WHERE r.least < e.b),
least_of AS (SELECT node AS first, min(least) AS component_id FROM reach GROUP BY node),
owned AS (SELECT unnest(members) AS doc_id, component_id FROM kinds JOIN least_of USING (first))
SELECT s.doc_id, len(grams)::BIGINT AS n_shingles, coalesce(component_id, s.doc_id) AS component_id, coalesce(component_id, s.doc_id) = s.doc_id AS kept
FROM sets s LEFT JOIN owned USING (doc_id)"""
