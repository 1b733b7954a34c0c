"""DuckDB SQL for the operators that SQL can express, by plain joins."""

from __future__ import annotations

WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}\p{{M}}]+')"

OP1 = rf"""WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents WHERE text IS NOT NULL),
sets AS (SELECT *, list_sort(list_distinct({WORDS.format("line")})) AS s FROM lines),
classes AS (SELECT s, len(s) AS n, min(doc_id * 1000000 + no) AS at_ FROM sets WHERE len(s) > 0 GROUP BY s),
words AS (SELECT at_, n, s, unnest(s) AS w FROM classes),
df AS (SELECT w, count(*) AS c FROM words GROUP BY w),
ranked AS (SELECT at_, n, s, w, row_number() OVER (PARTITION BY at_ ORDER BY c, w) AS k FROM words JOIN df USING (w)),
prefix AS (SELECT * FROM ranked WHERE k <= n - ceil(0.8 * n - 1e-9) + 1),
pairs AS (SELECT DISTINCT b.at_, a.s AS x, b.s AS y FROM prefix a JOIN prefix b ON a.w = b.w AND a.at_ < b.at_ AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) - 1e-9),
gone AS (SELECT DISTINCT at_ FROM pairs WHERE len(list_intersect(x, y)) >= 0.8 * (len(x) + len(y) - len(list_intersect(x, y))) - 1e-9),
kept AS (SELECT sets.doc_id, sets.no, sets.line FROM sets LEFT JOIN classes ON sets.s = classes.s
  WHERE classes.at_ IS NULL OR (classes.at_ = sets.doc_id * 1000000 + sets.no AND classes.at_ NOT IN (SELECT at_ FROM gone))),
left_ AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY no) AS t FROM kept GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(t, '') END AS text FROM documents LEFT JOIN left_ USING (doc_id)"""

OP6 = rf"""WITH RECURSIVE words AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
spots AS (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS k FROM words WHERE len(w) > 0),
bags AS (SELECT doc_id, array_to_string(w[k:k + 4], ' ') AS s, count(*) AS n FROM spots GROUP BY ALL),
sizes AS (SELECT doc_id, sum(n) AS size FROM bags GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS common FROM bags a JOIN bags b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE common >= 0.8 * (x.size + y.size - common)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a)
SELECT a AS doc_id, min(b) AS class_id, min(b) = a AS kept FROM reach GROUP BY a"""

OP9 = """WITH RECURSIVE good AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) >= 0.98 * sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v))),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
groups AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM groups LEFT JOIN counts USING (vec_id)"""

#: One step of the checksum's division for a byte x, bit by bit.
CRC_STEP = "list_reduce(list_concat([xor(a, x)], range(8)), lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)"
CRC = f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({{0}}::VARCHAR, ''), lambda t: ord(t)::BIGINT)), lambda a, x: {CRC_STEP}), 4294967295)"

OP12_NEAREST = """
a{0} AS MATERIALIZED (SELECT vec_id, p, min((list_dot_product(x, x) - 2 * list_dot_product(x, y) + list_dot_product(y, y))::BIGINT * 256 + b{0}.e) AS m FROM parts JOIN b{0} USING (p) GROUP BY ALL),"""
OP12_ROUND = (
    OP12_NEAREST
    + """
m{0} AS (SELECT p, e, list(f ORDER BY j) AS y FROM (
  SELECT p, m % 256 AS e, j, floor(sum(x[j]) / count(*)) AS f FROM a{0} JOIN parts USING (vec_id, p), (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM parts))) AS j) GROUP BY ALL) GROUP BY p, e),
b{1} AS MATERIALIZED (SELECT p, e, coalesce(m{0}.y, b{0}.y) AS y FROM b{0} LEFT JOIN m{0} USING (p, e)),"""
)
OP12 = (
    """WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, label, e, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS x FROM kept, (SELECT unnest(range(4)) AS p)),
b0 AS MATERIALIZED (SELECT p, e, x AS y FROM parts WHERE e < 256),"""
    + "".join(OP12_ROUND.format(r, r + 1) for r in range(4))
    + OP12_NEAREST.format(4)
    + """
books AS (SELECT sha256(string_agg(f::BIGINT::VARCHAR, ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM (SELECT p, e, unnest(y) AS f, generate_subscripts(y, 1) AS j FROM b4)),
codes AS (SELECT vec_id, string_agg(format('{:02x}', m % 256), '' ORDER BY p) AS code, sum(m // 256)::BIGINT AS error FROM a4 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM codes JOIN kept USING (vec_id), books"""
)

OP13 = rf"""WITH turns AS (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list({{'r': r, 'x': x}} ORDER BY turn NULLS FIRST, sha256(length(r) || ':' || r || x)) AS o, ({CRC.format("c")}) % 4 AS h FROM turns GROUP BY c),
seqs AS (SELECT a.c, list_concat(coalesce(b.o, [])[1:a.h], a.o[a.h + 1:]) AS s FROM own a LEFT JOIN own b ON b.c = a.c - a.c % 20),
spots AS (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM seqs),
nodes AS (SELECT s[1:d] AS p, d, min(c) AS conv_id, count(*) AS n FROM spots GROUP BY ALL),
kids AS (SELECT p[1:d - 1] AS p, count(*) AS k FROM nodes WHERE d > 0 GROUP BY ALL),
worth AS (SELECT p, d, coalesce(k, 0) AS k, CASE WHEN d = 0 THEN 0 ELSE (n - 1) * len(regexp_extract_all(p[d].x, '[^ 	-
]+')) END AS v FROM nodes LEFT JOIN kids USING (p)),
above AS (SELECT p, v, k, unnest(range(0, d + 1)) AS u FROM worth),
below AS (SELECT p[1:u] AS p, sum(v)::BIGINT AS saved, count(*) FILTER (k = 0) AS leaves FROM above GROUP BY ALL),
ends AS (SELECT s AS p, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS h FROM seqs GROUP BY ALL)
SELECT a.conv_id, a.d AS depth, b.conv_id AS parent_conv_id, a.n AS n_convs, worth.k AS n_children, leaves AS n_leaves, saved AS saved_tokens, coalesce(h, sha256('')) AS ends_sha256
FROM nodes a JOIN worth USING (p) JOIN below USING (p) LEFT JOIN ends USING (p) LEFT JOIN nodes b ON a.d > 0 AND b.p = a.p[1:a.d - 1]"""

ORACLES = {"op1_line_dedup": OP1, "op6_minhash_near_dedup": OP6, "op9_vector_near_dedup": OP9, "op12_vector_codes": OP12, "op13_prefix_trie": OP13}
