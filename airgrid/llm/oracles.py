"""DuckDB SQL of the queries that SQL can express on whole tables."""

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP9 = f"""
WITH docs AS (SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, {_WORDS.format(text='text')} AS w, text FROM docs),
spread AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM words),
windows AS (SELECT doc_id, i, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM spread WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
threes AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x, y, z) AS n FROM windows WHERE z IS NOT NULL),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM threes, range(3) r(k) WHERE n > 1 GROUP BY doc_id),
lines AS (SELECT * FROM (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
normal AS (SELECT doc_id, host, line, {_WORDS.format(text="translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 'abcdefghijklmnopqrstuvwxyz0000000000')")} AS w FROM lines),
keyed AS (SELECT doc_id, host, line, array_to_string(w, ' ') AS norm, len(w) AS n FROM normal),
repeats AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY doc_id),
often AS (SELECT host, norm FROM keyed GROUP BY host, norm HAVING count(DISTINCT doc_id) > 6),
removed AS (SELECT doc_id, sum(n) AS n_removed_words FROM keyed k JOIN often o ON o.host IS NOT DISTINCT FROM k.host AND o.norm = k.norm GROUP BY doc_id),
measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed_words, 0)::BIGINT AS n_removed_words
  FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN removed USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_symbols <= n_words * 0.5 AND n_dup_lines <= n_lines * 0.5 AND n_words - n_removed_words >= n_words * 0.4
       AND n_words - n_removed_words >= 50 AS kept, n_removed_words
FROM judged"""

OP10 = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS.format(text=_LOWER.format(text="coalesce(text, '')"))} AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1]) END) AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id, doc_id AS c FROM sets UNION SELECT l.b, r.c FROM reached r JOIN both_ways l ON l.a = r.doc_id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, component_id = doc_id AS kept
FROM sets JOIN (SELECT doc_id, min(c) AS component_id FROM reached GROUP BY doc_id) USING (doc_id)"""

OP11 = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS.format(text=_LOWER.format(text="coalesce(text, '')"))} AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) BETWEEN 1 AND 3 THEN [array_to_string(w, ' ')]
                                      ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3]) END) AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id, doc_id AS c FROM sets UNION SELECT l.b, r.c FROM reached r JOIN both_ways l ON l.a = r.doc_id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id
FROM sets JOIN (SELECT doc_id, min(c) AS component_id FROM reached GROUP BY doc_id) USING (doc_id)"""

OP12 = """
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h FROM documents),
drawn AS (SELECT doc_id, text, length(text) AS n, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2,
                 ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM docs),
formed AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS low, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS high,
                  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                       WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
pieces AS (SELECT *, substring(text, 1, low) AS p, substring(text, low + 1, high - low) AS m, substring(text, high + 1) AS s FROM formed)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM pieces"""


def _centroids(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    square = "list_sum(list_transform(list_zip(v.xs, c.xs), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = [f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS xs FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: isfinite(x::DOUBLE))) = {dims}),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, xs) - 1)::INTEGER AS c, xs
  FROM (SELECT sha256('2:' || vec_id) AS h, xs FROM kept ORDER BY h, xs LIMIT {k}))"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, any_value(xs) AS xs, min(d) AS d, arg_min(c, (d, c)) AS c
  FROM (SELECT v.vec_id, v.xs, c.c, {square} AS d FROM kept v, c{i} c) GROUP BY vec_id)""")
        if i < rounds:
            steps.append(f"""m{i} AS MATERIALIZED (SELECT c, list((((s - ((s % n) + n) % n)) // n)::BIGINT ORDER BY i) AS xs
  FROM (SELECT c, i, sum(xs[i])::BIGINT AS s, count(*) AS n FROM a{i}, range(1, {dims + 1}) r(i) GROUP BY c, i) GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.xs, c.xs) AS xs FROM c{i} c LEFT JOIN m{i} m ON m.c = c.c)""")
    return ",\n".join(steps) + f"""
SELECT vec_id, a.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.xs, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.c"""


OP13 = _centroids()
