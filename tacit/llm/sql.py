"""Expected results in DuckDB SQL, for the operators that SQL can express."""

# Features of whole texts; every rule is an integer comparison.
QUALITY = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)),
                lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), grams AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams)
  WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM again) GROUP BY doc_id
), f AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(l) AS n_lines,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_echoes
  FROM d LEFT JOIN covered USING (doc_id)
), v AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    10 * n_symbols > n_words OR (n_dup_lines > 3 AND 100 * n_dup_lines > 30 * n_lines)
      OR 100 * n_echoes > 30 * n_words
      OR NOT (word_chars BETWEEN 2 * n_words AND 20 * n_words) AS failed
  FROM f
)
"""
QUALITY_RESULT = (
    QUALITY
    + """SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  base_failed, NOT base_failed AND NOT failed AS kept FROM v"""
)

WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, ''))::BIGINT AS n FROM pages
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM p
)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
FROM m
"""


def near_dup_ctes(table: str, words: int, percent: int, name: str = "") -> str:
    """CTEs up to ``{name}roots(doc_id, root)`` and ``{name}sizes(doc_id, c)`` for a table."""
    return rf"""
{name}w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM {table}
), {name}s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + {words - 1}], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {words - 1}, 1) + 1)) AS i
        FROM {name}w WHERE len(w) > 0)
), {name}sizes AS (
  SELECT doc_id, count(*) AS c FROM {name}s GROUP BY doc_id
), {name}p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
  FROM {name}s a JOIN {name}s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), {name}e AS (
  SELECT x, y FROM {name}p JOIN {name}sizes n ON x = n.doc_id JOIN {name}sizes m ON y = m.doc_id
  WHERE 100 * k >= {percent} * (n.c + m.c - k)
), {name}u AS (
  SELECT x, y FROM {name}e UNION ALL SELECT y, x FROM {name}e
), {name}r(doc_id, other) AS (
  SELECT doc_id, doc_id FROM {name}w
  UNION SELECT r.doc_id, u.y FROM {name}r r JOIN {name}u u ON r.other = u.x
), {name}roots AS (
  SELECT doc_id, min(other) AS root FROM {name}r GROUP BY doc_id
)"""


NEAR_DUP = (
    "WITH RECURSIVE "
    + near_dup_ctes("documents", 3, 85)
    + """
SELECT doc_id, coalesce(c, 0)::BIGINT AS n_shingles, root AS component_id, doc_id = root AS kept
FROM roots LEFT JOIN sizes USING (doc_id)
"""
)

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, o.vec_id, list_dot_product(q.c, o.c)::BIGINT AS score
  FROM v q JOIN v o ON q.vec_id <> o.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""

# Window placement repeats the documented rules; budget 1024, history 256, four characters a token.
CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), r AS (
  SELECT *, 24 + length(role) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) AS n FROM c
), p AS (
  SELECT *, ceil(n / 4)::BIGINT AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i,
    sum(ceil(n / 4)::BIGINT) OVER (PARTITION BY conv_id ORDER BY turn) AS done FROM r
), f AS (
  SELECT conv_id, min(i) AS si, arg_min(n, i) AS sn, arg_min(size, i) AS ssize
  FROM p WHERE lower(role) = 'system' GROUP BY conv_id
), m AS (
  SELECT p.*, si, sn, coalesce(ssize, 0) AS head, greatest(0, 1024 - coalesce(ssize, 0)) AS free
  FROM p LEFT JOIN f USING (conv_id)
), o AS (
  SELECT *, greatest(1, free - least(256, free // 2)) AS room FROM m
), k AS (
  SELECT *, ((done - size) // room)::BIGINT AS cell FROM o
), e AS (
  SELECT *, i = max(i) OVER g AND done > (cell + 1) * room AND count(*) OVER g > 1
      AND sum(size) OVER g > room AS apart
  FROM k WINDOW g AS (PARTITION BY conv_id, cell)
), w AS (
  SELECT *, 2 * cell + apart::BIGINT AS win FROM e
), s AS (
  SELECT conv_id, win, min(i) AS i, max(done) AS last, sum(size) AS tokens,
    any_value(si) AS si, any_value(sn) AS sn, any_value(head) AS head,
    lead(win) OVER (PARTITION BY conv_id ORDER BY win) AS nxt
  FROM w GROUP BY conv_id, win
), heads AS (
  SELECT conv_id, sum(sn) AS n FROM s WHERE si < i GROUP BY conv_id
), history AS (
  SELECT w.conv_id, sum(w.n) AS n
  FROM w JOIN s ON w.conv_id = s.conv_id AND w.win = s.win
  JOIN s AS t ON t.conv_id = s.conv_id AND t.win = s.nxt
  WHERE s.last - w.done + w.size
      <= least(256, 1024 - t.tokens - CASE WHEN t.si < t.i THEN t.head ELSE 0 END)
    AND NOT (w.i = coalesce(t.si, -1) AND t.si < t.i)
  GROUP BY w.conv_id
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(w.n) + coalesce(any_value(h.n), 0) + coalesce(any_value(y.n), 0))::BIGINT AS formatted_chars
FROM w LEFT JOIN heads h USING (conv_id) LEFT JOIN history y USING (conv_id) GROUP BY conv_id
"""


def crc32(codes: str) -> str:
    """The unsigned CRC-32 of a list of bytes."""
    step = "list_reduce([xor(a, y)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda u, v: xor(u >> 1, 3988292384::BIGINT * (u & 1)))"
    return f"xor(list_reduce([4294967295::BIGINT] || {codes}, lambda a, y: {step}), 4294967295::BIGINT)"


_LATIN_BYTES = """flatten(list_transform(string_split(d || ':' || w, ''),
    lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195, ord(c)::BIGINT - 64] END))"""

SPELLING = rf"""
WITH RECURSIVE r AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[a-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents
), g AS (
  SELECT d, w, count(*) AS k FROM r WHERE length(w) >= 7 GROUP BY d, w
), h AS (
  SELECT w, k, {crc32(_LATIN_BYTES)} AS h FROM g
), e AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, k
  FROM h
), words AS (
  SELECT word, sum(k)::BIGINT AS n FROM e WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2
), less AS (
  SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS v
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)
), pairs AS (
  SELECT a.word, b.word AS o, b.n FROM less a JOIN less b ON a.p = b.p AND a.v = b.v AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.v = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.v = b.word
), best AS (
  SELECT word, o, n, row_number() OVER (PARTITION BY word ORDER BY n DESC, o) AS at,
    count(*) OVER (PARTITION BY word) AS n_near FROM pairs
), f AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near,
    CASE WHEN b.n >= 10 * w.n THEN b.o END AS form, CASE WHEN b.n >= 10 * w.n THEN b.n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word AND b.at = 1
), chain(word, last, depth) AS (
  SELECT word, word, 0 FROM f
  UNION ALL SELECT c.word, f.form, c.depth + 1 FROM chain c JOIN f ON c.last = f.word WHERE f.form IS NOT NULL
), roots AS (
  SELECT word, arg_max(last, depth) AS root FROM chain GROUP BY word
)
SELECT word, form, root, n, n_near, form_n FROM f JOIN roots USING (word)
"""

_ID_BYTES = "list_transform(string_split(c::VARCHAR, ''), lambda z: ord(z)::BIGINT)"

PREFIX_TRIE = rf"""
WITH k AS (
  SELECT c, key, words, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, key) AS i FROM (
    SELECT conv_id AS c, turn,
      md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS key,
      len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
    FROM conversations WHERE conv_id IS NOT NULL)
), v AS (
  SELECT c, c - c % 20 AS lead, {crc32(_ID_BYTES)} % 4 AS h FROM (SELECT DISTINCT c FROM k)
), b AS (
  SELECT v.c, k.i AS d, key, words FROM v JOIN k ON k.c = lead AND k.i <= h
  UNION ALL
  SELECT v.c, least(h, coalesce(n, 0)) + k.i - h, key, words FROM v JOIN k ON k.c = v.c AND k.i > h
  LEFT JOIN (SELECT c, count(*) AS n FROM k GROUP BY c) s ON s.c = v.lead
), s AS (
  SELECT c, list(key ORDER BY d) AS keys, list(words ORDER BY d) AS words FROM b GROUP BY c
), m AS (
  SELECT c, d, coalesce(len(keys), 0) AS total,
    CASE WHEN d = 0 THEN [] ELSE keys[1:d] END AS node, CASE WHEN d = 0 THEN 0 ELSE words[d] END AS words
  FROM (SELECT v.c, keys, words, unnest(range(0, coalesce(len(keys), 0) + 1)) AS d FROM v LEFT JOIN s USING (c))
), n AS (
  SELECT node, d, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (total = d), '')) AS ends_sha256
  FROM m GROUP BY node, d
), up AS (
  SELECT *, CASE WHEN d < 2 THEN [] ELSE node[1:d - 1] END AS parent FROM n
), ch AS (
  SELECT parent, count(*) AS n_children FROM up WHERE d > 0 GROUP BY parent
), full_ AS (
  SELECT up.*, coalesce(n_children, 0) AS n_children FROM up LEFT JOIN ch ON ch.parent = up.node
), sub AS (
  SELECT CASE WHEN a = 0 THEN [] ELSE node[1:a] END AS node, a,
    count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM full_) GROUP BY 1, 2
)
SELECT f.conv_id, f.d::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves,
  saved_tokens, f.ends_sha256
FROM full_ f JOIN sub ON sub.node = f.node LEFT JOIN full_ p ON f.d > 0 AND p.node = f.parent
"""
