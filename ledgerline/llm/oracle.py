"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

# Components of the links (x, y) over the nodes (id), both directions, by repeated least labels.
_REACH = """
reach(id, other) AS (
    SELECT id, id FROM nodes
    UNION
    SELECT r.id, l.y FROM reach r JOIN links l ON l.x = r.other
)"""

ORACLE: dict[str, str] = {
    "op4_gzip_normaliser": """
WITH payloads AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex
    FROM pages
),
firsts AS (SELECT hex, min(page_id) AS first FROM payloads GROUP BY hex)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  1 + ((('0x' || substr(p.hex, (1 + 5 * (i // 4))::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31), 1)),
           '') AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM payloads p JOIN firsts f ON f.hex = p.hex
""",
    "op7_lsh_forest": rf"""
WITH RECURSIVE
words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE
        WHEN len(w) = 0 THEN []
        WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    END) AS s
    FROM words
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
    GROUP BY ALL
),
links AS (
    SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
    WHERE 100 * c >= 85 * (p.n + q.n - c)
),
nodes AS (SELECT DISTINCT x AS id FROM links),
{_REACH},
least AS (SELECT id, min(other) AS m FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(m, d.doc_id) AS component_id,
       coalesce(m, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.id = d.doc_id
""",
    "op8_cap_filters": f"""
WITH RECURSIVE
vectors AS (
    SELECT vec_id AS id, embedding::DOUBLE[] AS v,
           len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
           AND len(list_filter(v, lambda x: x <> 0)) > 0 AS usable
    FROM embeddings
),
links AS (
    SELECT a.id AS x, b.id AS y
    FROM (SELECT * FROM vectors WHERE usable) a JOIN (SELECT * FROM vectors WHERE usable) b
    ON a.id <> b.id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9
),
nodes AS (SELECT DISTINCT x AS id FROM links),
{_REACH},
least AS (SELECT id, min(other) AS m FROM reach GROUP BY id),
counted AS (SELECT x AS id, count(*) AS n FROM links GROUP BY x)
SELECT v.id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(m, v.id) AS component_id,
       coalesce(m, v.id) = v.id AS kept
FROM vectors v LEFT JOIN counted c ON c.id = v.id LEFT JOIN least l ON l.id = v.id
""",
    "op11_letter_count_trees": """
WITH RECURSIVE
crc_table AS (
    SELECT list(c ORDER BY i) AS t FROM (
        SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c
        FROM range(256) r(i))
),
runs AS (
    SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
    WHERE length(run) >= 7
),
hexed AS (
    SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs GROUP BY doc_id, run
),
hashed AS (
    SELECT run, n, xor(list_reduce(
        list_transform(range(1, length(x) + 1, 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h
    FROM hexed, crc_table
),
words AS (
    SELECT word, sum(n)::BIGINT AS n FROM (
        SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2)
                       ELSE run END AS word FROM hashed)
    WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
),
cuts AS (
    SELECT word, n, length(word) AS size, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut
    FROM words, unnest(range(1, length(word) + 1)) u(i)
),
near AS (
    SELECT DISTINCT a.word AS x, a.n AS nx, b.word AS y, b.n AS ny FROM cuts a JOIN cuts b
    ON a.size = b.size AND a.i = b.i AND a.cut = b.cut AND a.word <> b.word
    UNION
    SELECT c.word, c.n, w.word, w.n FROM cuts c JOIN words w ON w.word = c.cut
    UNION
    SELECT w.word, w.n, c.word, c.n FROM cuts c JOIN words w ON w.word = c.cut
),
best AS (
    SELECT x, nx, count(*) AS n_near, max(ny) AS top, first(y ORDER BY ny DESC, encode(y)) AS y FROM near GROUP BY x, nx
),
forms AS (SELECT x, n_near, CASE WHEN top >= 10 * nx THEN y END AS form, CASE WHEN top >= 10 * nx THEN top END AS form_n FROM best),
chain(word, root, step) AS (
    SELECT x, form, 1 FROM forms WHERE form IS NOT NULL
    UNION ALL
    SELECT c.word, f.form, step + 1 FROM chain c JOIN forms f ON f.x = c.root WHERE f.form IS NOT NULL
),
roots AS (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word)
SELECT w.word, form, coalesce(r.root, w.word) AS root, w.n, coalesce(n_near, 0)::BIGINT AS n_near, form_n::BIGINT AS form_n
FROM words w LEFT JOIN forms f ON f.x = w.word LEFT JOIN roots r ON r.word = w.word
""",
    "op12_count_automata": r"""
WITH
docs AS (
    SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
),
pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
grams AS (
    SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
    FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, unnest(range(1, 5)) s(m))
),
counts AS (SELECT lang, m, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
candidates AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE m >= 2),
cuts AS (
    SELECT c.lang, c.phrase, c.a, k, p.f AS l, q.f AS r, 2000000 * c.a // (p.f + q.f) AS score
    FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates) c
    JOIN counts p ON p.lang = c.lang AND p.phrase = array_to_string(c.w[:k], ' ')
    JOIN counts q ON q.lang = c.lang AND q.phrase = array_to_string(c.w[k + 1:], ' ')
),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
    SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS f
    FROM (SELECT lang, w, a, s, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM candidates WHERE m > 2))
    GROUP BY ALL
),
kept AS (
    SELECT x.* FROM weakest x LEFT JOIN inside y ON y.lang = x.lang AND y.phrase = x.phrase
    WHERE y.f IS NULL OR 100 * y.f < 80 * x.a
),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept
)
SELECT r.lang, rank::INTEGER AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= 2000
""",
}
