"""SQL for the queries of this subpackage that SQL can express: the same results without the operators' methods."""

from __future__ import annotations

BENCHMARK_DECONTAMINATION = """WITH docs AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
item_words AS (SELECT item_id, UNNEST(w) AS word, UNNEST(range(len(w))) AS j, len(w) AS n, least(len(w), 20) AS width FROM items WHERE len(w) >= 3),
doc_words AS (SELECT doc_id, UNNEST(w) AS word, UNNEST(range(len(w))) AS p FROM docs),
hits AS (SELECT doc_id, item_id, p - j AS start, j, n, width FROM doc_words JOIN item_words USING (word)),
likely AS (SELECT doc_id, item_id, start FROM hits GROUP BY doc_id, item_id, start, n, width
    HAVING 100 * COUNT(*) >= 75 * width AND (n >= 8 OR COUNT(*) = n)),
same AS (SELECT h.* FROM hits h JOIN likely USING (doc_id, item_id, start)),
windows AS (SELECT x.doc_id, x.item_id, x.start, x.width, x.j, COUNT(*) AS matched FROM same x
    JOIN same y ON x.doc_id = y.doc_id AND x.item_id = y.item_id AND x.start = y.start
    AND y.j >= least(x.j, x.n - x.width) AND y.j < least(x.j, x.n - x.width) + x.width GROUP BY ALL),
best AS (SELECT doc_id, item_id, start, width, MAX(matched) AS matched FROM windows GROUP BY ALL),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, start) AS r FROM best WHERE 100 * matched >= 75 * width)
SELECT doc_id, item_id, CAST(start AS INTEGER) AS "start", CAST(matched AS BIGINT) AS matched, CAST(width AS BIGINT) AS "of" FROM ranked WHERE r = 1"""

LINE_DEDUP = """WITH pages AS (SELECT DISTINCT source, text FROM documents WHERE text IS NOT NULL),
lines AS (SELECT DISTINCT source, text, trim(l) AS l FROM (SELECT source, text, UNNEST(string_split(text, chr(10))) AS l FROM pages) x),
totals AS (SELECT source, COUNT(*) AS total FROM pages GROUP BY source),
bad AS (SELECT l.source, l.l FROM lines l JOIN totals t ON l.source IS NOT DISTINCT FROM t.source WHERE l.l <> ''
    GROUP BY l.source, l.l, t.total HAVING COUNT(*) >= 2 AND 100 * COUNT(*) > 5 * t.total),
numbered AS (SELECT doc_id, source, UNNEST(string_split(text, chr(10))) AS l, UNNEST(range(len(string_split(text, chr(10))))) AS i FROM documents),
kept AS (SELECT n.doc_id, string_agg(n.l, chr(10) ORDER BY n.i) AS text FROM numbered n
    LEFT JOIN bad b ON n.source IS NOT DISTINCT FROM b.source AND trim(n.l) = b.l WHERE b.l IS NULL GROUP BY n.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE COALESCE(k.text, '') END AS text, d.lang, d.source,
    CASE WHEN d.text IS NULL THEN d.n_chars ELSE CAST(length(COALESCE(k.text, '')) AS BIGINT) END AS n_chars
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id"""

NGRAM_JACCARD_JOIN = """WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, w, UNNEST(range(greatest(len(w) - 4, 1))) AS i FROM words WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 5], ' ') AS s FROM places),
sizes AS (SELECT doc_id, COUNT(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, COUNT(*) AS o FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * o >= 75 * (p.n + q.n - o)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, COALESCE(s.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
JOIN (SELECT a, MIN(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id"""

CONTENT_SORT = """WITH rows AS (SELECT doc_id, translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
SELECT doc_id, MAX(doc_id) OVER g AS keep_id, COUNT(*) OVER g AS group_size, doc_id = MAX(doc_id) OVER g AS kept, sha256(body) AS text_sha256
FROM rows WINDOW g AS (PARTITION BY body)"""

HARD_NEGATIVES = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scores AS (SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, anchor_label, vec_id AS positive_id, score AS positive_score FROM scores WHERE label = anchor_label
    QUALIFY ROW_NUMBER() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(ROW_NUMBER() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
    s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND s.label <> p.anchor_label
    AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY rank <= 5"""
