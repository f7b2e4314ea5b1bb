"""DuckDB SQL for the operators that SQL can express."""

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP1 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LOW}'), '{WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, '{UP}', '{LOW}'), '{WORD}') AS w FROM benchmark WHERE text IS NOT NULL),
g AS (SELECT DISTINCT item_id, list_slice(w, s, s + 9) AS gram FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(gram) AS l FROM g),
p AS (SELECT doc_id, l, s, list_slice(w, s, s + l - 1) AS gram FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, lens WHERE len(w) >= l)),
h AS (SELECT p.doc_id, p.s, p.l, g.item_id FROM p JOIN g USING (gram)),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS x FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""

OP8 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, s, array_to_string(list_slice(w, s, s + 19), ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY gram ORDER BY doc_id, s) AS k FROM p),
x AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM r WHERE k > 1),
g AS (SELECT doc_id, list(i) AS gone FROM x GROUP BY doc_id),
j AS (SELECT d.doc_id, w, gone, len(w) AS n, coalesce(len(gone), 0) AS m FROM d LEFT JOIN g ON d.doc_id = g.doc_id),
e AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS kept FROM e LEFT JOIN x ON e.doc_id = x.doc_id AND e.i = x.i WHERE x.i IS NULL GROUP BY e.doc_id)
SELECT j.doc_id, CAST(n AS BIGINT) AS n_words, CAST(m AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM j LEFT JOIN k ON j.doc_id = k.doc_id
"""

OP9 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
p AS (SELECT doc_id, s, substr(x, 2 * s - 1, 200) AS gram FROM (SELECT doc_id, x, unnest(range(1, n - 98)) AS s FROM d WHERE n >= 100)),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY gram ORDER BY doc_id, s) AS k FROM p),
m AS (SELECT doc_id, s, s + 99 AS e, max(s + 99) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r WHERE k > 1),
b AS (SELECT doc_id, s, e, sum(CASE WHEN before IS NULL OR s > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS g FROM m),
c AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM b GROUP BY doc_id, g),
k AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS last FROM c),
h AS (SELECT k.doc_id, count(*) AS spans, sum(e - s + 1) AS gone, max(e) AS tail, string_agg(substr(x, 2 * last + 1, 2 * (s - last - 1)), '' ORDER BY s) AS kept FROM k JOIN d ON k.doc_id = d.doc_id GROUP BY k.doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN h.doc_id IS NULL THEN x ELSE kept || substr(x, 2 * tail + 1) END)) AS kept_sha256
FROM d LEFT JOIN h ON d.doc_id = h.doc_id
"""
