"""DuckDB SQL of the queries that SQL can express; op1, op3, op9, op10 and the pipeline are tested in Python."""

from .contracts_params import SHARD_BYTES

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLE: dict[str, str] = {
    "op2_substring": rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS words FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS m FROM win) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM dup, range(50) r(j)),
pos AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) g USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op4_ngram_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_SPACED}') AS words FROM documents WHERE text IS NOT NULL),
sh AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT reach.d, link.b FROM reach JOIN link ON link.a = reach.r),
degree AS (SELECT a, count(*) AS n FROM link GROUP BY 1)
SELECT d AS doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r) AS component_id, CAST(coalesce(any_value(degree.n), 0) AS BIGINT) AS n_links
FROM reach LEFT JOIN n ON n.doc_id = d LEFT JOIN degree ON degree.a = d GROUP BY d""",
    "op5_sharding": f"""
WITH r AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT doc_id, n, h, d, sum(n) OVER (PARTITION BY d, h >> (60 - d)) AS total FROM r, range(25) x(d)),
leaf AS (SELECT doc_id, any_value(n) AS n, any_value(h) AS h, min(d) AS d, arg_min(total, d) AS total FROM s WHERE total <= {SHARD_BYTES} GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CASE WHEN d = 0 THEN '' ELSE lpad(bin(h >> (60 - d)), CAST(d AS INT), '0') END AS shard_id, CAST(d AS BIGINT) AS local_depth, CAST(total AS BIGINT) AS shard_bytes FROM leaf""",
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, CAST(5 * g + 1 AS INT), 5) AS BIGINT) >> k) & 31) AS INT), 1)), '')), '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to, '2000-01-01T00:00:00Z' AS warc_date, true AS intact FROM p""",
    "op7_suffix_array": """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM b WHERE len(h) >= 200)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
isle AS (SELECT doc_id, i, sum(CASE WHEN i > before + 100 OR before IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM dup)),
span AS (SELECT doc_id, g, min(i) AS a, max(i) + 100 AS e FROM isle GROUP BY 1, 2),
gap AS (SELECT doc_id, a, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f FROM span),
kept AS (SELECT b.doc_id, coalesce(string_agg(substr(h, 2 * f + 1, 2 * (a - f)), '' ORDER BY a), '') AS head FROM b LEFT JOIN gap USING (doc_id) GROUP BY 1),
sums AS (SELECT doc_id, sum(e - a) AS removed, count(*) AS spans, max(e) AS last FROM span GROUP BY 1)
SELECT b.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(head || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM b JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)""",
    "op8_decontamination": rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '{_ALNUM}') AS words FROM documents),
t AS (SELECT item_id, regexp_extract_all(coalesce({_LOWER}, ''), '{_ALNUM}') AS words FROM benchmark),
q AS (SELECT DISTINCT item_id, least(len(words), 13) AS k, array_to_string(words[i:i + 12], ' ') AS s FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 11, 2))) AS i FROM t WHERE len(words) > 0)),
win AS (SELECT doc_id, i, k, array_to_string(words[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, k, words, unnest(range(1, len(words) - k + 2)) AS i FROM w, (SELECT DISTINCT k FROM q) WHERE len(words) >= k)),
m AS (SELECT doc_id, i, win.k, item_id FROM win JOIN q ON win.s = q.s AND win.k = q.k),
hit AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM m, range(13) r(j) WHERE j < k GROUP BY 1),
item AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY 1)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(item.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(words) AS contaminated FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN item USING (doc_id)""",
}
