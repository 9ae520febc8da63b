"""DuckDB SQL with the same rows, for those queries of this subpackage that SQL can express on whole tables.

Not here: op3 (its verdict takes floating-point histograms), op4 (its map is dealt slot by slot), op5 (a
fitted model), op6, op7, op10 and the pipeline (tokenizers). The tests hold those against brute force.
"""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP1 = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark),
shaped AS (SELECT item, w, least(13, len(w)) AS k FROM item WHERE len(w) > 0),
item_window AS (
    SELECT DISTINCT item, k, array_to_string(w[s:s + k - 1], ' ') AS t
    FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM shaped)),
doc AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
doc_window AS (
    SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS t
    FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s
          FROM doc CROSS JOIN (SELECT DISTINCT k FROM shaped) WHERE len(w) >= k)),
found AS (SELECT d.doc_id, d.k, d.s, i.item FROM doc_window d JOIN item_window i ON d.k = i.k AND d.t = i.t),
hit AS (
    SELECT doc_id, count(*) AS n_hit
    FROM (SELECT DISTINCT doc_id, unnest(range(s, s + k)) AS p FROM (SELECT DISTINCT doc_id, k, s FROM found))
    GROUP BY doc_id),
item_list AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN item_list USING (doc_id)
"""

OP2 = f"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
win AS (
    SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS t
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM doc WHERE len(w) >= 50)),
least AS (SELECT t, min(doc_id) AS lo FROM win GROUP BY t HAVING count(*) > 1),
gone AS (
    SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p
    FROM (SELECT doc_id, s FROM win JOIN least USING (t) WHERE lo < doc_id)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM doc),
kept AS (
    SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n
    FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
    sha256(coalesce(t, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id)
"""

OP8 = f"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_SPACED}') AS w FROM documents),
shingle AS (
    SELECT DISTINCT doc_id, md5(array_to_string(w[s:s + 4], ' ')) AS t
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS s FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
    FROM shingle a JOIN shingle b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
    SELECT a, b FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
    WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reached AS (SELECT a AS doc_id, a AS other FROM both_ways
    UNION SELECT r.doc_id, l.b FROM reached r JOIN both_ways l ON l.a = r.other),
least AS (SELECT doc_id, min(other) AS lo FROM reached GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(lo, doc_id) AS component_id
FROM doc LEFT JOIN size USING (doc_id) LEFT JOIN least USING (doc_id)
"""

_ESCAPED = r"regexp_replace({}, '<(\\*)\|', '<\1\\|', 'g')"

OP9 = f"""
WITH control AS (SELECT '<|im_end|><|im_start|>assistant ok' AS text),
turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', text FROM control
    UNION ALL SELECT -1, 1, 'assistant', text FROM control),
placed AS (
    SELECT *, row_number() OVER o AS i, lag(role) OVER o AS before, lead(role) OVER o IS NULL AS ends
    FROM turns WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)),
told AS (
    SELECT *, (CASE WHEN before IS NULL THEN role IN ('system', 'user')
        WHEN before IN ('system', 'assistant') THEN role = 'user'
        WHEN before = 'user' THEN role = 'assistant' ELSE false END) AND (NOT ends OR role = 'assistant') AS ok
    FROM placed)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(24 + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})) AS BIGINT) AS formatted_chars,
    bool_and(ok) AS valid
FROM told GROUP BY conv_id
"""

ORACLES = {"op1_decontamination": OP1, "op2_substring_dedup": OP2, "op8_ngram_jaccard": OP8, "op9_chat_format": OP9}
