"""The SQL equivalents of the queries that SQL can express (DuckDB)."""

EXACT_DEDUP = r"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS s FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept, sha256(s) AS text_sha256
FROM n WINDOW w AS (PARTITION BY s ORDER BY length(t) DESC, doc_id)
"""

CHAT = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos FROM conversations),
last AS (SELECT conv_id, max(turn) AS t, arg_max(text, turn) AS x FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
p AS (SELECT r.*, CASE WHEN role = 'assistant' AND turn = a.t THEN coalesce(b.x, '') ELSE text END AS other
  FROM r LEFT JOIN last a ON a.conv_id = r.conv_id LEFT JOIN last b ON b.conv_id = a.conv_id + 1),
c AS (SELECT conv_id, coalesce(min(pos) FILTER (text IS DISTINCT FROM other), count(*)) AS n FROM p GROUP BY conv_id),
s AS (SELECT p.*, n, concat('<|im_start|>', role, chr(10), text, '<|im_end|>', chr(10)) AS a,
  concat('<|im_start|>', role, chr(10), other, '<|im_end|>', chr(10)) AS b FROM p JOIN c USING (conv_id))
SELECT conv_id AS pair_id, cast(max(n) AS int) AS n_prompt_turns,
  coalesce(string_agg(a, '' ORDER BY pos) FILTER (pos < n), '') AS prompt,
  coalesce(string_agg(a, '' ORDER BY pos) FILTER (pos >= n), '') AS chosen,
  coalesce(string_agg(b, '' ORDER BY pos) FILTER (pos >= n), '') AS rejected,
  cast(coalesce(sum(length(coalesce(text, '')) + 11) FILTER (pos >= n AND role = 'assistant'), 0) AS int) AS chosen_loss_chars,
  cast(coalesce(sum(length(coalesce(other, '')) + 11) FILTER (pos >= n AND role = 'assistant'), 0) AS int) AS rejected_loss_chars
FROM s GROUP BY conv_id
"""

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
j AS (SELECT item_id, w, least(10, len(w)) AS m FROM i WHERE len(w) > 0),
k AS (SELECT DISTINCT item_id, m, array_to_string(w[p + 1 : p + m], ' ') AS win FROM (SELECT *, unnest(range(0, len(w) - m + 1)) AS p FROM j)),
e AS (SELECT doc_id, m, p, array_to_string(w[p + 1 : p + m], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(0, greatest(len(w) - m + 1, 0))) AS p FROM d, (SELECT DISTINCT m FROM j))),
h AS (SELECT doc_id, p, e.m, item_id FROM e JOIN k ON e.m = k.m AND e.win = k.win),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM (SELECT DISTINCT doc_id, p, m FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(cast(item_id AS varchar)))), ',') AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
