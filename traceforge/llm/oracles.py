"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

import re

from traceforge.llm.chat import CONTROL, END, START

BROKEN = "|".join(map(re.escape, CONTROL)) + r"|\\"
SAID = "</s>[INST] ok [/INST]"

COVER_TREE = """WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
  f AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
  l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
  r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
  n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, min(r.b) AS component_id, v.vec_id = min(r.b) AS kept FROM v JOIN r ON r.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id GROUP BY v.vec_id, n.n"""

CHAT = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '{SAID}' UNION ALL SELECT -1, 1, 'assistant', '{SAID}'),
  t AS (SELECT *, {len(START)} + length(role) + len(regexp_extract_all(role, '{BROKEN}')) + len(regexp_extract_all(role, '\\n')) + 1 + length(text) + len(regexp_extract_all(text, '{BROKEN}')) + {len(END) + 1} AS size FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id"""

WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS d FROM pages),
  r AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS best FROM p)
SELECT page_id, CAST(b AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN b >= 1000 AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN b >= 1000 AND page_id <> best THEN best END AS refers_to FROM r"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
DECONTAMINATION = f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents), i AS (SELECT item_id, {WORDS} AS w FROM benchmark),
  s AS (SELECT item_id, w, least(len(w), 13) AS size, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS pos0 FROM i WHERE len(w) > 0),
  k AS (SELECT DISTINCT item_id, size, array_to_string(list_slice(w, pos0, pos0 + size - 1), ' ') AS win FROM s),
  g AS (SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS pos0 FROM d, (SELECT DISTINCT size FROM k) z WHERE len(w) >= size),
  m AS (SELECT DISTINCT doc_id, item_id, g.size, pos0 FROM g JOIN k ON k.size = g.size AND k.win = array_to_string(list_slice(w, pos0, pos0 + g.size - 1), ' ')),
  h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(pos0, pos0 + size)) AS pos FROM m) GROUP BY doc_id),
  n AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM m GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)"""

SQL = {"op3_cover_tree": COVER_TREE, "op5_chat": CHAT, "op6_warc": WARC, "op7_decontamination": DECONTAMINATION}
