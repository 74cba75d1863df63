"""DuckDB SQL for the corpus queries that SQL can express on whole tables.

The others have none: SQL lacks XXH64 (op1), tokenizers (op3, op4, op9), a trained model (op5), patterns that look
behind and possessive ones (op6's added kinds), and the rolling hash that chooses op8's seeds. Brute-force versions
in ``tests/llm`` stand for those.
"""

from __future__ import annotations

_SPACE, _WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = f"""
WITH used AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '{_WORD}')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS c FROM used GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
dl AS (SELECT doc_id, count(*) AS dl FROM used GROUP BY doc_id),
whole AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM used) AS words),
impact AS (
  SELECT tf.doc_id, tf.term, floor(10000 * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (c * 2.2::DOUBLE)
    / (c + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / (words::DOUBLE / n))) + 0.5::DOUBLE)::BIGINT AS points
  FROM tf JOIN df USING (term) JOIN dl USING (doc_id) CROSS JOIN whole),
hit AS (
  SELECT q.doc_id AS query_id, i.doc_id, sum(points)::BIGINT AS points
  FROM tf q JOIN impact i USING (term) WHERE q.doc_id % 100 = 0 GROUP BY q.doc_id, i.doc_id HAVING sum(points) > 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, doc_id) AS rank, doc_id, points::DOUBLE / 10000 AS score
FROM hit QUALIFY rank <= 10
"""

OP7 = f"""
WITH held AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
word AS (SELECT doc_id, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS i FROM held),
two AS (SELECT *, w || ' ' || lead(w, 1) OVER o AS w2 FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
four AS (SELECT *, w2 || ' ' || lead(w2, 2) OVER o AS w4 FROM two WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
eight AS (SELECT *, w4 || ' ' || lead(w4, 4) OVER o AS w8 FROM four WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twenty AS (SELECT doc_id, i, w8 || ' ' || lead(w8, 8) OVER o || ' ' || lead(w4, 16) OVER o AS w20 FROM eight WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, i, row_number() OVER (PARTITION BY w20 ORDER BY doc_id, i) > 1 AS later FROM twenty WHERE w20 IS NOT NULL),
cut AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM again WHERE later),
kept AS (SELECT doc_id, count(*) AS n_kept, string_agg(w, ' ' ORDER BY i) AS kept_text FROM word ANTI JOIN cut USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(kept_text, '')) AS kept_sha256
FROM held LEFT JOIN kept USING (doc_id)
"""

OP10 = f"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n_points, regexp_replace(coalesce(text, ''), '{_SPACE}', '', 'g') AS norm FROM documents),
g AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""

ORACLES: dict[str, str] = {"op2_bm25": OP2, "op7_substring_dedup": OP7, "op10_exact_dedup": OP10}
