"""The operators' queries in SQL, where SQL can express them."""

from __future__ import annotations

from ledgerlight.llm.chat_format import CONTROLS, END

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
ASCII_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ESCAPE = "chr(57344)"


def escaped(column: str) -> str:
    out = f"replace({column}, {ESCAPE}, {ESCAPE} || '.')"
    for i, c in enumerate(CONTROLS):
        out = f"replace({out}, '{c}', {ESCAPE} || '{chr(ord('a') + i)}')"
    return out


OP1 = f"""
WITH w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS ws FROM documents),
word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
win AS (SELECT doc_id, i, list_aggregate(ws[i:i + 49], 'string_agg', ' ') AS key FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
firsts AS (SELECT key, min(doc_id) AS f FROM win GROUP BY key HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT win.doc_id, win.i FROM win JOIN firsts ON firsts.key = win.key WHERE f < win.doc_id),
marked AS (SELECT word.doc_id, word.i, word.word, max(CASE WHEN gone.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY word.doc_id ORDER BY word.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
  FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.i = word.i),
per AS (SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM marked GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN per ON per.doc_id = w.doc_id
"""

OP7 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(ASCII_LOWER.replace("text", "coalesce(text, '')"))} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: hash(ws[i:i + 4])) ELSE [hash(ws)] END) AS h FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * inter >= 85 * (x.n + y.n - inter)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a, b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON edge.a = reach.b),
lowest AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(m, w.doc_id)) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN lowest ON lowest.a = w.doc_id
"""

OP8 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({escaped('role')}) + length({escaped('text')}) + {len('<||>') + 1 + len(END)}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

OP9 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.e, d.e) AS BIGINT) AS score FROM v q JOIN v d ON q.vec_id % 20 = 0 AND d.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""

GRAMS = " UNION ALL ".join(
    f"SELECT lang, {k} AS size, array_to_string(ws[i:i + {k - 1}], ' ') AS phrase FROM (SELECT lang, ws, unnest(range(1, len(ws) - {k} + 2)) AS i FROM w WHERE len(ws) >= {k})" for k in range(1, 5)
)
OP12 = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({ASCII_LOWER.replace("text", "coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
total AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS (SELECT lang, size, phrase, count(*) AS a FROM ({GRAMS}) GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE size >= 2),
inside AS (SELECT lang, array_to_string(ws[i:i + width - 1], ' ') AS phrase, max(a) AS longer FROM
  (SELECT *, unnest(range(1, size - width + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS width FROM c WHERE size >= 3)) GROUP BY ALL),
cut AS (SELECT *, array_to_string(ws[1:k], ' ') AS one, array_to_string(ws[k + 1:], ' ') AS other FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
scored AS (SELECT cut.lang, cut.phrase, cut.a, k, x.a AS l, y.a AS r, (CAST(2000000 AS HUGEINT) * cut.a) // (x.a + y.a) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = one JOIN f y ON y.lang = cut.lang AND y.phrase = other),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT best.* FROM best LEFT JOIN inside ON inside.lang = best.lang AND inside.phrase = best.phrase WHERE longer IS NULL OR CAST(100 AS HUGEINT) * longer < CAST(80 AS HUGEINT) * a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept JOIN total ON total.lang = kept.lang QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1, "op7_minhash_near_dedup": OP7, "op8_chat_format": OP8, "op9_exact_top_k": OP9, "op12_phrase_collocations": OP12}
