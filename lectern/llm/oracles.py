"""SQL that states the rows of those queries that DuckDB can express."""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x20\x09-\x0D]+')"
_ALNUM = r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

NGRAM_JOIN = f"""WITH RECURSIVE w AS (SELECT doc_id, {_SPACED} AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
 e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
 both_ AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
 walk(node, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b, seen FROM walk JOIN both_ ON a = node)
 SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM (SELECT node AS doc_id, min(seen) AS component_id FROM walk GROUP BY 1) LEFT JOIN n USING (doc_id)"""

DECONTAMINATION = f"""WITH d AS (SELECT doc_id, {_ALNUM} AS ws FROM documents), i AS (SELECT item_id, {_ALNUM} AS ws FROM benchmark),
 iw AS (SELECT DISTINCT item_id, size, array_to_string(ws[pos:pos + size - 1], ' ') AS g FROM (SELECT item_id, ws, least(10, len(ws)) AS size, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS pos FROM i WHERE len(ws) > 0)),
 dw AS (SELECT doc_id, size, pos, array_to_string(ws[pos:pos + size - 1], ' ') AS g FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS pos FROM d, (SELECT DISTINCT size FROM iw))),
 h AS (SELECT doc_id, item_id, dw.size, pos FROM dw JOIN iw ON dw.size = iw.size AND dw.g = iw.g),
 hw AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS word FROM h) GROUP BY 1),
 hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY 1)
 SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
 FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)"""

_MARKS = r"len(regexp_extract_all({0}, '<\\*(?:s>|/s>)|\[\\*(?:INST\]|/INST\])'))"

CHAT_FORMAT = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
 sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
 CAST(sum(20 + length(role) + length(text) + {_MARKS.format("role")} + {_MARKS.format("text")}) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id"""

EXACT_DEDUP = r"""WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
 g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
 SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)"""


def _rounds(rounds: int) -> str:
    """Rounds of assignment and update as one table of distances and one of codebooks each."""
    far = "CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    mean = ", ".join(f"CAST(floor(sum(x[{i}]) / count(*)) AS BIGINT)" for i in range(1, 9))
    out = []
    for r in range(rounds + 1):
        out.append(f"a{r} AS MATERIALIZED (SELECT vec_id, p, min({far} * 16 + e) AS m FROM parts JOIN c{r} USING (p) GROUP BY 1, 2)")
        if r < rounds:
            new = f"SELECT p, m % 16 AS e, [{mean}] AS c FROM a{r} JOIN parts USING (vec_id, p) GROUP BY 1, 2"
            out.append(f"c{r + 1} AS MATERIALIZED (SELECT old.p, old.e, coalesce(new.c, old.c) AS c FROM c{r} old LEFT JOIN ({new}) new ON old.p = new.p AND old.e = new.e)")
    return ",\n ".join(out)


VECTOR_CODES = f"""WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 parts AS MATERIALIZED (SELECT vec_id, p, v[8 * p + 1:8 * p + 8] AS x FROM kept, range(8) t(p)),
 c0 AS MATERIALIZED (SELECT p, e, x AS c FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < 16) USING (vec_id)),
 {_rounds(6)},
 coded AS (SELECT vec_id, string_agg(printf('%02x', m % 16), '' ORDER BY p) AS code, CAST(sum(m // 16) AS BIGINT) AS error FROM a6 GROUP BY 1)
 SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
 (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM c6) AS codebooks_sha256 FROM coded JOIN kept USING (vec_id)"""
