"""DuckDB SQL for the operators that SQL can express; the others are tested by brute force in tests/llm.

op1 trains a model, op2 needs crc32 and sums of logarithms in one order, op3, op9 and op10
need tokenizers.
"""

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op4_jaccard_join": f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, list_aggregate(list_slice(w, i, i + 4), 'string_agg', ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY 1) USING (doc_id)""",
    "op5_substring_dedup": f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
x AS (SELECT doc_id, i, md5(list_aggregate(list_slice(w, i, i + 34), 'string_agg', ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
y AS (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS c FROM x),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM y WHERE c > 1),
t AS (SELECT doc_id, unnest(w) AS v, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT t.doc_id, count(*) FILTER (WHERE gone.p IS NOT NULL) AS n, string_agg(v, ' ' ORDER BY t.p) FILTER (WHERE gone.p IS NULL) AS s FROM t LEFT JOIN gone ON gone.doc_id = t.doc_id AND gone.p = t.p GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op6_quality_rules": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
l AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT x) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '{_WORD}') GROUP BY 1),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE c > 1) GROUP BY 1),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
 len(regexp_extract_all(text, '!')) AS n_exclaim, coalesce(l.n, 0) AS n_lines, coalesce(l.dup, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
f AS (SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > 3 * n_words)::BIGINT + 8 * (n_exclaim > n_words)::BIGINT
 + 16 * (word_chars < 2 * n_words OR word_chars > 25 * n_words)::BIGINT + 32 * (n_lines >= 4 AND 10 * n_dup_lines > 7 * n_lines)::BIGINT AS failures FROM m)
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed, failures = 0 AS kept, failures FROM f""",
    "op7_topk_search": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op8_line_dedup": r"""WITH l AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
b AS (SELECT *, trim(translate(x, chr(9) || chr(11) || chr(12) || chr(13), '    ')) AS y FROM l),
c AS (SELECT y FROM b WHERE len(list_filter(string_split(y, ' '), lambda w: w <> '')) >= 3 GROUP BY 1 HAVING count(DISTINCT source) >= 10)
SELECT doc_id, count(*) FILTER (WHERE b.y <> '')::BIGINT AS n_lines, count(c.y)::BIGINT AS n_removed, sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE c.y IS NULL), '')) AS kept_sha256 FROM b LEFT JOIN c USING (y) GROUP BY 1""",
}

_RULES = ("few_words", "repeated_windows", "many_symbols", "many_exclamations", "short_or_long_words", "repeated_lines")
_EACH = " UNION ALL ".join(f"SELECT '{r}' AS rule, count(*) FILTER (WHERE failures & {1 << k} <> 0) AS rejected, count(*) FILTER (WHERE failures = {1 << k}) AS only FROM led" for k, r in enumerate(_RULES))
ORACLE_SQL["quality_ablation"] = f"WITH led AS ({ORACLE_SQL['op6_quality_rules']}) {_EACH}"
