"""Registered queries of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from labeltrail.llm.bpe_codec import op8_bpe_codec
from labeltrail.llm.decontaminate import op1_decontaminate
from labeltrail.llm.embedding_dedup import op3_embedding_dedup
from labeltrail.llm.html_text import op9_html_text
from labeltrail.llm.language_id import op2_language_id
from labeltrail.llm.lexical_search import op13_lexical_search
from labeltrail.llm.secret_scan import op4_secret_scan
from labeltrail.llm.simhash import op10_simhash
from labeltrail.llm.source_audit import op11_source_audit
from labeltrail.llm.substring_dedup import op5_substring_dedup
from labeltrail.llm.suffix_dedup import op12_suffix_dedup
from labeltrail.llm.token_counts import op6_token_counts
from labeltrail.llm.token_files import op7_token_files

_ALL = (op1_decontaminate, op2_language_id, op3_embedding_dedup, op4_secret_scan, op5_substring_dedup, op6_token_counts, op7_token_files, op8_bpe_codec, op9_html_text, op10_simhash, op11_source_audit, op12_suffix_dedup, op13_lexical_search)

QUERIES = {query.__name__: query for query in _ALL}
_LOWER = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

#: SQL has no hash, tokenizer, network or parser of the others; tests compare those with one-by-one versions.
ORACLES: dict[str, str] = {
    "op1_decontaminate": f"""WITH items AS (SELECT item_id, w, least(5, len(w)) AS k FROM
  (SELECT item_id, {_WORDS.replace('{text}', 'lower(text)')} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark) WHERE text IS NOT NULL) WHERE len(w) > 0),
 asked AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM items)),
 docs AS (SELECT doc_id, {_WORDS.replace('{text}', 'lower(text)')} AS w FROM documents WHERE text IS NOT NULL),
 had AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM
  (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM items))),
 sizes AS (SELECT item_id, count(*) AS n FROM asked GROUP BY item_id)
 SELECT doc_id, item_id, count(*) AS n_shared, any_value(n) AS n_shingles, count(*) / any_value(n) AS containment
 FROM asked JOIN had USING (k, s) JOIN sizes USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= ceil(0.8 * any_value(n) - 1e-9)""",
    "op3_embedding_dedup": """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
 reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
 roots AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
 degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
 SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM roots LEFT JOIN degree USING (vec_id)""",
    "op5_substring_dedup": f"""WITH docs AS (SELECT doc_id, {_WORDS.replace('{text}', "coalesce(text, '')")} AS w FROM documents),
 windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS s FROM
  (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM docs WHERE len(w) >= 50)),
 firsts AS (SELECT s, min(doc_id) AS f FROM windows GROUP BY s),
 gone AS (SELECT DISTINCT doc_id, i + k AS p FROM windows JOIN firsts USING (s), range(0, 50) t(k) WHERE f < doc_id),
 words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM docs),
 kept AS (SELECT doc_id, count(gone.p) AS n, string_agg(x, ' ' ORDER BY p) FILTER (WHERE gone.p IS NULL) AS t
  FROM words LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
 FROM docs LEFT JOIN kept USING (doc_id)""",
    "op11_source_audit": f"""WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all({_LOWER.replace('{text}', "coalesce(text, '')")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
 tok AS (SELECT d, lang, source, unnest(w) AS term FROM docs),
 kept AS (SELECT lang, term, count(*) AS cl FROM tok GROUP BY lang, term HAVING count(DISTINCT d) >= 30),
 cnt AS (SELECT lang, source, term, count(*) AS c FROM tok JOIN kept USING (lang, term) GROUP BY ALL),
 ls AS (SELECT lang, count(*) AS v, sum(cl) AS nl FROM kept GROUP BY lang),
 gs AS (SELECT DISTINCT lang, source FROM docs),
 g AS (SELECT lang, source, v, nl, coalesce(n, 0) AS n FROM gs LEFT JOIN ls USING (lang) LEFT JOIN (SELECT lang, source, sum(c) AS n FROM cnt GROUP BY ALL) USING (lang, source)),
 p AS (SELECT g.lang, g.source, kept.term, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 5)) // (n + 5 * v) AS p,
  1 + (1000000000::HUGEINT * (cl + 5)) // (nl + 5 * v) AS q FROM g JOIN kept USING (lang) LEFT JOIN cnt ON cnt.lang = g.lang AND cnt.source = g.source AND cnt.term = kept.term),
 pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s, 0) AS value FROM gs a JOIN gs b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS s FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) z
  ON z.lang = a.lang AND z.source = a.source AND z.other = b.source),
 terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE c > 0 AND p > q),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS r FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
 SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR r <= 50""",
    "op13_lexical_search": f"""WITH docs AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all({_LOWER.replace('{text}', "coalesce(text, '')")}, {_TERM}) AS w FROM documents),
 tok AS (SELECT d, unnest(w) AS term FROM docs),
 tfs AS (SELECT d, term, count(*) AS tf FROM tok GROUP BY ALL),
 tot AS (SELECT count(DISTINCT d) AS n, count(*) AS l FROM tok),
 dfs AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, tot GROUP BY term, n),
 ms AS (SELECT d, doc_id, CASE WHEN l = 0 THEN 75 ELSE 75 + (25 * len(w) * n) // l END AS m FROM docs, tot),
 items AS (SELECT row_number() OVER () AS i, * FROM (SELECT DISTINCT item_id, text FROM benchmark)),
 asked AS (SELECT i, term, count(*) AS q FROM (SELECT i, unnest(regexp_extract_all({_LOWER.replace('{text}', "coalesce(text, '')")}, {_TERM})) AS term FROM items) GROUP BY ALL),
 scored AS (SELECT i, d, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS score FROM asked JOIN dfs USING (term) JOIN tfs USING (term) JOIN ms USING (d) GROUP BY ALL),
 ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS r FROM scored JOIN items USING (i) JOIN (SELECT d, doc_id FROM docs) USING (d) WHERE score > 0)
 SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE r <= 20""",
    "op12_suffix_dedup": """WITH docs AS (SELECT row_number() OVER () AS d, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 sized AS (SELECT *, CAST(len(h) // 2 AS BIGINT) AS n FROM docs),
 starts AS (SELECT d, i, md5(substr(h, 2 * i + 1, 800)) AS s FROM (SELECT d, h, unnest(range(0, n - 399)) AS i FROM sized WHERE n >= 400)),
 again AS (SELECT d, i FROM (SELECT d, i, count(*) OVER (PARTITION BY s) AS c FROM starts) WHERE c > 1),
 steps AS (SELECT d, i, CASE WHEN i - lag(i) OVER (PARTITION BY d ORDER BY i) <= 400 THEN 0 ELSE 1 END AS new FROM again),
 runs AS (SELECT d, i, sum(new) OVER (PARTITION BY d ORDER BY i) AS g FROM steps),
 spans AS (SELECT d, g, min(i) AS a, max(i) + 400 AS b FROM runs GROUP BY d, g),
 gaps AS (SELECT d, coalesce(lag(b) OVER (PARTITION BY d ORDER BY a), 0) AS f, a AS t FROM spans UNION ALL SELECT d, max(b), NULL FROM spans GROUP BY d),
 kept AS (SELECT d, string_agg(substr(h, CAST(2 * f + 1 AS BIGINT), CAST(2 * (coalesce(t, n) - f) AS BIGINT)), '' ORDER BY f) AS k FROM gaps JOIN sized USING (d) GROUP BY d),
 gone AS (SELECT d, CAST(sum(b - a) AS BIGINT) AS r, count(*) AS m FROM spans GROUP BY d)
 SELECT doc_id, n AS n_bytes, coalesce(r, 0) AS n_removed, coalesce(m, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
 FROM sized LEFT JOIN gone USING (d) LEFT JOIN kept USING (d)""",
}
