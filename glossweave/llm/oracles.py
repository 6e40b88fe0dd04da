"""SQL for the queries of this folder that SQL can express."""

from __future__ import annotations

SPACE_SQL = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WORDS_SQL = r"regexp_extract_all(%s, '[^\x20\x09-\x0D]+')"
LINES = """parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents),
lines AS (SELECT doc_id, unnest(p) AS line, unnest(range(len(p))) AS ix FROM parts)"""

OP2 = f"""WITH {LINES},
keyed AS (SELECT *, translate(trim(line, {SPACE_SQL}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
hot AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.*, h.key IS NOT NULL AND h.last <> k.doc_id AS gone FROM keyed k LEFT JOIN hot h USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY ix) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id"""

#: Fixed values, stated here on their own: stock phrases and separators of the rules.
PHRASES = (
    "lorem ipsum", "cookie policy", "cookie settings", "accept cookies", "use cookies", "terms of use", "terms of service",
    "privacy policy", "enable javascript", "all rights reserved", "sign up for our newsletter", "skip to content",
    "skip to main content", "click here to", "share on facebook", "share on twitter", "powered by wordpress",
    "tous droits réservés", "politique de confidentialité", "mentions légales", "accepter les cookies",
    "alle rechte vorbehalten", "datenschutzerklärung", "cookies akzeptieren", "nutzungsbedingungen",
    "todos los derechos reservados", "política de privacidad", "política de cookies", "aceptar cookies",
)
_STOCK = " OR ".join(f"contains(lower(line), '{x}')" for x in PHRASES)
_ALONE = "'|', '>', '<', '»', '«', '•', '·', '/', '::'"
_SYMBOLS = "length(regexp_replace(%s, '[^#*$%%&|<>]', '', 'g'))"

OP4 = f"""WITH {LINES},
w AS (SELECT *, {WORDS_SQL % "line"} AS words FROM lines),
faults AS (SELECT *, len(words) AS n, length(array_to_string(words, '')) AS chars,
 len(list_filter(words, lambda x: x IN ({_ALONE}))) AS alone, {_SYMBOLS % "line"} AS symbols,
 len(list_filter(words, lambda x: upper(x) = x AND lower(x) <> x)) AS capitals,
 row_number() OVER (PARTITION BY doc_id, line ORDER BY ix) AS nth FROM w),
judged AS (SELECT *, n > 0 AND ((alone > 0 AND alone >= greatest(2, 0.15::DOUBLE * n))
 OR symbols > greatest(2, 0.3::DOUBLE * n) OR {_STOCK}
 OR (n >= 8 AND (capitals > 0.7::DOUBLE * n OR NOT regexp_matches(line, '[.!?:;…"''”’»)。！？]([\\x20\\x09-\\x0D]|$)')))) AS failed FROM faults),
by_doc AS (SELECT doc_id, sum(n)::BIGINT AS n_words, sum(chars)::BIGINT AS word_chars, sum(symbols)::BIGINT AS n_symbols,
 count(*) FILTER (WHERE n > 0 AND nth > 1) AS n_dup_lines, count(*) FILTER (WHERE failed) AS n_failed_lines, coalesce(sum(chars) FILTER (WHERE n > 0 AND NOT failed), 0)::BIGINT AS kept_chars FROM judged GROUP BY doc_id),
tokens AS (SELECT doc_id, {WORDS_SQL % "coalesce(text, '')"} AS t FROM documents),
windows AS (SELECT doc_id, unnest(range(greatest(0, len(t) - 7))) AS i, t FROM tokens),
same AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(t[i + 1 : i + 8], ' ')) AS c FROM windows),
covered AS (SELECT doc_id, count(DISTINCT word_ix) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS word_ix FROM same WHERE c > 1) GROUP BY doc_id),
base AS (SELECT b.*, coalesce(c.n_repeat_words, 0) AS n_repeat_words, CASE WHEN word_chars > 0 THEN kept_chars::DOUBLE / word_chars ELSE 0.0::DOUBLE END AS kept_share FROM by_doc b LEFT JOIN covered c USING (doc_id)),
failing AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND kept_share >= 0.6::DOUBLE AND n_symbols <= 0.3::DOUBLE * n_words
 AND word_chars::DOUBLE / greatest(n_words, 1) BETWEEN 2.0::DOUBLE AND 25.0::DOUBLE AS kept, n_failed_lines, kept_share FROM failing"""

OP5 = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f"""

OP6 = f"""WITH RECURSIVE t AS (SELECT doc_id, {WORDS_SQL % "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) WHEN len(w) = 1 THEN [w[1]] ELSE [] END AS s FROM t),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM sym UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(min(r.b), n.doc_id)) AS component_id, least(n.doc_id, coalesce(min(r.b), n.doc_id)) = n.doc_id AS kept
FROM n LEFT JOIN reach r ON r.a = n.doc_id GROUP BY n.doc_id, n.n"""

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11 = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS ts FROM documents),
c AS (SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0),
p AS (SELECT rid, doc_id, n, term, count(*) AS tf FROM (SELECT rid, doc_id, len(ts) AS n, unnest(ts) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
i AS (SELECT iid, item_id, term, count(*) AS often FROM (SELECT row_number() OVER () AS iid, item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT iid, item_id, rid, doc_id, sum(often * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
 FROM i JOIN w USING (term) JOIN p USING (term), c GROUP BY iid, item_id, rid, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 20"""

_NUMBER = "('0x' || substr(sha256(doc_id::VARCHAR), %d, 8))::BIGINT"
OP12 = f"""WITH n AS (SELECT *, {_NUMBER % 1} AS a, {_NUMBER % 9} AS b, {_NUMBER % 17} AS c FROM documents),
v AS (SELECT doc_id AS version_id, source, n_chars, lang, a % 50000 AS event, a % 50000 - 60 + b % 600 AS arrival, a % 50000 + c % 900 AS expiry FROM n),
known AS (SELECT doc_id, max(source) AS source FROM documents GROUP BY doc_id),
l AS (SELECT row_number() OVER () AS rid, doc_id, source, {_NUMBER % 25} % 50000 AS t FROM labels LEFT JOIN known USING (doc_id)),
met AS (SELECT l.rid, l.doc_id, l.t, v.* EXCLUDE (source) FROM l LEFT JOIN v ON v.source = l.source AND event <= t AND arrival <= t AND t < expiry
 QUALIFY row_number() OVER (PARTITION BY rid ORDER BY event DESC, arrival, version_id DESC NULLS LAST) = 1),
s AS (SELECT *, t - event AS age, CASE WHEN event IS NULL THEN 'none' WHEN t - event > 120 THEN 'stale' ELSE 'fresh' END AS status FROM met)
SELECT doc_id, t, version_id, age, status, CASE WHEN status = 'fresh' THEN n_chars END AS n_chars, CASE WHEN status = 'fresh' THEN lang END AS lang FROM s"""

ORACLES = {
    "op2_line_dedup": OP2,
    "op4_quality_rules": OP4,
    "op5_warc": OP5,
    "op6_near_duplicates": OP6,
    "op11_search": OP11,
    "op12_features": OP12,
}
