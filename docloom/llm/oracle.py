"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from docloom.llm.common import UPPER

LOWER = f"translate(%s, '{UPPER}', '{UPPER.lower()}')"
BENCH_WORDS = f"regexp_extract_all({LOWER % 'text'}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
BLANK_WORDS = "regexp_extract_all(%s, '[^\\x20\\x09-\\x0D]+')"

OP1 = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {BENCH_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item, w[s:s + 12] AS win
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(win) AS l FROM iw),
d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce({BENCH_WORDS}, []) AS w FROM documents),
dw AS (SELECT rid, s, l, w[s:s + l - 1] AS win
       FROM (SELECT rid, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, lens WHERE len(w) >= l)),
h AS (SELECT rid, s, l, item FROM dw JOIN iw USING (win)),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + l)) AS p FROM h) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT rid, item FROM h WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN it USING (rid)
"""

OP5 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text, text AS raw,
                  {BLANK_WORDS % "coalesce(text, '')"} AS w FROM documents),
l AS (SELECT rid, source, raw, line,
             trim(regexp_replace({LOWER % 'line'}, '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') AS norm,
             len({BLANK_WORDS % 'line'}) AS lw
      FROM (SELECT rid, source, raw, unnest(string_split(text, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY rid),
totals AS (SELECT source, count(DISTINCT coalesce('t' || raw, 'n')) AS total FROM d GROUP BY source),
over_limit AS (SELECT c.source, c.norm FROM
         (SELECT source, norm, count(DISTINCT raw) AS docs FROM l GROUP BY source, norm) c
         JOIN totals t ON c.source IS NOT DISTINCT FROM t.source WHERE docs >= 5 AND docs * 100 > total),
gone AS (SELECT rid, sum(lw) AS lw FROM l JOIN over_limit o ON l.source IS NOT DISTINCT FROM o.source AND l.norm = o.norm GROUP BY rid),
win AS (SELECT rid, s, w[s:s + 2] AS win FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS s FROM d WHERE len(w) >= 3)),
twice AS (SELECT rid, win FROM win GROUP BY rid, win HAVING count(*) > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(s, s + 3)) AS p FROM win JOIN twice USING (rid, win)) GROUP BY rid),
s AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
             CAST(len(w) - coalesce(gone.lw, 0) AS BIGINT) AS n_words_left
      FROM d LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_words_left >= 50 * n_words AS kept
FROM s
"""

OP7 = f"""
WITH d AS (SELECT doc_id, source, text, coalesce(len({BLANK_WORDS % 'text'}), 0) AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
             source_size * 2 AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM s),
f AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
      FROM r),
m AS (SELECT max(level) AS final FROM f WHERE level * weight <= cap),
t AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, least(CAST(cap AS DOUBLE), coalesce(final * weight, cap)) AS target FROM f, m),
x AS (SELECT doc_id, d.source, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
             CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'text ' || md5(coalesce(text, ''))) || '|mix-1'), 1, 4) AS BIGINT) AS coin
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT source, coin, sum(size) AS words, any_value(target - floor(rate) * source_size) AS wanted FROM x GROUP BY source, coin),
e AS (SELECT source, coin, wanted, sum(words) OVER (PARTITION BY source ORDER BY coin) - words + words / 2 AS middle FROM c),
k AS (SELECT source, max(coin) + 1 AS mark FROM e WHERE middle <= wanted AND wanted > 0 GROUP BY source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN coin < coalesce(mark, 0) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM x LEFT JOIN k ON x.source IS NOT DISTINCT FROM k.source
"""

OP10 = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce({BLANK_WORDS % (LOWER % 'text')}, []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i:i + 3] AS sh
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b USING (sh) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles,
       least(d.doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = d.doc_id), d.doc_id)) AS component_id,
       (SELECT count(*) FROM l WHERE l.a = d.doc_id) AS n_links
FROM d LEFT JOIN n USING (doc_id)
"""

OP9 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
g AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM g)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM m
"""

TERMS = f"regexp_extract_all({LOWER % "coalesce(text, '')"}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {TERMS} AS t FROM documents),
c AS (SELECT count(*) AS n_docs, sum(len(t)) AS n_terms FROM d WHERE len(t) > 0),
p AS (SELECT rid, doc_id, n, term, count(*) AS tf FROM (SELECT rid, doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
q AS (SELECT DISTINCT iid, item_id, term FROM (SELECT iid, item_id, unnest(t) AS term FROM (SELECT row_number() OVER () AS iid, item_id, {TERMS} AS t FROM benchmark))),
s AS (SELECT iid, item_id, rid, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
      FROM q JOIN f USING (term) JOIN p USING (term), c GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) <= 50
"""

ORACLES = {"op13_ranked_search": OP13, "op9_warc_zip": OP9, "op10_jaccard": OP10, "op1_decontamination": OP1, "op5_quality": OP5, "op7_mixing": OP7}
