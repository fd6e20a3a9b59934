"""The same results in DuckDB's SQL for the queries that SQL can express on whole tables."""

WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

SUBSTRING = f"""
WITH w AS (SELECT doc_id, {WORDS} AS words FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS t FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w)),
firsts AS (SELECT t, min(doc_id) AS d FROM win GROUP BY t),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN firsts USING (t) WHERE d < doc_id),
each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w),
marked AS (SELECT e.doc_id, e.word, e.p, g.p IS NULL AS stays FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p),
kept AS (SELECT doc_id, count(*) FILTER (NOT stays) AS n, string_agg(word, ' ' ORDER BY p) FILTER (stays) AS t FROM marked GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINES = f"""
WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, translate(trim(line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, f.key IS NULL OR f.last = k.doc_id AS stays FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""

MIXING = f"""
WITH d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size,
    -ln((('0x' || substr(md5('mix-' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
      / coalesce(greatest(pow(length(translate(text, '#*$%&|<>!', ''))::DOUBLE / greatest(length(text), 1), 8.0), 0.05), 0.05) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM d GROUP BY source),
c AS (SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total, sum(w) OVER () AS ws FROM s),
o AS (SELECT *, (total - coalesce(sum(cap) OVER p, 0)) / (ws - coalesce(sum(w) OVER p, 0)) AS level, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS place FROM c
  WINDOW p AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, CASE WHEN level > cap / w THEN cap::DOUBLE ELSE least((SELECT arg_min(level, place) FROM o WHERE level <= cap / w) * w, cap::DOUBLE) END AS target FROM o),
e AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
x AS (SELECT d.doc_id, size, source_size, target, epochs, floor(target)::BIGINT - epochs * source_size AS rest,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, coalesce(d.doc_id::VARCHAR, 'null'), size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM x
"""

_FIT = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
_RULES = (("www.example.com", "/en/", "allow"), ("example.com", "/en/", "block"), ("net", "/es/", "block"), ("net", "/fr/", "block"), ("com", "/", "allow"))
_RULE = "CASE " + " ".join(f"WHEN {_FIT.format(h=h, p=p)} THEN '{h}{p}'" for h, p, _ in _RULES) + " END"
_VERDICT = "CASE " + " ".join(f"WHEN {_FIT.format(h=h, p=p)} THEN '{v}'" for h, p, v in _RULES) + " END"


def _strength(table: str) -> str:
    """The prior's pseudo-counts by the method of moments, as a scalar subquery."""
    return f"""(SELECT CASE WHEN g < 2 OR n IS NULL THEN 1.0 WHEN b > 0 AND v > 0 THEN least(1000.0, greatest(1.0, v / b - 1)) WHEN b > 0 THEN 1.0 ELSE 1000.0 END FROM (
      SELECT *, (square - n * m * m - v * (g - 1)) / n AS b FROM (SELECT *, m * (1 - m) AS v FROM (
      SELECT sum(n)::DOUBLE AS n, count(*) AS g, sum(good)::DOUBLE / sum(n) AS m, sum(n * (good / n) * (good / n)) AS square FROM {table} WHERE n > 0))))"""


URLS = rf"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
j AS (SELECT *, {_RULE} AS rule, {_VERDICT} AS verdict FROM u),
h AS (SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix, count(verdict) AS n, count(*) FILTER (verdict = 'allow') AS good FROM j GROUP BY host),
d AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM d GROUP BY ALL),
c AS (SELECT {_strength('s')} AS cs, {_strength('d')} AS cd, {_strength('h')} AS ch, (SELECT (coalesce(sum(good), 0) + 0.5) / (coalesce(sum(n), 0) + 1.0) FROM s) AS overall),
sm AS (SELECT suffix, (good + cs * overall) / (n + cs) AS m FROM s, c),
dm AS (SELECT domain, (d.good + cd * sm.m) / (d.n + cd) AS m FROM d JOIN sm USING (suffix), c),
hm AS (SELECT host, (h.good + ch * dm.m) / (h.n + ch) AS m, h.n + ch AS size FROM h JOIN dm USING (domain), c)
SELECT page_id, j.host, path, rule, coalesce(verdict, CASE WHEN m - sqrt(m * (1 - m) / (size + 1)) < 0.25 THEN 'block' ELSE 'allow' END) AS verdict FROM j JOIN hm ON j.host = hm.host
"""
