"""DuckDB SQL for the queries that SQL can express."""

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex({_FOLD.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 2 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w
), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND a.n * 5 >= b.n * 4 AND b.n * 5 >= a.n * 4 GROUP BY ALL),
l AS (SELECT a, b FROM c WHERE 100 * k >= 80 * (na + nb - k)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS other FROM both_ways UNION SELECT r.doc_id, x.b FROM r JOIN both_ways x ON x.a = r.other),
m AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY 1)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id,
  s.doc_id = coalesce(m.component_id, s.doc_id) AS kept
FROM s LEFT JOIN m ON m.doc_id = s.doc_id
"""

_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP9 = f"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM t),
k AS (SELECT *, {_FOLD.format(f"trim(line, {_STRIP})")} AS key FROM e),
f AS (SELECT key, min(doc_id) AS lo, max(doc_id) AS hi FROM k WHERE length(key) >= 10 GROUP BY key HAVING lo < hi),
d AS (SELECT k.doc_id, k.i, k.line, f.key IS NOT NULL AND k.doc_id <> f.lo AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""

_DEAL = """{name} AS (
  SELECT *, CASE WHEN is_full THEN cap ELSE ((budget - coalesce(sum(cap) FILTER (is_full) OVER g, 0)) * w) // sum(w) FILTER (NOT is_full) OVER g END AS share
  FROM (SELECT *, cap * (sum(w) OVER g - coalesce(sum(w) OVER b, 0)) <= (budget - coalesce(sum(cap) OVER b, 0)) * w AS is_full
    FROM ({nodes}) WINDOW g AS (PARTITION BY {parents}), b AS (PARTITION BY {parents} ORDER BY cap::DOUBLE / w::DOUBLE, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  WINDOW g AS (PARTITION BY {parents})
)"""


def mixing_sql(weights: dict, budget_percent: int, max_epochs: int, seed: int) -> str:
    def weight(level):
        whens = "".join(f" WHEN '{k}' THEN {v}" for k, v in weights.get(level, {}).items())
        return f"(CASE {level}{whens} ELSE 1 END)::HUGEINT" if whens else "1::HUGEINT"

    d = _DEAL.format(name="dd", parents="0", level="domain", nodes=f"SELECT domain, sum(cap) AS cap, {weight('domain')} AS w, (SELECT sum(tokens) * {budget_percent} // 100 FROM leaf) AS budget FROM leaf GROUP BY domain")
    g = _DEAL.format(name="dl", parents="domain", level="lang", nodes=f"SELECT x.*, {weight('lang')} AS w, dd.share AS budget FROM (SELECT domain, lang, sum(cap) AS cap FROM leaf GROUP BY ALL) x JOIN dd USING (domain)")
    s = _DEAL.format(name="ds", parents="domain, lang", level="source", nodes=f"SELECT x.*, {weight('source')} AS w, dl.share AS budget FROM (SELECT domain, lang, source, sum(cap) AS cap FROM leaf GROUP BY ALL) x JOIN dl USING (domain, lang)")
    return f"""
WITH base AS (
  SELECT doc_id, coalesce(source, 'none') AS source, coalesce(lang, 'und') AS lang, (octet_length(encode(coalesce(text, ''))) + 3) // 4 AS n_tokens,
    CASE WHEN regexp_extract(coalesce(source, 'none'), '([0-9]{{1,9}})', 1) <> '' THEN 'domain' || (regexp_extract(source, '([0-9]{{1,9}})', 1)::BIGINT % 4) ELSE 'domain-other' END AS domain
  FROM documents
), leaf AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens, sum(n_tokens)::HUGEINT * {max_epochs} AS cap FROM base GROUP BY ALL),
{d}, {g}, {s},
plan AS (SELECT leaf.domain, leaf.lang, leaf.source, CASE WHEN tokens = 0 THEN 1 ELSE share // tokens END AS whole, CASE WHEN tokens = 0 THEN 0 ELSE share % tokens END AS part
  FROM leaf JOIN ds USING (domain, lang, source)),
k AS (SELECT base.*, whole, part, md5('{seed}:' || whole || ':' || coalesce(doc_id::VARCHAR, '')) AS key FROM base JOIN plan USING (domain, lang, source)),
c AS (SELECT *, whole + (part > 0 AND sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id::VARCHAR ROWS UNBOUNDED PRECEDING) <= part)::INT AS copies FROM k)
SELECT doc_id, domain, lang, source, n_tokens::BIGINT AS n_tokens, unnest(range(copies::BIGINT))::BIGINT AS epoch FROM c
"""


def sharding_sql(limit: int) -> str:
    return f"""
WITH base AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
up AS (SELECT *, h >> (60 - d) AS p FROM (SELECT *, unnest(range(61))::INT AS d FROM base)),
nodes AS (SELECT d, p, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM up GROUP BY d, p HAVING sum(n_bytes) <= {limit} OR min(h) = max(h)),
f AS (SELECT doc_id, n_bytes, h, min(d) AS d FROM up JOIN nodes USING (d, p) GROUP BY ALL)
SELECT f.doc_id, f.n_bytes, f.d::BIGINT AS shard_bits, CASE WHEN f.d = 0 THEN '' ELSE lpad(bin(h >> (60 - f.d)), f.d, '0') END AS shard, shard_bytes, shard_rows
FROM f JOIN nodes ON nodes.d = f.d AND nodes.p = f.h >> (60 - f.d)
"""

OP1 = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, i, md5_number(substr(x, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, unnest(range(length(x) // 2 - 199)) AS i, x FROM t WHERE length(x) >= 400)),
w AS (SELECT doc_id, i, n FROM p JOIN (SELECT k, count(*) AS n FROM p GROUP BY k HAVING count(*) > 1) USING (k)),
g AS (SELECT doc_id, i, max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM w),
r AS (SELECT doc_id, i, sum(CASE WHEN prev IS NULL OR i > prev + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g),
s AS (SELECT doc_id, k, min(i) AS lo, max(i) + 200 AS hi FROM r GROUP BY ALL),
q AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM s),
c AS (SELECT doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans, max(hi) AS last,
  string_agg(substr(x, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS kept
  FROM q JOIN t USING (doc_id) GROUP BY doc_id)
SELECT t.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN c.doc_id IS NULL THEN x ELSE kept || substr(x, 2 * last + 1) END)) AS kept_sha256
FROM t LEFT JOIN c ON c.doc_id = t.doc_id
"""

LICENSE_BASE = f"""
WITH w AS (SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
p AS (SELECT doc_id, i - 1 AS place, label FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)
  JOIN (VALUES ('cc by', 2, 'cc-by'), ('general public license', 3, 'gpl'), ('all rights reserved', 3, 'reserved')) v(phrase, n, label)
  ON array_to_string(ws[i : i + n - 1], ' ') = phrase),
g AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels
FROM w LEFT JOIN g ON g.doc_id = w.doc_id
"""

QUALITY_BASE = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
k AS (SELECT doc_id, i, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) > 4)),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT k.doc_id, unnest(range(k.i, k.i + 5)) AS j FROM k JOIN (SELECT doc_id, g FROM k GROUP BY ALL HAVING count(*) > 1) d ON d.doc_id = k.doc_id AND d.g = k.g) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE trim(line, {_STRIP}) <> '' GROUP BY doc_id),
s AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
  coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r ON r.doc_id = w.doc_id LEFT JOIN l ON l.doc_id = w.doc_id)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s
"""

OP11 = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
n AS (SELECT *, sqrt(list_dot_product(x, x)) AS size FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_dot_product(a.x, b.x) / (a.size * b.size) >= 0.93),
r AS (SELECT a AS vec_id, a AS other FROM l UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.other),
m AS (SELECT vec_id, min(other) AS component_id FROM r GROUP BY 1), k AS (SELECT a, count(*) AS n_links FROM l GROUP BY 1)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, e.vec_id) AS component_id, coalesce(component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN m ON m.vec_id = e.vec_id LEFT JOIN k ON k.a = e.vec_id
"""

_TERMS = "regexp_extract_all(" + _FOLD.format("coalesce(text, '')") + ", '{}')"

OP12 = f"""
WITH d AS (SELECT doc_id, {_TERMS.format("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")} AS ws FROM documents),
t AS (SELECT doc_id, len(ws)::BIGINT AS n, unnest(ws) AS term FROM d WHERE len(ws) > 0),
c AS (SELECT count(*) AS docs, sum(len(ws))::BIGINT AS places FROM d WHERE len(ws) > 0),
i AS (SELECT DISTINCT item_id, unnest({_TERMS.format("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")}) AS term FROM benchmark),
f AS (SELECT doc_id, n, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, c GROUP BY term),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // places))))::BIGINT AS score
  FROM i JOIN f USING (term) JOIN w USING (term), c GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0) WHERE rank <= 50
"""

OP13 = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TERMS.format("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+")} AS ws FROM documents),
t AS (SELECT doc_id, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS places FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (places + v))::BIGINT AS p
  FROM g JOIN s ON s.lang = g.lang AND s.source = g.source JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lang, term, (1 + (1000000000::HUGEINT * (sum(n) + 1)) // (any_value(places) + any_value(v)))::BIGINT AS q
  FROM c JOIN (SELECT lang, sum(places) AS places FROM s GROUP BY lang) USING (lang) JOIN v USING (lang) GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) z
  ON z.lang = a.lang AND z.source = a.source AND z.other = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank FROM (FROM pairs UNION ALL FROM terms))
WHERE part = 'pair' OR rank <= 200
"""
