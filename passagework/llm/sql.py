"""DuckDB queries that must give the same rows as the registered queries."""

_FOLD = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str) -> str:
    return f"regexp_extract_all({_FOLD.format(text)}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


DECONTAMINATION = f"""
WITH doc AS (SELECT doc_id, {_words('text')} AS w FROM documents),
item AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_words('text')} AS w FROM benchmark
),
sized AS (SELECT item, w, least(len(w), 13) AS t FROM item WHERE len(w) > 0),
item_win AS (
  SELECT DISTINCT item, t, array_to_string(w[i + 1:i + t], ' ') AS win
  FROM (SELECT item, t, w, unnest(range(0, len(w) - t + 1)) AS i FROM sized)
),
lengths AS (SELECT DISTINCT t FROM sized),
doc_win AS (
  SELECT doc_id, t, i, array_to_string(w[i + 1:i + t], ' ') AS win
  FROM (SELECT doc_id, t, w, unnest(range(0, len(w) - t + 1)) AS i FROM doc, lengths WHERE len(w) >= t)
),
hit AS (SELECT d.doc_id, d.t, d.i, d.win, m.item FROM doc_win d JOIN item_win m ON d.win = m.win AND d.t = m.t),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + t)) AS p FROM hit) GROUP BY doc_id
),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM doc d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_RULES = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", "(?i)", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", "", 0, 16),
    ("hex", r"[0-9a-f]+", "", 0, 32),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "", 0, 1),
    ("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "", 0, 1),
    ("bearer", r"xox[abprs]-[A-Za-z0-9-]{10,}", "", 0, 1),
]


def _rule(order: int, kind: str, pattern: str, flag: str, group: int, least: int) -> str:
    return f"""
SELECT doc_id, {order} AS o, '{kind}' AS kind, s, s + long AS e FROM (
  SELECT doc_id, list_sum(list_transform(gaps[1:i], lambda x: length(x)))
      + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s,
    length(m[i]) AS long, length(g[i]) AS judged
  FROM (
    SELECT doc_id, m, g, gaps, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(t, '{flag}{pattern}', 0) AS m,
        regexp_extract_all(t, '{flag}{pattern}', {group}) AS g,
        regexp_split_to_array(t, '{flag}{pattern}') AS gaps
      FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
    )
  )
) WHERE judged >= {least}"""


SECRETS = f"""
WITH span AS ({' UNION ALL '.join(_rule(i, *r) for i, r in enumerate(_RULES))}),
per AS (
  SELECT doc_id, count(*) FILTER (o = 0) AS a, count(*) FILTER (o = 1) AS k, count(*) FILTER (o = 2) AS h,
    string_agg(kind || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(e AS BIGINT) AS VARCHAR), ',' ORDER BY s, o) AS spans,
    string_agg(kind || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(e AS BIGINT) AS VARCHAR), ',' ORDER BY s, o)
      FILTER (o < 3) AS base
  FROM span GROUP BY doc_id
)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN per USING (doc_id)
"""

_RESOLVED = r"""CASE WHEN {0} = '' THEN '/' WHEN regexp_matches({0}, '(?:^|/)\.\.?(?:/|$)') THEN
    array_to_string(list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split({0}, '/'), lambda s: [s])),
      lambda done, s: CASE WHEN s[1] = '..' THEN done[1:greatest(len(done) - 1, 1)] WHEN s[1] = '.' THEN done
        ELSE list_concat(done, s) END), '/')
    || CASE WHEN regexp_matches({0}, '(?:^|/)\.\.?$') THEN '/' ELSE '' END ELSE {0} END"""
_HOST = (
    r"translate(coalesce(regexp_extract({0}, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), "
    r"'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
)
_PATH = r"coalesce(regexp_extract({0}, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '')"
_QUERY = r"coalesce(regexp_extract({0}, '(?s)^.*?://[^?#]*(\?[^#]*)', 1), '')"


def _node(url: str) -> str:
    host = f"regexp_replace({_HOST.format(url)}, ':(?:80|443)$', '')"
    return f"CASE WHEN {host} <> '' THEN {host} || {_RESOLVED.format(_PATH.format(url))} || {_QUERY.format(url)} END"


def _rule_of(host: str, path: str) -> str:
    return f"""CASE WHEN ({host} = 'example.org' OR {host} LIKE '%.example.org') AND starts_with({path}, '/en/1') THEN 'example.org/en/1'
      WHEN ({host} = 'example.org' OR {host} LIKE '%.example.org') AND starts_with({path}, '/es/') THEN 'example.org/es/'
      WHEN ({host} = 'com' OR {host} LIKE '%.com') AND starts_with({path}, '/fr/') THEN 'com/fr/'
      WHEN ({host} = 'com' OR {host} LIKE '%.com') AND starts_with({path}, '/de/') THEN 'com/de/'
      WHEN ({host} = 'org' OR {host} LIKE '%.org') AND starts_with({path}, '/') THEN 'org/' END"""


def url_filter(pages: str) -> str:
    """The verdicts on a table of pages."""
    return rf"""
WITH RECURSIVE ruled AS (
  SELECT page_id, html, url, {_HOST.format('url')} AS host, {_PATH.format('url')} AS path, {_node('url')} AS node,
    {_rule_of(_HOST.format('url'), _PATH.format('url'))} AS rule
  FROM {pages}
),
tag AS (
  SELECT url, host, path, node, unnest(regexp_extract_all(coalesce(html, ''), '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM ruled
),
target AS (
  SELECT url, host, path, node, regexp_replace(trim(CASE
      WHEN regexp_matches(tag, '(?is)^<link\b.*\brel\s*=\s*["'']?canonical\b')
        THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
      WHEN regexp_matches(tag, '(?is)^<meta\b.*\bhttp-equiv\s*=\s*["'']?refresh\b')
        THEN regexp_extract(tag, '(?is)\bcontent\s*=\s*["'']?\s*[0-9.]*\s*[;,]\s*url\s*=\s*["'']?([^"''>\s]+)', 1) END), '(?s)#.*', '') AS t
  FROM tag
),
whole AS (
  SELECT node, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t
      WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
      WHEN starts_with(t, '//') THEN 'x:' || t
      WHEN starts_with(t, '/') THEN 'x://' || host || t
      WHEN starts_with(t, '?') THEN 'x://' || host || path || t
      WHEN t <> '' THEN 'x://' || host || coalesce(nullif(regexp_extract(path, '(?s)^(.*/)', 1), ''), '/') || t END AS u
  FROM target WHERE node IS NOT NULL
),
link AS (SELECT a, b FROM (SELECT node AS a, {_node('u')} AS b FROM whole) WHERE b IS NOT NULL AND a <> b),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (
  SELECT a, a AS b FROM both_ways
  UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a
),
grp AS (SELECT a AS node, min(b) AS low FROM reach GROUP BY a),
named AS (
  SELECT low, {_rule_of("regexp_extract(node, '(?s)^([^/?]*)', 1)", "regexp_extract(node, '(?s)^[^/?]*([^?]*)', 1)")} AS rule FROM grp
  UNION ALL SELECT low, rule FROM ruled JOIN grp USING (node)
),
blocked AS (SELECT DISTINCT low FROM named WHERE rule IN ('example.org/es/', 'example.org/en/1', 'com/de/'))
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN low IN (SELECT low FROM blocked) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN grp USING (node)
"""


# Links for pages that hold none: the id decides the kind and the target.
LINKED_PAGES = """(SELECT page_id, url, coalesce(html, '') || CASE page_id % 6
  WHEN 0 THEN '<link href="http://shop.example.com/fr/../de/' || page_id % 3 || '" rel=canonical>'
  WHEN 1 THEN '<meta http-equiv="refresh" content="0; url=../es/./' || page_id % 40 || '">'
  WHEN 2 THEN '<link rel="canonical" href="?ref=' || page_id % 5 || '#top">'
  WHEN 3 THEN '<meta http-equiv=refresh content="3;url=//mirror.example.net/' || page_id // 9 || '">'
  WHEN 4 THEN '<link rel=canonical href="mailto:a@b.c"><link rel=canonical href="http://mirror.example.net:80/' || page_id // 9 || '">'
  ELSE '' END AS html FROM pages)"""

FIXITY = r"""
WITH made AS (
  SELECT page_id, coalesce(CAST(page_id AS VARCHAR), '') AS name, coalesce(url, '') AS u, coalesce(html, '') AS body,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:x-page:'
      || replace(replace(coalesce(CAST(page_id AS VARCHAR), ''), chr(13), '%0D'), chr(10), '%0A')
      || '>' || chr(13) || chr(10) || 'WARC-Target-URI: '
      || replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A')
      || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: '
      || CAST(strlen(coalesce(html, '')) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10)
      || coalesce(html, '') AS record
  FROM pages
),
sized AS (SELECT greatest(1, CAST(ceil(sum(strlen(record)) / 16777216.0) AS BIGINT)) AS archives FROM made),
placed AS (
  SELECT *, CAST(('0x' || substr(md5(name || ' ' || u), 1, 8)) AS BIGINT) % archives AS archive FROM made, sized
)
SELECT page_id, archive, row_number() OVER w - 1 AS ordinal,
  CAST(coalesce(sum(strlen(record) + 4) OVER (PARTITION BY archive ORDER BY page_id NULLS FIRST, u, record
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
  CAST(strlen(record) AS BIGINT) AS long, sha256(record) AS digest,
  CASE WHEN length(body) % 97 = 0 AND body LIKE '%>' THEN 'changed' END AS fault
FROM placed WINDOW w AS (PARTITION BY archive ORDER BY page_id NULLS FIRST, u, record)
"""

# The checksum of each byte follows from the polynomial; a text's is folded over its bytes.
SHARDS = """
WITH rule AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_concat([CAST(b AS BIGINT)], range(8)),
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS sums
),
measured AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, xor(4294967295, list_reduce(
      list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
        lambda h: CAST('0x' || h AS BIGINT))),
      lambda c, b: xor(c >> 8, sums[(xor(c, b) & 255) + 1]))) AS text_crc32
  FROM documents, rule
),
placed AS (
  SELECT *, row_number() OVER w AS nth, 2 * sum(size) OVER w - size AS middle, 2 * sum(size) OVER () AS whole
  FROM measured WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)
),
cut AS (SELECT *, CAST(least(15, 16 * middle // whole) AS INTEGER) AS shard FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, shard,
  nth - min(nth) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM cut
"""

FILTER_AUDIT = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS copied
  FROM documents
),
marked AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
),
doc AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, list_filter([
      CASE WHEN len(w) < 50 THEN 'A' END,
      CASE WHEN 100 * list_unique(w) < 65 * len(w) THEN 'B' END,
      CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) THEN 'C' END,
      CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
      CASE WHEN copied THEN 'E' END], lambda f: f IS NOT NULL) AS fails
  FROM words LEFT JOIN marked USING (doc_id)
),
alike AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM doc GROUP BY part, fails
),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
  FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
),
steps AS (
  SELECT filter_order, step, filter_order[step] AS f, string_split(filter_order[1:step - 1], '') AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
),
counted AS (
  SELECT part, filter_order, step, f,
    sum(n) FILTER (NOT list_has_any(fails, list_append(before, f))) AS kept,
    sum(n) FILTER (list_contains(fails, f) AND NOT list_has_any(fails, before)) AS removed,
    sum(n) FILTER (list_contains(fails, f) AND list_has_any(fails, before)) AS redundant,
    sum(n) FILTER (fails = [f]) AS unique_fails,
    sum(good) FILTER (list_contains(fails, f) AND NOT list_has_any(fails, before)) AS good_lost,
    sum(toxic) FILTER (list_contains(fails, f) AND NOT list_has_any(fails, before)) AS toxic_lost
  FROM alike, steps GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept,
  CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
  CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""

TWINS = {
    "op12_byte_shards": SHARDS,
    "op13_filter_interaction": FILTER_AUDIT,
    "op6_warc_fixity": FIXITY,
    "op1_decontamination": DECONTAMINATION,
    "op2_secrets": SECRETS,
    "op8_url_filter": url_filter("pages"),
    "url_filter_linked": url_filter(LINKED_PAGES),
}
