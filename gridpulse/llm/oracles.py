"""DuckDB SQL for the operators whose results SQL can state, written without the operators' shortcuts."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all(translate(coalesce({0}, ''), '" + _UPPER + "', '" + _LOWER + \
    r"'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def licenses(templates: dict[str, str], least: float = 0.8) -> str:
    """Every document against every template's shingles."""
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(templates.items()))
    grams = ("SELECT DISTINCT {0} AS id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), "
             "lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM {1} WHERE len(w) > 0")
    return f"""
WITH t(template_id, text) AS (VALUES {rows}),
tw AS (SELECT template_id, {_WORDS.format('text')} AS w FROM t),
tg AS ({grams.format('template_id', 'tw')}),
d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
dw AS (SELECT r, {_WORDS.format('text')} AS w FROM d),
dg AS ({grams.format('r', 'dw')}),
n AS (SELECT id, count(*) AS n FROM tg GROUP BY id),
hit AS (SELECT dg.id AS r, tg.id AS template_id FROM dg JOIN tg USING (g) JOIN n ON n.id = tg.id
        GROUP BY dg.id, tg.id HAVING count(*) >= {least} * any_value(n.n)),
agg AS (SELECT r, count(*) AS c, string_agg(template_id, ',' ORDER BY template_id) AS s FROM hit GROUP BY r)
SELECT doc_id, coalesce(c, 0)::BIGINT AS n_licenses, coalesce(s, '') AS licenses FROM d LEFT JOIN agg USING (r)"""


QUALITY_RULES = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
p AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM p) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS k FROM again) GROUP BY r),
l AS (SELECT r, line FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM l GROUP BY r),
rules AS (SELECT doc_id, source, len(w)::BIGINT AS n_words,
                 coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
                 length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                 coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
          FROM d JOIN w USING (r) LEFT JOIN covered USING (r) LEFT JOIN dup USING (r)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM rules),
hosts AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (WHERE base_failed)::DOUBLE AS f
          FROM judged WHERE source IS NOT NULL GROUP BY source),
sums AS (SELECT sum(f) / sum(n) AS m, sum(f * f / n) / sum(n) AS sq, count(*) / sum(n) AS h FROM hosts),
prior AS (SELECT m, CASE WHEN (sq - m * m - m * (1 - m) * h) * 1e6 <= m * (1 - m) THEN 1e6
                         ELSE greatest(m * (1 - m) / (sq - m * m - m * (1 - m) * h) - 1, 1) END AS k FROM sums),
bad AS (SELECT source FROM hosts, prior WHERE (f + m * k) / (n + k) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM bad)) AS kept FROM judged"""

DECONTAMINATE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format('text')} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, w, least(13, len(w)) AS n
      FROM (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark) WHERE len(w) > 0),
bg AS (SELECT DISTINCT item, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM b),
sizes AS (SELECT DISTINCT n FROM b),
dg AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT r, i, bg.n, item FROM dg JOIN bg ON bg.n = dg.n AND bg.g = array_to_string(w[i:i + dg.n - 1], ' ')),
words AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(items.s, '')) AS items_sha256,
       coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""

_ASSIGN = r"((?i:password|passwd|secret|token|api_?key)[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+))"
_PLACES = r"""SELECT r, {kind} AS kind, sum(length(gap) + length(m)) OVER before - length(m) AS s,
       sum(length(gap) + length(m)) OVER before AS e, m, v
FROM (SELECT r, unnest(regexp_extract_all(text, '(?s)(.*?){pattern}', 1)) AS gap,
             unnest(regexp_extract_all(text, '(?s)(.*?){pattern}', 2)) AS m,
             unnest(regexp_extract_all(text, '(?s)(.*?){pattern}', {value})) AS v,
             unnest(range(1, len(regexp_extract_all(text, '{pattern}')) + 1)) AS i FROM d WHERE regexp_matches(text, '{pattern}'))
WINDOW before AS (PARTITION BY r ORDER BY i)"""


def _places(kind: int, pattern: str, value: int = 2) -> str:
    return _PLACES.format(kind=kind, pattern=pattern, value=value)


_ALLOWED = r"""(regexp_matches(m, '(?i:example|placeholder|changeme|your[_-]|dummy|sample|redacted|xxxx)')
               OR regexp_full_match(m, '[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}') OR regexp_full_match(m, '[0-9]+'))"""

SECRETS = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
base AS (SELECT * FROM ({_places(0, _ASSIGN, 3)}) WHERE length(v) >= 6
         UNION ALL {_places(1, '(AKIA[A-Z0-9]{16,})')} UNION ALL {_places(2, '([0-9a-f]{24,})')}),
whole AS (SELECT row_number() OVER () AS w, r, s::BIGINT AS s, e::BIGINT AS e, m FROM ({_places(3, '([A-Za-z0-9+/_=-]{20,})')})
          WHERE NOT {_ALLOWED}),
cuts AS (SELECT w, greatest(base.s, whole.s) AS s, least(base.e, whole.e) AS e FROM whole JOIN base USING (r)
         WHERE base.s < whole.e AND whole.s < base.e UNION ALL SELECT w, e, e FROM whole),
gaps AS (SELECT w, max(e) OVER (PARTITION BY w ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s, s AS e FROM cuts),
parts AS (SELECT r, coalesce(gaps.s, whole.s)::BIGINT AS s, gaps.e::BIGINT AS e, whole.s AS begins, m FROM gaps JOIN whole USING (w)),
cand AS (SELECT row_number() OVER () AS c, r, s, e, substring(m, s - begins + 1, e - s) AS m FROM parts WHERE e - s >= 20),
likely AS (SELECT *, CASE WHEN regexp_full_match(m, '[0-9a-fA-F]+') AND m ~ '.*[0-9].*' AND m ~ '.*[a-fA-F].*' THEN 3.0
                          WHEN m ~ '.*[0-9].*' AND m ~ '.*[a-zA-Z].*' THEN 3.6
                          WHEN m ~ '.*[a-z].*' AND m ~ '.*[A-Z].*' THEN 3.9 END AS least
           FROM cand WHERE NOT {_ALLOWED}
             AND NOT regexp_full_match(m, '(?:[A-Za-z]?[a-z]+|[A-Z]+)(?:[-_/+=](?:[A-Za-z]?[a-z]*|[A-Z]*|[0-9]{{1,4}}))*')),
letters AS (SELECT c, i, unnest(string_split(substring(m, i, 20), '')) AS ch
            FROM (SELECT c, m, unnest(range(1, length(m) - 18)) AS i FROM likely WHERE least IS NOT NULL)),
spread AS (SELECT c, i, -sum(n / 20.0 * log2(n / 20.0)) AS h
           FROM (SELECT c, i, ch, count(*)::DOUBLE AS n FROM letters GROUP BY c, i, ch) GROUP BY c, i),
high AS (SELECT r, 3 AS kind, any_value(s) + min(i) - 1 AS s, any_value(s) + max(i) + 19 AS e
         FROM spread JOIN likely USING (c) WHERE h >= least - 1e-9 GROUP BY r, c),
shown AS (SELECT r, kind, s, e, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || s::BIGINT || ':' || e::BIGINT AS t
          FROM (SELECT r, kind, s, e FROM base UNION ALL SELECT r, kind, s, e FROM high)),
agg AS (SELECT r, count(*) FILTER (WHERE kind = 0) AS a, count(*) FILTER (WHERE kind = 1) AS k, count(*) FILTER (WHERE kind = 2) AS x,
               string_agg(t, ',' ORDER BY s, kind) FILTER (WHERE kind < 3) AS b, string_agg(t, ',' ORDER BY s, kind) AS spans
        FROM shown GROUP BY r)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(k, 0)::BIGINT AS n_access, coalesce(x, 0)::BIGINT AS n_hex,
       sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN agg USING (r)"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, strlen(h) AS n, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((('0x' || substr(x, ((k // 4) * 5 + 1)::INT, 5))::BIGINT >> ((3 - k % 4) * 5)::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM s"""

# Unsigned crc32 of a decimal number, byte by byte without a table.
_CRC = ("(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split_regex({0}::VARCHAR, ''), lambda ch: ascii(ch)::UBIGINT)), "
        "lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda i: 0::UBIGINT)), "
        "lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END)))")

PREFIX_TRIE = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
                  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, xor({_CRC.format('conv_id')}, 4294967295::UBIGINT)::BIGINT % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
base AS (SELECT conv_id AS b, count(*) AS n FROM t GROUP BY 1),
r AS (SELECT c.conv_id, t.pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.pos <= h
      UNION ALL
      SELECT c.conv_id, t.pos - h + least(h, coalesce(base.n, 0)), role, text
      FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > h LEFT JOIN base ON base.b = c.conv_id - c.conv_id % 5),
w AS (SELECT conv_id, list(sha256(strlen(role) || ':' || role || text) ORDER BY pos) AS ids,
             list(strlen(text) ORDER BY pos) AS sizes FROM r GROUP BY conv_id),
g AS (SELECT c.conv_id, coalesce(ids, []) AS ids, coalesce(sizes, []) AS sizes FROM c LEFT JOIN w USING (conv_id)),
m AS (SELECT conv_id, d, len(ids) AS n, array_to_string(ids[:d], '') AS node, array_to_string(ids[:d - 1], '') AS up,
             CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size
      FROM (SELECT conv_id, ids, sizes, unnest(range(len(ids) + 1)) AS d FROM g)),
v AS (SELECT node, any_value(up) AS up, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
             (count(*) - 1) * any_value(size) AS own,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM m GROUP BY node),
k AS (SELECT up, count(*) AS n FROM v WHERE depth > 0 GROUP BY up),
x AS (SELECT v.*, coalesce(k.n, 0) AS n_children FROM v LEFT JOIN k ON k.up = v.node),
sub AS (SELECT m.node, sum(x.own) AS saved, count(*) FILTER (x.n_children = 0) AS leaves
        FROM x JOIN m ON m.conv_id = x.conv_id AND m.d <= x.depth GROUP BY m.node)
SELECT x.conv_id, x.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, x.n_convs, x.n_children,
       leaves AS n_leaves, saved::BIGINT AS saved_tokens, x.ends_sha256
FROM x JOIN sub USING (node) LEFT JOIN x AS p ON x.depth > 0 AND p.node = x.up"""
