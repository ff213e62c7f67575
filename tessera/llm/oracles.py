"""DuckDB SQL of the operators that SQL can express over whole tables."""
from __future__ import annotations

from . import licenses, secrets

_WORD = r"'[^\x20\x09-\x0D]+'"

EXACT_DEDUP = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM t"""

# Targets by the sorted order of saturation; the sample is the prefix of the Pareto order that comes nearest to what is left.
MIX = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {_WORD})) AS BIGINT) AS size,
                  CAST('0x' || substr(md5(concat_ws('|', '20', CAST(doc_id AS VARCHAR), text)), 1, 15) AS BIGINT) AS u FROM documents),
s AS (SELECT source, words, [1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
      FROM (SELECT source, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY source)),
r AS (SELECT *, sum(words) OVER () AS total, 3 * sum(words) OVER (ORDER BY words / w, source ROWS UNBOUNDED PRECEDING) - 3 * words AS capped,
             sum(w) OVER (ORDER BY words / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight FROM s),
l AS (SELECT coalesce((SELECT CAST(total - capped AS DOUBLE) / CAST(weight AS DOUBLE) AS level FROM r
                       WHERE 3 * words >= CAST(total - capped AS DOUBLE) / CAST(weight AS DOUBLE) * w ORDER BY words / w, source LIMIT 1), 0) AS level),
t AS (SELECT source, words, least(CAST(3 * words AS DOUBLE), level * w) AS target FROM s, l),
g AS (SELECT *, CAST(CASE WHEN words > 0 THEN floor(target / words + 1e-12) ELSE 0 END AS BIGINT) AS whole FROM t),
h AS (SELECT *, greatest(0, target - whole * words) AS rest FROM g),
e AS (SELECT *, CAST(floor(sqrt(CAST(size AS DOUBLE))) AS BIGINT) AS k FROM d),
j AS (SELECT e.source, k, CAST(sum(size) AS BIGINT) AS sz, min(h.rest) AS rest FROM e JOIN h ON e.source IS NOT DISTINCT FROM h.source WHERE size > 0 AND h.rest > 0 GROUP BY e.source, k),
v AS (SELECT source, k, rest - CAST(sum(sz) OVER (PARTITION BY source ORDER BY k DESC) - sz AS DOUBLE) AS todo, CAST(sum(k * sz) OVER (PARTITION BY source ORDER BY k) AS DOUBLE) AS upto FROM j),
i AS (SELECT source, max(k) AS most, arg_max(todo, k) AS todo, arg_max(todo / upto, k) AS c FROM v WHERE todo / upto * k <= 1 AND todo >= 0 GROUP BY source),
q AS (SELECT e.source, e.size, e.u, i.todo, CASE WHEN c * k >= 1 THEN 0 ELSE n * (1 - c * k) / (n * (1 - c * k) + c * k * (1 - n)) END AS v
      FROM (SELECT *, (CAST(u AS DOUBLE) + 0.5) / 1152921504606846976.0::DOUBLE AS n FROM e) e JOIN i ON e.source IS NOT DISTINCT FROM i.source WHERE size > 0 AND k <= most AND c > 0 AND i.todo > 0),
p AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY v, u) AS DOUBLE) AS cum FROM q),
c AS (SELECT source, arg_min((v, u), (abs(cum - todo), v, u)) AS cut, min(abs(cum - todo)) <= min(todo) AS near FROM p GROUP BY source),
z AS (SELECT e.*, i.most, CASE WHEN i.c * k >= 1 THEN 0 ELSE n * (1 - i.c * k) / (n * (1 - i.c * k) + i.c * k * (1 - n)) END AS v, i.c AS factor
      FROM (SELECT *, (CAST(u AS DOUBLE) + 0.5) / 1152921504606846976.0::DOUBLE AS n FROM e) e LEFT JOIN i ON e.source IS NOT DISTINCT FROM i.source),
m AS (SELECT z.*, h.words, h.target, least(h.whole + CASE WHEN size > 0 AND factor IS NOT NULL AND (k > most OR (c.near AND (z.v, z.u) <= c.cut)) THEN 1 ELSE 0 END, 3) AS copies
      FROM z JOIN h ON z.source IS NOT DISTINCT FROM h.source LEFT JOIN c ON z.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, words AS source_size, target, CAST(size * copies AS BIGINT) AS taken, source, CAST(copies AS BIGINT) AS copies FROM m"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ngram_join(width: int, percent: int) -> str:
    """All pairs by shared n-grams, then components by reachability."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORD}) AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {width} THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - {width - 2}), lambda i: array_to_string(ws[i:i + {width - 1}], ' ')) END) AS g FROM w),
t AS (SELECT doc_id, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * c >= {percent} * (len(x.g) + len(y.g) - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS reach FROM s UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reach)
SELECT s.doc_id, CAST(len(any_value(s.g)) AS BIGINT) AS n_shingles, min(r.reach) AS component_id FROM s JOIN r ON r.doc_id = s.doc_id GROUP BY s.doc_id"""


def _rule_spans(rule: secrets.Rule, order: int) -> str:
    """Spans of a rule: pieces between the matches and the matches give the places."""
    pattern = rule.pattern.replace("'", "''")
    keep = f"length(regexp_extract(hits[i], '{pattern}', {rule.group})) >= {rule.least}" if rule.least else "true"
    return f"""SELECT doc_id, {order} AS o, '{rule.kind}' AS kind, a, a + length(hit) AS z FROM (
      SELECT doc_id, hits[i] AS hit, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a
      FROM (SELECT doc_id, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (
        SELECT doc_id, regexp_extract_all(body, '{pattern}') AS hits, string_split_regex(body, '{pattern}') AS gaps FROM t)) WHERE {keep})"""


def secret_scan() -> str:
    base = ", ".join(f"'{r.kind}'" for r in secrets.RULES if r.base)
    parts = " UNION ALL ".join(_rule_spans(r, i) for i, r in enumerate(secrets.RULES))
    name = "kind || ':' || CAST(a AS VARCHAR) || ':' || CAST(z AS VARCHAR)"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents), f AS ({parts}),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg({name}, ',' ORDER BY a, o) FILTER (kind IN ({base})) AS b, string_agg({name}, ',' ORDER BY a, o) AS spans FROM f GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN g ON g.doc_id = t.doc_id"""


_VALID = {
    "email": "true",
    "ip": "list_bool_and(list_transform(string_split(hit, '.'), lambda x: coalesce(TRY_CAST(x AS HUGEINT) <= 255, false)))",
    "card": """length(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i:
        CASE WHEN (length(digits) - i) % 2 = 0 THEN CAST(substr(digits, i, 1) AS INTEGER)
             WHEN CAST(substr(digits, i, 1) AS INTEGER) > 4 THEN 2 * CAST(substr(digits, i, 1) AS INTEGER) - 9
             ELSE 2 * CAST(substr(digits, i, 1) AS INTEGER) END)) % 10 = 0""",
    "phone": "length(digits) BETWEEN 9 AND 15",
}
# The plain patterns; the operator's own start where a run starts.
_PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
          "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _places(source: str, body: str, pattern: str, keys: str) -> str:
    """(keys, hit, a) of every match of a pattern in ``body``."""
    return f"""SELECT {keys}, hits[i] AS hit, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x)))
        + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a
      FROM (SELECT {keys}, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (
        SELECT {keys}, regexp_extract_all({body}, '{pattern}') AS hits, string_split_regex({body}, '{pattern}') AS gaps FROM {source}))"""


def _disclosure(support: int, generalise: float) -> str:
    """Tables t, base, lines and more: the words that disclose a kind (no value) or a value of their document's base spans."""
    parts = " UNION ALL ".join(
        f"""SELECT doc_id, {i} AS o, '{k}' AS kind, a, a + length(hit) AS z, hit FROM (
            SELECT *, regexp_replace(hit, '[^0-9]', '', 'g') AS digits FROM ({_places('t', 'body', p, 'doc_id')})) WHERE {_VALID[k]}"""
        for i, (k, p) in enumerate(_PLAIN.items()))
    return f"""
t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents), base AS ({parts}),
lines AS (SELECT doc_id, hit AS line, a AS at_ FROM ({_places('t', 'body', '[^' + chr(92) + 'n]+', 'doc_id')})),
held AS (SELECT DISTINCT l.doc_id, l.line, l.at_, b.kind, unnest([NULL, b.hit]) AS v
         FROM lines l JOIN base b ON b.doc_id = l.doc_id AND b.a >= l.at_ AND b.z <= l.at_ + length(l.line)),
own AS (SELECT t.* FROM t WHERE doc_id IN (SELECT doc_id FROM base)),
word AS (SELECT doc_id, a, a + length(hit) AS z, lower(hit) AS term FROM ({_places('own', 'body', _WORD[1:-1], 'doc_id')})),
free AS (SELECT * FROM word w WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = w.doc_id AND b.a < w.z AND b.z > w.a)),
pair AS (SELECT term, kind, v, count(DISTINCT (h.doc_id, h.at_)) AS n_both
         FROM free f JOIN held h ON h.doc_id = f.doc_id AND f.a >= h.at_ AND f.z <= h.at_ + length(h.line) GROUP BY term, kind, v HAVING n_both >= {support}),
every AS (SELECT unnest(list_distinct(regexp_extract_all(lower(line), {_WORD}))) AS term FROM lines),
n_term AS (SELECT term, count(*) AS n_term FROM every GROUP BY term),
n_target AS (SELECT kind, v, count(DISTINCT (doc_id, at_)) AS n_target FROM held GROUP BY kind, v),
total AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM lines),
term AS (SELECT term, p.kind, p.v, CASE WHEN n > n_target THEN log2(n * n_both / (n_term * n_target)) / log2(n / n_target) ELSE 0 END AS disclosure
         FROM pair p JOIN n_term USING (term) JOIN n_target g ON g.kind = p.kind AND g.v IS NOT DISTINCT FROM p.v, total),
more AS (SELECT f.doc_id, a, z, x.kind, f.term, max(disclosure) AS disclosure
         FROM free f JOIN term x USING (term) JOIN (SELECT DISTINCT doc_id, kind, unnest([NULL, hit]) AS v FROM base) h
           ON h.doc_id = f.doc_id AND h.kind = x.kind AND h.v IS NOT DISTINCT FROM x.v
         WHERE disclosure >= {generalise} GROUP BY f.doc_id, a, z, x.kind, f.term)"""


def private_data(support: int, remove: float, generalise: float) -> str:
    name = "kind || ':' || CAST(a AS VARCHAR) || ':' || CAST(z AS VARCHAR)"
    counts = [f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in _PLAIN]
    return f"""
WITH {_disclosure(support, generalise)},
said AS (SELECT doc_id, a, z, CASE WHEN disclosure >= {remove} THEN 'remove_' ELSE 'general_' END || kind AS kind FROM more),
g AS (SELECT doc_id, {', '.join(counts)}, string_agg({name}, ',' ORDER BY o, a) AS b FROM base GROUP BY doc_id),
m AS (SELECT doc_id, string_agg({name}, ',' ORDER BY a, z, kind) AS m FROM said GROUP BY doc_id)
SELECT t.doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in _PLAIN)}, sha256(coalesce(b, '')) AS base_sha256,
       concat_ws(',', b, m) AS spans FROM t LEFT JOIN g ON g.doc_id = t.doc_id LEFT JOIN m ON m.doc_id = t.doc_id"""


def disclosing_words(support: int, remove: float, generalise: float) -> str:
    return f"""
WITH {_disclosure(support, generalise)}
SELECT doc_id, CAST(a AS INTEGER) AS start, CAST(z AS INTEGER) AS "end", CASE WHEN disclosure >= {remove} THEN 'remove_' ELSE 'general_' END || kind AS kind, term,
       disclosure FROM more"""


_LOWERED = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
_TOKEN = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

_CRC_TABLE = """(SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) ORDER BY b) AS tab
             FROM (SELECT unnest(range(256)) AS b))"""


def _crc32(word: str) -> str:
    """CRC-32 of a text byte by byte, by the table ``tab``."""
    byte = f"CAST('0x' || substr(hex({word}), 2 * i + 1, 2) AS BIGINT)"
    return (f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(strlen({word})), lambda i: {byte})), "
            "lambda c, y: xor(c // 256, tab[xor(c, y) % 256 + 1])), 4294967295)")


RESAMPLE = f"""
WITH tab AS {_CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWERED}, {_TOKEN}) AS ws FROM documents),
dw AS (SELECT r, unnest(ws) AS w FROM d),
bw AS (SELECT unnest(regexp_extract_all({_LOWERED}, {_TOKEN})) AS w FROM benchmark),
k AS (SELECT w, {_crc32('w')} % 10000 AS bucket
      FROM (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)), tab),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN k USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN k USING (w) GROUP BY bucket),
g AS (SELECT b.bucket, CAST(floor(1000 * ln(CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * CAST((SELECT count(*) FROM dw) + 10000 AS DOUBLE)
             / (CAST(coalesce(s.n, 0) + 1 AS DOUBLE) * CAST((SELECT count(*) FROM bw) + 10000 AS DOUBLE)))) AS BIGINT) AS gain
      FROM (SELECT unnest(range(10000)) AS bucket) b LEFT JOIN s ON s.bucket = b.bucket LEFT JOIN t ON t.bucket = b.bucket),
f AS (SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM dw JOIN k USING (w) JOIN g USING (bucket) GROUP BY r),
e AS (SELECT d.r, d.doc_id, coalesce(f.n, 0) AS n_features, CAST(coalesce(floor(CAST(f.total AS DOUBLE) / f.n), 0) AS BIGINT) AS weight,
             CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
      FROM d LEFT JOIN f ON f.r = d.r),
x AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM e),
p AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) OVER () AS n FROM x WHERE n_features >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM x LEFT JOIN p ON p.r = x.r"""

# Nodes by the digest of all turns so far; a node's sums go to the nodes on its smallest member's path.
PREFIX_TRIE = f"""
WITH tab AS {_CRC_TABLE},
o AS (SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t, length(coalesce(text, '')) AS size, turn FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, t) AS pos FROM o),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc32('CAST(conv_id AS VARCHAR)')} % 6 AS h FROM (SELECT DISTINCT conv_id FROM p), tab),
r AS (SELECT c.conv_id, p.t, p.size, p.pos FROM c JOIN p ON p.conv_id = c.base AND p.pos <= c.h
      UNION ALL SELECT c.conv_id, p.t, p.size, p.pos FROM c JOIN p ON p.conv_id = c.conv_id AND p.pos > c.h),
q AS (SELECT conv_id, size, row_number() OVER s AS depth, md5(string_agg(t, ',') OVER s) AS k FROM r WINDOW s AS (PARTITION BY conv_id ORDER BY pos)),
m AS (SELECT conv_id, 0 AS size, 0 AS depth, '' AS k FROM c UNION ALL SELECT * FROM q),
e AS (SELECT conv_id, max(depth) AS last FROM m GROUP BY conv_id),
n AS (SELECT k, min(m.conv_id) AS conv_id, min(depth) AS depth, min(size) AS size, count(*) AS n,
             sha256(coalesce(string_agg(CAST(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id) FILTER (depth = last), '')) AS ends
      FROM m JOIN e USING (conv_id) GROUP BY k),
u AS (SELECT n.*, up.k AS pk, pn.conv_id AS parent FROM n LEFT JOIN m up ON up.conv_id = n.conv_id AND up.depth = n.depth - 1 LEFT JOIN n pn ON pn.k = up.k),
kids AS (SELECT pk AS k, count(*) AS kids FROM u WHERE pk IS NOT NULL GROUP BY pk),
s AS (SELECT up.k, sum(CASE WHEN kids IS NULL THEN 1 ELSE 0 END) AS leaves, sum((u.n - 1) * u.size) AS saved
      FROM u LEFT JOIN kids USING (k) JOIN m up ON up.conv_id = u.conv_id AND up.depth <= u.depth GROUP BY up.k)
SELECT u.conv_id, CAST(u.depth AS BIGINT) AS depth, u.parent AS parent_conv_id, u.n AS n_convs, coalesce(kids, 0) AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, u.ends AS ends_sha256
FROM u LEFT JOIN kids ON kids.k = u.k JOIN s ON s.k = u.k"""


def license_scan() -> str:
    """Places where a template's rare words agree on its beginning and its key phrases stand, by joins over numbered words."""
    rows = [f"({k}, '{t.label}', {k < len(licenses.PHRASES)}, {t.words}, {[f' {p} ' for p in t.key_phrases]}, {t.slack}, {licenses.NOTICE_WORDS if t.keys else licenses.PHRASE_WORDS})"
            for k, t in enumerate([*licenses.PHRASES, *licenses.NOTICES])]
    return f"""
WITH t(t, label, base, words, keys, slack, most) AS (VALUES {', '.join(rows)}),
tw AS (SELECT t, w, q FROM (SELECT t, unnest(words) AS w, unnest(range(len(words))) AS q FROM t)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWERED}, {_TOKEN}) AS ws FROM documents),
dw AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d),
f AS (SELECT v.w, count(DISTINCT dw.r) AS n FROM (SELECT DISTINCT w FROM tw) v LEFT JOIN dw ON dw.w = v.w GROUP BY v.w),
x AS (SELECT t, w FROM (SELECT u.t, u.w, most, row_number() OVER (PARTITION BY u.t ORDER BY n, u.w) AS place
                        FROM (SELECT DISTINCT t, w FROM tw) u JOIN f USING (w) JOIN t USING (t)) WHERE place <= most),
post AS (SELECT tw.* FROM tw JOIN x USING (t, w)),
need AS (SELECT t, least({licenses.AGREE}, count(*)) AS need FROM post GROUP BY t),
c AS (SELECT r, t, i - q AS start, count(*) AS n FROM dw JOIN post USING (w) GROUP BY r, t, i - q),
p AS (SELECT c.r, c.t, c.start, label, base,
             len(list_filter(range(len(words)), lambda j: start + j >= 0 AND coalesce(ws[start + j + 1] = words[j + 1], false)))::DOUBLE / len(words) AS share
      FROM c JOIN need USING (t) JOIN t USING (t) JOIN d USING (r)
      WHERE c.n >= need AND len(list_filter(keys, lambda k: NOT contains(' ' || array_to_string(ws[greatest(start - slack, 0) + 1 : start + len(words) + slack], ' ') || ' ', k))) = 0),
g AS (SELECT r, count(*) FILTER (base) AS n, min(start) FILTER (base) AS lo, max(start) FILTER (base) AS hi,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS bl, string_agg(DISTINCT label, ',' ORDER BY label) AS al, max(share) AS score FROM p GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word,
       coalesce(bl, '') AS base_labels, coalesce(al, '') AS labels, coalesce(score, 0) AS score
FROM d LEFT JOIN g ON g.r = d.r"""
