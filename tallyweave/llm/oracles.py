"""DuckDB SQL for the queries that SQL can express."""

ORACLES: dict[str, str] = {}

# as-of join of captures with the validity intervals of the fixed list and the derived feed
ORACLES["op4_urlfilter"] = r"""
WITH auth AS (SELECT page_id, url, CASE WHEN regexp_matches(lower(trim(url)), '^[a-z][a-z0-9+.-]*://') THEN split_part(split_part(split_part(split_part(substr(lower(trim(url)), instr(lower(trim(url)), '://') + 3), '/', 1), '?', 1), '#', 1), '\', 1) END AS a FROM pages),
place AS (SELECT page_id, url, list_last(string_split(a, '@')) AS a FROM auth),
cap AS (SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS DATE) AS fetched_at,
    nullif(CASE WHEN starts_with(a, '[') THEN CASE WHEN contains(a, ']') THEN split_part(a, ']', 1) || ']' END ELSE rtrim_one END, '') AS host
    FROM (SELECT *, CASE WHEN ends_with(split_part(a, ':', 1), '.') THEN left(split_part(a, ':', 1), length(split_part(a, ':', 1)) - 1) ELSE split_part(a, ':', 1) END AS rtrim_one FROM place)),
hosts AS (SELECT DISTINCT host AS domain, md5(host) AS m FROM cap WHERE host IS NOT NULL),
picked AS (SELECT domain, CAST(CAST('0x' || substr(m, 5, 4) AS INTEGER) % 300 AS INTEGER) AS d FROM hosts WHERE CAST('0x' || substr(m, 1, 4) AS INTEGER) % 12 = 0),
spans AS (SELECT 'feed' AS list, domain, CAST(DATE '2024-01-01' + d AS DATE) AS since, CAST(DATE '2024-01-01' + (d + 90) AS DATE) AS until FROM picked
    UNION ALL SELECT * FROM (VALUES ('spam', 'spam-farm.example.org', DATE '2024-01-10', NULL), ('spam', 'casino-win.example.net', DATE '2024-02-01', DATE '2024-08-01'),
    ('spam', 'free-bets.example.net', DATE '2024-03-05', NULL), ('pharma', 'cheap-pills.example.net', DATE '2024-01-01', NULL), ('adult', 'adult-x.example.com', DATE '2024-04-15', NULL),
    ('ads', 'ads-track.example.com', DATE '2024-05-20', DATE '2024-06-20'), ('ads', 'ads-track.example.com', DATE '2024-09-20', NULL)) AS t(list, domain, since, until)),
hits AS (SELECT DISTINCT host, fetched_at, list, domain, since FROM cap JOIN spans ON (host = domain OR length(host) <= 253 AND NOT regexp_full_match(host, '[0-9]+([.][0-9]+){3}') AND ends_with(host, '.' || domain)) AND since <= fetched_at AND (until IS NULL OR fetched_at < until)),
best AS (SELECT *, row_number() OVER (PARTITION BY host, fetched_at ORDER BY length(domain) DESC, list, domain, since) AS r FROM hits)
SELECT cap.page_id, cap.url, cap.fetched_at, cap.host, list IS NOT NULL AS blocked, list, domain AS matched_domain, since
FROM cap LEFT JOIN best ON cap.host = best.host AND cap.fetched_at = best.fetched_at AND r = 1"""

# the same windows, by window functions; only lengths are needed of the formatted text
ORACLES["op5_chat"] = r"""
WITH src AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
tok AS (SELECT *, CAST(ceil(length(text) / 4.0) AS BIGINT) + 4 AS tokens FROM src),
pre AS (SELECT *, row_number() OVER o AS pos, sum(tokens) OVER o AS upto FROM tok WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
sys AS (SELECT conv_id, role AS sys_role, text AS sys_text, tokens AS sys_tokens FROM pre WHERE pos = 1 AND role = 'system'),
b AS (SELECT pre.*, sys_role, sys_text, coalesce(sys_tokens, 0) AS st, greatest(0, upto - tokens - coalesce(sys_tokens, 0)) AS beg, upto - coalesce(sys_tokens, 0) AS en,
    greatest(1, 512 - 128 - coalesce(sys_tokens, 0)) AS width FROM pre LEFT JOIN sys ON pre.conv_id = sys.conv_id),
c AS (SELECT *, CAST(beg // width AS BIGINT) AS cell FROM b),
d AS (SELECT *, min(beg) OVER (PARTITION BY conv_id, cell) AS fst FROM c),
e AS (SELECT *, 2 * cell + CASE WHEN en > (cell + 1) * width AND en - fst > width THEN 1 ELSE 0 END AS k FROM d),
f AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY k) - 1 AS win FROM e),
g AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id, win ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) AS to_end, max(win) OVER (PARTITION BY conv_id) AS last FROM f),
shown AS (SELECT conv_id, role, text FROM g
    UNION ALL SELECT conv_id, role, text FROM g WHERE to_end <= 128 AND NOT (pos = 1 AND role = 'system') AND win < last
    UNION ALL SELECT DISTINCT ON (conv_id, win) conv_id, sys_role, sys_text FROM g WHERE win > 0 AND sys_text IS NOT NULL),
chars AS (SELECT conv_id, CAST(sum(8 + 7 + 1 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) AS BIGINT) AS formatted_chars FROM shown GROUP BY conv_id)
SELECT pre.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
    length(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256, any_value(formatted_chars) AS formatted_chars
FROM pre JOIN chars ON pre.conv_id = chars.conv_id GROUP BY pre.conv_id"""


def _found(kind: str, rank: int, pattern: str, group: int = 0, least: int = 0) -> str:
    """Spans of one rule: the pieces between matches and the matches, as running lengths."""
    return (
        f"SELECT doc_id, {rank} AS rank, '{kind}' AS kind, before + piece AS s, before + piece + hit AS e FROM (SELECT doc_id, piece, hit, val, coalesce(sum(piece + hit) OVER (PARTITION BY rid ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM "
        f"(SELECT rid, doc_id, unnest(range(len(m))) AS k, unnest(list_transform(m, lambda x, i: length(p[i]))) AS piece, unnest(list_transform(m, lambda x: length(x))) AS hit, unnest(list_transform(v, lambda x: length(x))) AS val FROM "
        f"(SELECT rid, doc_id, regexp_extract_all(text, $p${pattern}$p$) AS m, regexp_extract_all(text, $p${pattern}$p$, {group}) AS v, string_split_regex(text, $p${pattern}$p$) AS p FROM d))) WHERE val >= {least}"
    )


_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ORACLES["op9_secrets"] = (
    "WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents), f AS ("
    + " UNION ALL ".join((
        _found("assign", 0, _ASSIGN, 2, 8), _found("access", 1, "AKIA[A-Z0-9]{12,}"), _found("hex", 2, "[0-9a-f]{32,}"),
        _found("ghtoken", 3, r"\bgh[pousr]_[A-Za-z0-9]{36,}"), _found("pem", 4, "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    ))
    + "), g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, "
    "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM f GROUP BY doc_id) "
    "SELECT documents.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN g ON documents.doc_id = g.doc_id"
)

# all pairs that share a shingle, and the smallest id reachable over links
ORACLES["op10_minhash"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
sig AS (SELECT md5(array_to_string(list_sort(s), chr(10))) AS g, min(doc_id) AS rep, any_value(s) AS s FROM s WHERE len(s) > 0 GROUP BY 1),
u AS (SELECT rep, len(s) AS n, unnest(s) AS x FROM sig),
p AS (SELECT a.rep AS a, b.rep AS b FROM u a JOIN u b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(node, low) AS (SELECT rep, rep FROM sig UNION SELECT l.b, r.low FROM r JOIN l ON r.node = l.a WHERE r.low < l.b),
c AS (SELECT node, min(low) AS low FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE c.low END AS component_id, s.doc_id = CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE c.low END AS kept
FROM s LEFT JOIN sig ON len(s.s) > 0 AND md5(array_to_string(list_sort(s.s), chr(10))) = g LEFT JOIN c ON sig.rep = c.node"""


def _quality() -> str:
    from .quality import COMMON_WORDS

    lists = ", ".join(f"('{lang}', [{', '.join(repr(w) for w in words)}])" for lang, words in COMMON_WORDS.items())
    classes = ("a-z", "A-Z", "0-9", r"\x20\x09-\x0D", r""".,;:'"!?()\x2D""", r"\x{80}-\x{FFFF}")
    counts = ", ".join(f"length(t) - length(regexp_replace(t, $p$[{c}]+$p$, '', 'g'))" for c in classes)
    return (
        r"WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents), "
        r"w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d), "
        "win AS (SELECT rid, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: w[i:i+7])) AS h FROM w WHERE len(w) > 8), "
        "dup AS (SELECT rid, h FROM win GROUP BY rid, h HAVING count(*) > 1), "
        "cov AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT win.rid, unnest(range(i, i + 8)) AS j FROM win JOIN dup ON win.rid = dup.rid AND win.h = dup.h) GROUP BY rid), "
        f"lists AS (SELECT * FROM (VALUES {lists}) AS v(lang, words)), "
        f"c AS (SELECT rid, lang, t, [{counts}] AS k FROM w), "
        "ch AS (SELECT rid, lang, 'c' AS kind, unnest(list_concat(k, [greatest(0, length(t) - list_sum(k))])) AS x, unnest(range(7)) AS bin FROM c), "
        "hit AS (SELECT rid, w.lang, len(w) AS n, list_filter(list_transform(list_filter(w, lambda x: strlen(x) <= 5), lambda x: list_position(words, lower(x))), lambda x: x > 0) AS p FROM w JOIN lists ON w.lang = lists.lang), "
        "wd AS (SELECT rid, lang, 'w' AS kind, unnest(list_concat(list_transform(range(1, 26), lambda k: len(list_filter(p, lambda x: x = k))), [n - len(p)])) AS x, unnest(range(26)) AS bin FROM hit), "
        "h AS (SELECT * FROM ch UNION ALL SELECT * FROM wd), "
        "ref AS (SELECT lang, kind, bin, sum(x) / sum(sum(x)) OVER (PARTITION BY lang, kind) AS b FROM h WHERE lang IN (SELECT lang FROM lists) GROUP BY lang, kind, bin), "
        "own AS (SELECT rid, lang, kind, bin, x / sum(x) OVER (PARTITION BY rid, kind) AS a FROM h WHERE rid IN (SELECT rid FROM w WHERE len(w) >= 50)), "
        "js AS (SELECT rid, own.kind, sqrt(greatest(0, sum((CASE WHEN a > 0 THEN a * log2(2 * a / (a + b)) ELSE 0 END + CASE WHEN b > 0 THEN b * log2(2 * b / (a + b)) ELSE 0 END) / 2))) AS d FROM own JOIN ref ON own.lang = ref.lang AND own.kind = ref.kind AND own.bin = ref.bin GROUP BY rid, own.kind), "
        "off AS (SELECT rid FROM js WHERE d > CASE kind WHEN 'c' THEN 0.28 ELSE 0.36 END), "
        "o AS (SELECT doc_id, w.rid, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS n_symbols, "
        "len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words FROM w LEFT JOIN cov ON w.rid = cov.rid) "
        "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, "
        "NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND rid NOT IN (SELECT rid FROM off) AS kept FROM o"
    )


ORACLES["op8_quality"] = _quality()
