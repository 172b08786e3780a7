"""SQL (of DuckDB) that gives the rows of the queries which SQL can express."""

from __future__ import annotations

from . import quality_rules as rules
from . import secrets
from .warc import MIN_REVISIT_BYTES


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def secret_scan(limits: secrets.Limits = secrets.Limits()) -> str:
    """The patterns and limits stand here as the contract gives them, apart from the operator's own; the keylike kind's conditions stand beside its pattern."""
    assign = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    patterns = (assign, "AKIA[A-Z0-9]+", "[0-9a-f]+", "[A-Za-z0-9+/_-]{32,}={0,2}")
    found = " UNION ALL ".join(
        f"SELECT row, owner, repository, {k} AS kind, unnest(v) AS value, unnest(g[1:len(v)]) AS gap, generate_subscripts(v, 1) AS n FROM (SELECT row, owner, repository, regexp_extract_all(text, {quoted(p)}) AS v, string_split_regex(text, {quoted(p)}) AS g FROM t) WHERE len(v) > 0"
        for k, p in enumerate(patterns)
    )
    names = "['assign', 'access', 'hex', 'keylike']"
    listed = f"coalesce(string_agg({names}[kind + 1] || ':' || \"start\" || ':' || \"end\", ',' ORDER BY \"start\", kind, \"end\") FILTER (WHERE {{0}}), '')"
    return f"""WITH t AS (SELECT doc_id, row_number() OVER () AS row, coalesce(source, '') AS owner, coalesce(source, '') || '/' || coalesce(lang, '') AS repository, coalesce(text, '') AS text FROM documents),
m AS ({found}),
p AS (SELECT *, CAST(sum(length(gap) + length(value)) OVER (PARTITION BY row, kind ORDER BY n) AS BIGINT) AS "end", CASE WHEN kind = 0 THEN regexp_extract(value, {quoted(assign)}, 2) ELSE value END AS secret FROM m),
q AS (SELECT *, "end" - length(value) AS "start" FROM p WHERE (kind <> 0 OR length(secret) >= 6) AND (kind <> 1 OR length(value) >= 20) AND (kind <> 2 OR length(value) >= 24)
  AND (kind <> 3 OR (regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]')))),
s AS (SELECT secret, count(DISTINCT owner) AS owners, count(DISTINCT (owner, repository)) AS repositories FROM q GROUP BY secret),
j AS (SELECT q.*, owners, repositories, CASE WHEN owners >= {limits.example_owners} OR repositories >= {limits.example_repositories} THEN 'example'
  WHEN length(q.secret) >= {limits.min_length} AND len(list_distinct(string_split(q.secret, ''))) >= {limits.min_distinct} AND regexp_matches(q.secret, '[0-9]') AND regexp_matches(q.secret, '[A-Za-z]')
    AND NOT regexp_matches(q.secret, '(?i)example|placeholder|changeme|dummy|sample|your[_-]?(?:key|token|secret|password)|x{{6,}}|1234567') THEN 'live' ELSE 'weak' END AS verdict FROM q JOIN s ON q.secret = s.secret),
k AS (SELECT *, kind < 3 OR (verdict = 'live' AND NOT EXISTS (SELECT 1 FROM j AS b WHERE b.row = j.row AND b.kind < 3 AND b."start" < j."end" AND j."start" < b."end")) AS kept FROM j),
a AS (SELECT row, count(*) FILTER (WHERE kind = 0) AS n0, count(*) FILTER (WHERE kind = 1) AS n1, count(*) FILTER (WHERE kind = 2) AS n2, {listed.format("kind < 3")} AS base, {listed.format("kept")} AS spans,
  count(*) FILTER (WHERE kept AND verdict = 'live') AS live, count(*) FILTER (WHERE kept AND verdict = 'example') AS examples, max(owners) AS owners, max(repositories) AS repositories FROM k GROUP BY row)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(live, 0) AS n_live, coalesce(examples, 0) AS n_example,
  coalesce(owners, 0) AS most_owners, coalesce(repositories, 0) AS most_repositories FROM t LEFT JOIN a ON t.row = a.row"""


def quality(bounds: rules.Bounds = rules.Bounds()) -> str:
    left, lengths = "text", ["length(text)"]
    for _, pattern in rules.CLASSES:
        left = f"regexp_replace({left}, {quoted(pattern)}, '', 'g')"
        lengths.append(f"length({left})")
    classes = ", ".join([f"{a} - {b}" for a, b in zip(lengths[:-1], lengths[1:], strict=True)] + [lengths[-1]])
    common = " ".join(
        f"WHEN lang = '{lang}' THEN [{', '.join(f"(strlen(spaced) - strlen(replace(spaced, {quoted(f' {w} ')}, ''))) // {len(w.encode()) + 2}" for w in words)}]" for lang, words in rules.COMMON_WORDS.items()
    )
    known = ", ".join(quoted(x) for x in rules.COMMON_WORDS)
    width = len(next(iter(rules.COMMON_WORDS.values()))) + 1

    def means(name: str, count: int) -> str:
        return "[" + ", ".join(f"avg({name}[{i + 1}])" for i in range(count)) + "]"

    def distance(p: str, q: str) -> str:
        part = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / ({0} + {1})) ELSE 0 END"
        return f"sqrt(greatest(list_sum(list_transform(range(1, len({p}) + 1), lambda i: {part.format(f'{p}[i]', f'{q}[i]')} + {part.format(f'{q}[i]', f'{p}[i]')})) / 2, 0))"

    return f"""WITH t AS (SELECT doc_id, row_number() OVER () AS row, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, {quoted(rules.SPACE)}), lambda x: x <> '') AS words FROM t),
s AS (SELECT *, ' ' || lower(array_to_string(words, '  ')) || ' ' AS spaced, len(words) AS n_words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM w),
win AS (SELECT row, i, array_to_string(words[i : i + {rules.WINDOW - 1}], chr(1)) AS h FROM (SELECT row, words, unnest(range(1, n_words - {rules.WINDOW - 2})) AS i FROM s WHERE n_words >= {rules.WINDOW})),
twin AS (SELECT row, i, lead(i) OVER (PARTITION BY row ORDER BY i) AS after FROM (SELECT row, i, count(*) OVER (PARTITION BY row, h) AS n FROM win) WHERE n > 1),
rep AS (SELECT row, CAST(sum(least({rules.WINDOW}, coalesce(after - i, {rules.WINDOW}))) AS BIGINT) AS n_repeat_words FROM twin GROUP BY row),
f AS (SELECT s.*, coalesce(n_repeat_words, 0) AS n_repeat_words, CASE WHEN lang IN ({known}) THEN lang ELSE 'other' END AS family, [{classes}] AS cc, CASE {common} END AS wc FROM s LEFT JOIN rep ON s.row = rep.row),
g AS (SELECT *, CASE WHEN length(text) >= {bounds.min_chars} AND n_words > 0 THEN list_transform(cc, lambda x: x / length(text)) END AS cs,
  CASE WHEN n_words >= {bounds.min_words} AND wc IS NOT NULL THEN list_transform(list_append(wc, n_words - list_sum(wc)), lambda x: x / n_words) END AS ws FROM f),
r AS (SELECT family, {means("cs", len(rules.CLASSES) + 1)} AS cr, {means("ws", width)} AS wr FROM g GROUP BY family),
d AS (SELECT g.*, CASE WHEN cs IS NOT NULL THEN {distance("cs", "cr")} END AS class_distance, CASE WHEN ws IS NOT NULL THEN {distance("ws", "wr")} END AS word_distance,
  n_words < {bounds.base_words} OR 100 * n_repeat_words > {bounds.base_repeats} * n_words AS base_failed FROM g JOIN r ON g.family = r.family)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, length(array_to_string(words, '')) AS word_chars, length(text) - length(regexp_replace(text, {quoted(rules.SYMBOLS)}, '', 'g')) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(class_distance > {bounds.classes}, false) AND NOT coalesce(word_distance > {bounds.words}, false) AS kept,
  round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance FROM d"""


def warc() -> str:
    return f"""WITH d AS (SELECT page_id, coalesce(url, '') AS url, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest AS digest, max(page_id) AS last FROM d WHERE payload_bytes >= {MIN_REVISIT_BYTES} GROUP BY 1)
SELECT page_id, url, payload_bytes, payload_digest, CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN last <> page_id THEN last END AS refers_to FROM d LEFT JOIN g ON payload_digest = digest"""


def collocations() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({lower}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS words FROM p),
t AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang),
s AS (SELECT lang, words, unnest(range(1, 6)) AS size FROM w WHERE len(words) > 0),
g AS (SELECT lang, size, array_to_string(words[i : i + size - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS i FROM s WHERE len(words) >= size)),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY lang, size, phrase),
c AS (SELECT *, string_split(phrase, ' ') AS words FROM f WHERE size > 1 AND f >= 100),
k AS (SELECT *, unnest(range(1, size)) AS k FROM c),
x AS (SELECT k.lang, k.phrase, k.size, k.words, k.f AS a, k.k, l.f AS l, r.f AS r, t.n, CAST((CAST(1000 AS HUGEINT) * k.f * t.n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score FROM k
  JOIN f AS l ON l.lang = k.lang AND l.phrase = array_to_string(k.words[1 : k.k], ' ') JOIN f AS r ON r.lang = k.lang AND r.phrase = array_to_string(k.words[k.k + 1 : k.size], ' ') JOIN t ON t.lang = k.lang),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
v AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.size > b.size AND 100 * c.f >= 100 * b.a AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' '))),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM v)
SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000"""


def spelling() -> str:
    """Check sums byte by byte from a table by rule; near words by the pieces around one wildcard or one deleted code point."""
    run = "[A-Za-z\\x{00C0}-\\x{00FF}]+"
    lower = "translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    step = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    # UTF-8 bytes of the ids' digits and signs and of letters up to U+00FF
    return f"""WITH RECURSIVE b(i, k, c) AS (SELECT CAST(i AS BIGINT), 0, CAST(i AS BIGINT) FROM range(256) AS r(i) UNION ALL SELECT i, k + 1, {step} FROM b WHERE k < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM b WHERE k = 8),
o AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{run}')) AS r FROM documents),
d AS MATERIALIZED (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS id, {lower} AS r, count(*) AS times FROM o WHERE length(r) >= 7 GROUP BY ALL),
y AS (SELECT *, flatten(list_transform(string_split(id || r, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(192 + unicode(x) // 64 AS BIGINT), CAST(128 + unicode(x) % 64 AS BIGINT)] END)) AS bytes FROM d),
h AS (SELECT r, times, length(r) AS l, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1])), 4294967295) AS crc FROM y, tab),
v AS MATERIALIZED (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (SELECT CASE WHEN crc % 31 = 0 THEN substr(r, 1, CAST(crc % l AS BIGINT)) || substr(r, CAST(crc % l AS BIGINT) + 2) ELSE r END AS word, times FROM h) WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
q AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
w AS MATERIALIZED (SELECT DISTINCT word, n, length(word) AS l, substr(word, 1, i - 1) AS before, substr(word, i + 1) AS after FROM q),
e AS (SELECT a.word, b.word AS near, b.n AS near_n FROM w AS a JOIN w AS b ON a.before = b.before AND a.after = b.after AND a.word <> b.word
  UNION SELECT a.word, v.word, v.n FROM w AS a JOIN v ON a.before || a.after = v.word UNION SELECT v.word, a.word, a.n FROM w AS a JOIN v ON a.before || a.after = v.word),
f AS (SELECT word, count(*) AS n_near, min_by(near, (-near_n, near)) AS best, max(near_n) AS best_n FROM e GROUP BY word),
j AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * v.n THEN best END AS form, CASE WHEN best_n >= 10 * v.n THEN best_n END AS form_n FROM v LEFT JOIN f ON v.word = f.word),
c(word, root, form) AS (SELECT word, word, form FROM j UNION ALL SELECT c.word, c.form, j.form FROM c JOIN j ON j.word = c.form)
SELECT j.word, j.form, c.root, j.n, j.n_near, j.form_n FROM j JOIN c ON c.word = j.word WHERE c.form IS NULL"""


def substrings() -> str:
    return """WITH t AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(doc_id, 9223372036854775807) AS place, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
w AS MATERIALIZED (SELECT row, place, i, sha256(array_to_string(words[i : i + 49], ' ')) AS code FROM (SELECT *, unnest(range(1, len(words) - 48)) AS i FROM t WHERE len(words) >= 50)),
f AS (SELECT code, min(place) AS first FROM w GROUP BY code),
g AS (SELECT DISTINCT row, unnest(range(i, i + 50)) AS i FROM w JOIN f USING (code) WHERE first < place),
r AS (SELECT row, list(i ORDER BY i) AS gone FROM g GROUP BY row),
x AS (SELECT t.row, t.words[k] AS word, k FROM (SELECT row, words, unnest(range(1, len(words) + 1)) AS k FROM t WHERE row IN (SELECT row FROM r)) AS t),
k AS (SELECT x.row, string_agg(word, ' ' ORDER BY x.k) AS kept FROM x ANTI JOIN g ON x.row = g.row AND x.k = g.i GROUP BY x.row)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(CASE WHEN gone IS NULL THEN array_to_string(words, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM t LEFT JOIN r ON t.row = r.row LEFT JOIN k ON t.row = k.row"""
