"""DuckDB SQL for the corpus queries that SQL can express, written from their contracts and not from the Spark code."""

from __future__ import annotations

from . import quality, sharding

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _round(k: int, key: int, seed: int) -> str:
    """One Feistel round: (l, r) -> (r, (l + F(r)) mod size); rounds alternate between the sizes a and b."""
    size = "a" if k % 2 == 0 else "b"
    key = (key + seed) % sharding.PRIME
    p = sharding.PRIME
    t = f"((r % {p} + {key}) % {p})"
    u = f"(({t} * {t}) % {p} * 48271 + {key}) % {p}"
    return f"SELECT id, a, b, n, r AS l, (l + (({u}) * ({u})) % {p}) % {size} AS r FROM f{k}"


def sharding_sql(n_shards: int, seed: int = 0) -> str:
    rounds = ", ".join(f"f{k + 1} AS ({_round(k, key, seed)})" for k, key in enumerate(sharding.KEYS))
    # CRC32 of blocks of 256 bytes, the first one shorter; then the blocks' states are joined: a state is carried over
    # 256 more bytes by a linear map, which has a table for each byte of the state.
    step = "xor(c >> 8, t[(c & 255) + 1])"
    carried = "xor(xor(m[(s & 255) + 1], m[((s >> 8) & 255) + 257]), xor(m[((s >> 16) & 255) + 513], m[((s >> 24) & 255) + 769]))"
    return f"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t
), map AS (
  SELECT list(v ORDER BY p, b) AS m FROM (SELECT p, b, list_reduce(range(256), lambda c, k: {step}, b << (8 * p)) AS v FROM crc_table, range(4) x(p), range(256) y(b))
), docs AS (
  SELECT row_number() OVER () AS rid, doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents
), blocks AS (
  SELECT rid, k, CASE WHEN k = 0 THEN h[1 : 2 * first] ELSE h[2 * first + 512 * (k - 1) + 1 : 2 * first + 512 * k] END AS h
  FROM (SELECT rid, h, (n - 1) % 256 + 1 AS first, unnest(range((n + 255) // 256)) AS k FROM docs WHERE n > 0)
), states AS (
  SELECT rid, k, list_reduce(list_transform(range(0, len(h), 2), lambda i: CAST('0x' || h[i + 1 : i + 2] AS BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), CASE WHEN k = 0 THEN CAST(4294967295 AS BIGINT) ELSE CAST(0 AS BIGINT) END) AS state
  FROM blocks, crc_table
), joined AS (
  SELECT rid, xor(4294967295, list_reduce(l, lambda s, c: xor(c, {carried}))) AS crc FROM (SELECT rid, list(state ORDER BY k) AS l FROM states GROUP BY rid), map
), crcs AS (
  SELECT doc_id, n + 8 AS size, coalesce(crc, 0) AS text_crc32 FROM docs LEFT JOIN joined USING (rid)
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS id FROM crcs
), sizes AS (
  SELECT n, a, CAST(ceil(n / a) AS BIGINT) AS b FROM (SELECT count(*) AS n, greatest(1, CAST(floor(sqrt(count(*))) AS BIGINT)) AS a FROM documents)
), domain AS (
  SELECT x AS id, a, b, n FROM sizes, range((SELECT a * b FROM sizes)) t(x)
), f0 AS (SELECT id, a, b, n, id // b AS l, id % b AS r FROM domain), {rounds},
step AS (SELECT id, l * b + r AS y, n FROM f{len(sharding.KEYS)}),
walk(id, y) AS (
  SELECT id, y FROM step WHERE id < n
  UNION ALL
  SELECT w.id, s.y FROM walk w JOIN step s ON s.id = w.y WHERE w.y >= s.n
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(y % {n_shards} AS INTEGER) AS shard, y // {n_shards} AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM numbered JOIN walk USING (id) WHERE y < (SELECT n FROM sizes)
"""


def near_duplicates_sql(percent: int) -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({lower}, '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * k >= {percent} * (x.n + y.n - k)
), sides AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT DISTINCT a, a FROM sides UNION SELECT r.a, s.b FROM reach r JOIN sides s ON r.b = s.a),
lows AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN lows USING (doc_id)
"""


def quality_sql(least: int = 50, reach: int = 4) -> str:
    def share(part: str, whole: str) -> str:
        return f"CASE WHEN {whole} > 0 THEN least({part}, {whole}) * 1000 // {whole} ELSE 0 END"

    shares = {
        "__symbols": share("n_symbols", "word_chars"),
        "__upper": share("n_upper", "word_chars"),
        "__dup_lines": share("n_dup_lines", "n_lines"),
        "__repeats": share("n_repeat_words", "n_words"),
    }
    floors = " ".join(f"WHEN '{s}' THEN {f}" for s, f in quality.FLOORS.items())
    tall = " UNION ALL ".join(f"SELECT doc_id, lang, source, '{s}' AS share, {e} AS v FROM counts" for s, e in shares.items())

    def fences(keys: str) -> str:
        by = f"{keys}, share" if keys else "share"
        # The least value with at least a quarter (three quarters) of the group at or below it.
        return f"""SELECT {by}, any_value(m) AS m, min(v) FILTER (4 * upto >= 3 * m) + {reach} * greatest(min(v) FILTER (4 * upto >= 3 * m) - min(v) FILTER (4 * upto >= m), CASE share {floors} END) AS fence
  FROM (SELECT *, count(*) OVER (PARTITION BY {by}) AS m, count(*) OVER (PARTITION BY {by} ORDER BY v RANGE UNBOUNDED PRECEDING) AS upto FROM tall) GROUP BY {by}"""

    symbols = quality.SYMBOLS.replace("'", "''")
    return rf"""
WITH docs AS (
  SELECT doc_id, lang, source, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM docs WHERE len(w) >= 8)
), twice AS (
  SELECT DISTINCT doc_id, i + unnest(range(8)) AS j FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS k FROM windows) WHERE k > 1
), repeats AS (SELECT doc_id, count(*) AS k FROM twice GROUP BY doc_id),
counts AS (
  SELECT doc_id, lang, source, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars,
    len(array_to_string(w, '')) - len(translate(array_to_string(w, ''), '{symbols}', '')) AS n_symbols,
    len(array_to_string(w, '')) - len(translate(array_to_string(w, ''), '{quality.UPPER}', '')) AS n_upper,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(k, 0) AS n_repeat_words
  FROM docs LEFT JOIN repeats USING (doc_id)
), tall AS ({tall}),
fine AS ({fences("lang, source")}), by_lang AS ({fences("lang")}), whole AS ({fences("")}),
beyond AS (
  SELECT DISTINCT t.doc_id FROM tall t JOIN fine f ON t.share = f.share AND t.lang IS NOT DISTINCT FROM f.lang AND t.source IS NOT DISTINCT FROM f.source
    JOIN by_lang g ON t.share = g.share AND t.lang IS NOT DISTINCT FROM g.lang JOIN whole h ON t.share = h.share
  WHERE t.v > CASE WHEN f.m >= {least} THEN f.fence WHEN g.m >= {least} THEN g.fence ELSE h.fence END
), judged AS (
  SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM beyond) AS kept FROM judged
"""


def url_sql(rules: list[tuple[str, str, str]]) -> str:
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    after = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)"
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def vertex(url: str) -> str:
        host = low.format(f"regexp_extract({url}, '{after}', 1)")
        return f"CASE WHEN {host} <> '' THEN {host} || regexp_extract({url}, '{after}', 2) || regexp_extract({url}, '{after}', 3) END"

    def target(link: str) -> str:
        return f"CASE WHEN regexp_matches({link}, '(?s)^[A-Za-z][A-Za-z0-9+.-]*://') THEN {vertex(link)} WHEN starts_with({link}, '//') THEN {vertex(f"('x:' || {link})")} WHEN starts_with({link}, '/') AND host <> '' THEN host || {link} END"

    return rf"""
WITH RECURSIVE rules(verdict, host, path) AS (VALUES {values}),
urls AS (
  SELECT page_id, html, {low.format(f"regexp_extract(coalesce(url, ''), '{after}', 1)")} AS host, regexp_extract(coalesce(url, ''), '{after}', 2) AS path, {vertex("url")} AS vertex FROM pages
), links AS (
  SELECT vertex AS u, host, regexp_replace(unnest([
    regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
    regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1)]), '(?s)#.*', '') AS link FROM urls
), edges AS (SELECT u, {target("link")} AS v FROM links WHERE link <> ''),
sides AS (SELECT u, v FROM edges WHERE u <> v UNION SELECT v, u FROM edges WHERE u <> v),
reach(u, v) AS (SELECT DISTINCT u, u FROM sides UNION SELECT r.u, s.v FROM reach r JOIN sides s ON r.v = s.u),
told AS (
  SELECT x.*, r.verdict, r.host || r.path AS rule, row_number() OVER (PARTITION BY x.kind, x.key, x.n ORDER BY len(r.host) + len(r.path) DESC, len(r.host) DESC) AS rank
  FROM (
    SELECT 'page' AS kind, CAST(page_id AS VARCHAR) AS key, row_number() OVER () AS n, page_id, vertex, host, path FROM urls
    UNION ALL SELECT 'url', u, 0, NULL, u, regexp_extract(u, '^[^/?]*'), regexp_extract(u, '^[^/?]*([^?]*)', 1) FROM (SELECT DISTINCT u FROM sides)
  ) x LEFT JOIN rules r ON (x.host = r.host OR ends_with(x.host, '.' || r.host)) AND starts_with(x.path, r.path)
), best AS (SELECT * FROM told WHERE rank = 1),
carried AS (
  SELECT u, min(v) AS component, CASE WHEN bool_or(coalesce(verdict = 'allow', false)) THEN 'allow' WHEN bool_or(coalesce(verdict = 'block', false)) THEN 'block' END AS verdict
  FROM reach JOIN (SELECT vertex, verdict FROM best WHERE kind = 'url') b ON v = b.vertex GROUP BY u
)
SELECT page_id, host, path, rule, coalesce(b.verdict, c.verdict, 'allow') AS verdict, component
FROM best b LEFT JOIN carried c ON b.vertex = c.u WHERE kind = 'page'
"""
