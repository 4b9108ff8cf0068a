"""DuckDB SQL for XXH64, written from its published definition and not from the Spark code."""

from __future__ import annotations

# The primes of XXH64.
_P1, _P2, _P3 = 11400714785074694791, 14029467366897019727, 1609587929392839161
_P4, _P5 = 9650029242287828579, 2870177450012600261
_MASK = 2**64 - 1


def _big(x: int | str) -> str:
    return f"CAST({x} AS UHUGEINT)"


def _low(x: str) -> str:
    return f"(({x}) & {_big(_MASK)})"


def _times(x: str, prime: int) -> str:
    return _low(f"({x}) * {_big(prime)}")


def _turn(x: str, by: int) -> str:
    return f"list_transform([{x}], lambda q: {_low(f'q << {by}')} | (q >> {64 - by}))[1]"


def _shift(x: str, by: int) -> str:
    return f"list_transform([{x}], lambda q: xor(q, q >> {by}))[1]"


def _value(h: str) -> str:
    """The little-endian number of hex digits."""
    return f"{_big(f'''CAST('0x' || list_reduce(regexp_extract_all({h}, '..'), lambda p, q: q || p) AS UBIGINT)''')}"


def _round(acc: str, word: str) -> str:
    return _times(_turn(_low(f"{acc} + {_times(word, _P2)}"), 31), _P1)


def xxh64(name: str, source: str, seed: int) -> str:
    """CTEs, the last of them called *name*: (id, h), from the table *source*: (id, hex). h is an unsigned number."""
    lanes = [(seed + _P1 + _P2) & _MASK, (seed + _P2) & _MASK, seed & _MASK, (seed - _P1) & _MASK]
    inits = "[" + ", ".join(_big(x) for x in lanes) + "]"
    merged = "acc0"
    for k in range(4):
        merged = _low(f"{_times(f'xor({merged}, {_round(_big(0), f's[{k + 1}]')})', _P1)} + {_big(_P4)}")
    after8 = _low(f"{_times(_turn(f'xor(c, {_round(_big(0), 'w')})', 27), _P1)} + {_big(_P4)}")
    after4 = _low(f"{_times(_turn(f'xor(a, {_times(_value('r[1:8]'), _P1)})', 23), _P2)} + {_big(_P3)}")
    after1 = _times(_turn(f"xor(c, {_times('w', _P5)})", 11), _P1)
    final = _shift(_times(_shift(_times(_shift("a", 33), _P2), 29), _P3), 32)
    return f"""
{name}_w AS (
  SELECT id, hex, len(hex) // 2 AS n, list_transform(regexp_extract_all(hex[1 : 16 * (len(hex) // 16)], '.{{16}}'), lambda x: {_value("x")}) AS w FROM {source}
), {name}_l AS (
  SELECT id, lane, w[lane : 4 * (n // 32) : 4] AS w FROM {name}_w, range(1, 5) t(lane) WHERE n >= 32
), {name}_s AS (
  SELECT id, list(s ORDER BY lane) AS s FROM (SELECT id, lane, list_reduce(w, lambda c, x: {_round("c", "x")}, {inits}[lane]) AS s FROM {name}_l) GROUP BY id
), {name}_m AS (
  SELECT id, {merged} AS a FROM (SELECT id, s, {_low(f"{_turn('s[1]', 1)} + {_turn('s[2]', 7)} + {_turn('s[3]', 12)} + {_turn('s[4]', 18)}")} AS acc0 FROM {name}_s)
), {name}_8 AS (
  SELECT v.id, list_reduce(w[4 * (n // 32) + 1 :], lambda c, w: {after8}, {_low(f"coalesce(a, {_big((seed + _P5) & _MASK)}) + {_big('n')}")}) AS a, hex[16 * (n // 8) + 1 :] AS r
  FROM {name}_w v LEFT JOIN {name}_m m ON v.id = m.id
), {name}_4 AS (
  SELECT id, CASE WHEN len(r) >= 8 THEN {after4} ELSE a END AS a, CASE WHEN len(r) >= 8 THEN r[9:] ELSE r END AS r FROM {name}_8
), {name}_1 AS (
  SELECT id, list_reduce(list_transform(regexp_extract_all(r, '..'), lambda x: {_value("x")}), lambda c, w: {after1}, a) AS a FROM {name}_4
), {name} AS (SELECT id, {final} AS h FROM {name}_1)"""


def signed(h: str) -> str:
    return f"CAST(CASE WHEN {h} > {_big(2**63 - 1)} THEN CAST({h} AS HUGEINT) - 18446744073709551616 ELSE CAST({h} AS HUGEINT) END AS BIGINT)"


def _little_endian(h: str) -> str:
    return f"list_reduce(regexp_extract_all(printf('%016X', CAST({h} AS UBIGINT)), '..'), lambda p, q: q || p)"


_DOCS = "docs AS MATERIALIZED (SELECT doc_id AS id, hex(encode(text)) AS hex FROM documents WHERE text IS NOT NULL)"


def hash_plain_sql(seed: int) -> str:
    return f"WITH {_DOCS}, {xxh64('x', 'docs', seed)} SELECT doc_id, {signed('h')} AS hash FROM documents LEFT JOIN x ON doc_id = id"


def hash_blocked_sql(seed: int, least: int, blocks: int) -> str:
    return f"""WITH {_DOCS}, sized AS (
  SELECT id, hex, greatest({least}, 1 + (len(hex) // 2 - 1) // {blocks}) AS size FROM docs
), parts AS (
  SELECT {{'id': id, 'k': k}} AS id, hex[2 * size * k + 1 : 2 * size * (k + 1)] AS hex
  FROM (SELECT *, unnest(range((len(hex) // 2 + size - 1) // size)) AS k FROM sized)
), {xxh64('x', 'parts', seed)}, joined AS (
  SELECT id.id AS id, count(*) AS n, min(h) AS one, string_agg({_little_endian('h')}, '' ORDER BY id.k) AS hex FROM x GROUP BY id.id
), {xxh64('y', 'joined', seed)}, whole AS (
  SELECT joined.id, CASE WHEN n = 1 THEN one ELSE h END AS h FROM joined JOIN y ON joined.id = y.id
) SELECT doc_id, {signed('h')} AS hash FROM documents LEFT JOIN whole ON doc_id = id"""


def logical_values_sql(n: int, seed: int) -> str:
    """*seed* is the hash that the first column of the chain gives."""
    hexed = "list_reduce(regexp_extract_all(printf('%016X', i), '..'), lambda p, q: q || p)"
    return f"WITH ids AS (SELECT i AS id, {hexed} AS hex FROM range({n}) t(i)), {xxh64('x', 'ids', seed)}, m AS (SELECT id, ({signed('h')} % 3 + 3) % 3 AS v FROM x) SELECT id AS i, CASE WHEN v < 2 THEN v = 1 END AS value FROM m"
