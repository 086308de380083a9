"""DuckDB SQL of the hash families, built up in common table expressions.

Products and sums are taken in 128 bits and reduced modulo 2^64; results are
shown as signed longs.
"""

from __future__ import annotations

from corpusloom.functions import kernels as K

M = "18446744073709551616::UHUGEINT"
ONES = "18446744073709551615::UHUGEINT"
P1, P2, P3, P4, P5 = (int(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def lit(x: int) -> str:
    return f"{x & K.MASK}::UHUGEINT"


def mul(a: str, b: int) -> str:
    return f"((({a})::UHUGEINT * {lit(b)}) & {ONES})::UBIGINT"


def add(a: str, b: int | str) -> str:
    b = lit(b) if isinstance(b, int) else f"({b})::UHUGEINT"
    return f"((({a})::UHUGEINT + {b}) & {ONES})::UBIGINT"


def rotl(x: str, r: int) -> str:
    return f"(((({x})::UHUGEINT * {1 << r}::UHUGEINT) & {ONES})::UBIGINT | (({x}) >> {64 - r}))"


def signed(x: str) -> str:
    return f"CASE WHEN {x} >= 9223372036854775808 THEN ({x}::HUGEINT - 18446744073709551616::HUGEINT)::BIGINT ELSE {x}::BIGINT END"


def mix(acc: str, h: str) -> str:
    return mul(f"xor({rotl(acc, 31)}, {h})", K.GAMMA)


def chain(source: str, steps: list[tuple[str, str]], keep: str = "*") -> str:
    """Nested selects, each adding a column computed from those before it."""
    for name, expr in steps:
        source = f"(SELECT {keep}, {expr} AS {name} FROM {source})"
    return source


_AVALANCHE = [("g1", mul("xor(g0, g0 >> 33)", P2)), ("g2", mul("xor(g1, g1 >> 29)", P3)), ("hash", "xor(g2, g2 >> 32)")]


def _lane(hx: str, at: str, n: int = 8) -> str:
    return "('0x' || " + " || ".join(f"substr({hx}, 2 * ({at}) + {2 * i + 1}, 2)" for i in reversed(range(n))) + ")::UBIGINT"


def token_hash(source: str) -> str:
    """(tok, hash) for each row of a relation with a column ``tok``: XXH64 of its UTF-8."""
    inits = [(P1 + P2) & K.MASK, P2, 0, -P1 & K.MASK]
    steps = [("hx", "hex(encode(tok))"), ("n", "(length(hx) // 2)"), ("lanes", f"list_transform(range(0, n // 8), lambda i: {_lane('hx', '8 * i')})"), ("s", "CASE WHEN n >= 32 THEN n // 32 ELSE 0 END")]
    for j in range(4):
        body = mul(rotl(add("acc", mul("x", P2)), 31), P1)
        steps.append((f"v{j}", f"list_reduce(list_prepend({inits[j]}::UBIGINT, list_transform(range(0, s), lambda i: lanes[4 * i + {j + 1}])), lambda acc, x: {body})"))
    steps.append(("m0", add(add(add(rotl("v0", 1), rotl("v1", 7)), rotl("v2", 12)), rotl("v3", 18))))
    r0 = lambda x: mul(rotl(mul(x, P2), 31), P1)
    for j in range(4):
        steps.append((f"m{j + 1}", add(mul(f"xor(m{j}, {r0(f'v{j}')})", P1), P4)))
    steps.append(("h0", add(f"CASE WHEN s > 0 THEN m4 ELSE {P5}::UBIGINT END", "n")))
    steps.append(("tail", f"list_transform(lanes[4 * s + 1 :], lambda x: {r0('x')})"))
    steps.append(("h1", f"list_reduce(list_prepend(h0, tail), lambda acc, x: {add(mul(rotl('xor(acc, x)', 27), P1), P4)})"))
    steps.append(("k4", f"CASE WHEN n % 8 >= 4 THEN {mul(_lane('hx', '8 * (n // 8)', 4), P1)} END"))
    steps.append(("h2", f"CASE WHEN n % 8 >= 4 THEN {add(mul(rotl('xor(h1, k4)', 23), P2), P3)} ELSE h1 END"))
    steps.append(("rest", f"list_transform(range(n - n % 4, n), lambda i: {mul(_lane('hx', 'i', 1), P5)})"))
    steps.append(("g0", f"list_reduce(list_prepend(h2, rest), lambda acc, x: {mul(rotl('xor(acc, x)', 11), P1)})"))
    return f"(SELECT tok, hash FROM {chain(source, steps + _AVALANCHE)})"


TOKENS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"


def shingles(table: str, id: str, w: int = 3) -> str:
    """CTEs ending in ``sh`` (id, pos, h): word shingles of a table's texts."""
    leads = ", ".join(f"lead(hash, {j}) OVER (PARTITION BY id ORDER BY pos) AS t{j}" for j in range(w))
    acc = f"{K.MIX_INIT}::UBIGINT"
    steps = []
    for j in range(w):
        steps.append((f"a{j}", mix(acc, f"t{j}")))
        acc = f"a{j}"
    return f"""
tk AS (SELECT id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM (SELECT {id} AS id, {TOKENS} AS toks FROM {table})),
th AS MATERIALIZED (SELECT * FROM {token_hash("(SELECT DISTINCT tok FROM tk)")}),
tl AS (SELECT id, pos, {leads} FROM tk JOIN th USING (tok)),
sh AS MATERIALIZED (SELECT id, pos, {acc} AS h FROM {chain(f"(SELECT * FROM tl WHERE t{w - 1} IS NOT NULL)", steps)})"""


def signatures(k: int, seed: int = 0, source: str = "sh", ids: str = "") -> str:
    """CTE ``slots`` (id, slot, v): MinHash over ``source``; with ``ids`` (id) also empty sets."""
    a, b = K.permutations(k, seed)
    values = ", ".join(f"({i}, {int(x)}::UHUGEINT, {int(y)}::UHUGEINT)" for i, (x, y) in enumerate(zip(a, b, strict=True)))
    empty = f" UNION ALL SELECT id, i, {K.MASK}::UBIGINT FROM (SELECT id FROM {ids} EXCEPT SELECT id FROM {source}), (SELECT unnest(range({k})) AS i)" if ids else ""
    return f"""
perm(i, a, b) AS (VALUES {values}),
slots AS MATERIALIZED (SELECT id, i AS slot, min((h::UHUGEINT * a + b) & {ONES})::UBIGINT AS v FROM (SELECT DISTINCT id, h FROM {source}), perm GROUP BY id, i{empty}),
sigs AS MATERIALIZED (SELECT id, list(v ORDER BY slot) AS sig FROM slots GROUP BY id)"""


def bands(b: int, r: int) -> str:
    """CTE ``bk`` (id, band, key) from ``sigs``."""
    key = f"list_reduce(list_prepend({K.MIX_INIT}::UBIGINT, sig[band * {r} + 1 : band * {r} + {r}]), lambda acc, x: {mix('acc', 'x')})"
    return f"bk AS MATERIALIZED (SELECT id, band, {key} AS key FROM sigs, (SELECT unnest(range({b}))::INT AS band))"


def same(a: str, b: str, k: int) -> str:
    return f"(len(list_filter(list_zip({a}, {b}), lambda x: x[1] = x[2]))::DOUBLE / {k})"


def simhash(source: str = "sh") -> str:
    """CTE ``fps`` (id, fp) from shingles."""
    bits = ", ".join(f"sum(CASE WHEN (h >> {i}) & 1 = 1 THEN 1 ELSE -1 END) > 0 AS b{i}" for i in range(64))
    total = " + ".join(f"CASE WHEN b{i} THEN {1 << i}::UHUGEINT ELSE 0::UHUGEINT END" for i in range(64))
    return f"fps AS MATERIALIZED (SELECT id, ({total})::UBIGINT AS fp FROM (SELECT id, {bits} FROM {source} GROUP BY id))"


def char8(table: str, id: str) -> str:
    """CTE ``ch`` (id, pos, h): XXH64 of every 8-byte window."""
    r0 = mul(rotl(mul("lane", P2), 31), P1)
    steps = [("lane", _lane("win", "0")), ("k", r0), ("x", f"xor({(P5 + 8) & K.MASK}::UBIGINT, k)"), ("g0", add(mul(rotl("x", 27), P1), P4))]
    rows = f"(SELECT id, unnest(range(0, length(hx) // 2 - 7))::INT AS pos, unnest(list_transform(range(0, length(hx) // 2 - 7), lambda i: hx[2 * i + 1 : 2 * i + 16])) AS win FROM (SELECT {id} AS id, hex(encode(text)) AS hx FROM {table}))"
    return f"ch AS MATERIALIZED (SELECT id, pos, hash AS h FROM {chain(rows, steps + _AVALANCHE)})"


def winnow(w: int) -> str:
    """CTE ``wf`` (id, ord, pos, h) from ``ch``."""
    span = f"OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return f"""
wm AS (SELECT DISTINCT id, m FROM (SELECT id, pos, min(h::UHUGEINT * 4294967296::UHUGEINT + (4294967295 - pos)::UHUGEINT) {span} AS m FROM ch) WHERE pos >= {w - 1}),
wf AS MATERIALIZED (SELECT id, (row_number() OVER (PARTITION BY id ORDER BY pos) - 1)::INT AS ord, pos, h FROM (SELECT id, (4294967295::UHUGEINT - m % 4294967296::UHUGEINT)::INT AS pos, (m // 4294967296::UHUGEINT)::UBIGINT AS h FROM wm))"""


def finalizer(x: str, name: str) -> list[tuple[str, str]]:
    return [
        (f"{name}1", mul(f"xor({x}, {x} >> 30)", 0xBF58476D1CE4E5B9)),
        (f"{name}2", mul(f"xor({name}1, {name}1 >> 27)", 0x94D049BB133111EB)),
        (name, f"xor({name}2, {name}2 >> 31)"),
    ]


def hll(table: str, value: str, p: int, keys: str = "") -> str:
    """CTE ``regs`` (keys, idx, rho) of a 64-bit column."""
    comma = f"{keys}, " if keys else ""
    steps = [("z0", add(f"({value})::UBIGINT", K.GAMMA)), *finalizer("z0", "z")]
    rest = mul("z", 1 << p)
    steps += [("rest", rest), ("lz", "CASE WHEN rest = 0 THEN 64 ELSE 64 - length(ltrim(bin(rest), '0')) END")]
    group = f"GROUP BY {comma}idx"
    return f"regs AS MATERIALIZED (SELECT {comma}(z >> {64 - p})::INT AS idx, max(least(lz + 1, {64 - p + 1}))::INT AS rho FROM {chain(f'(SELECT * FROM {table} WHERE {value} IS NOT NULL)', steps)} {group})"
