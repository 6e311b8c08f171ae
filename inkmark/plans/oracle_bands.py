"""The SQL of the oriented bands, and of what is estimated from them: formulas of its own, over larger mosaics."""

from __future__ import annotations

import math

from inkmark.plans.oracle import GM, LUMA, ORACLE_SQL, PX, _sum

SIDE, SCALES, COUNTED = 72, 4, (0, 3)
#: Mosaics of 9 * 9 tiles.
PX9 = PX.replace("// 48", "// 243").replace("% 48", "% 243").replace("range(0, 48)", "range(0, 243)").replace("t // 4", "t // 9").replace("t % 4", "t % 9").replace("px AS (", "px AS MATERIALIZED (")
HALF = math.sqrt(2 * math.log(2))


def _gauss2(size: int, spread: float) -> list[list[float]]:
    h = size // 2
    rows = [[math.exp(-(x * x + y * y) / (2 * spread * spread)) for x in range(-h, h + 1)] for y in range(-h, h + 1)]
    total = sum(map(sum, rows))
    return [[v / total for v in row] for row in rows]


def _directional(k: int) -> list[list[float]]:
    """The fifth derivative of a bell of two dimensions along a direction, in closed form."""
    spread, turn = math.sqrt(5) / (math.pi / 2), math.pi * k / 6

    def value(y: int, x: int, angle: float) -> float:
        u = (x * math.cos(angle) + y * math.sin(angle)) / spread
        return (10 * u**3 - 15 * u - u**5) * math.exp(-(x * x + y * y) / (2 * spread * spread))

    response = sum(value(y, x, 0.0) * math.sin(math.pi * x / 2) for y in range(-3, 4) for x in range(-3, 4))
    energy = sum(math.cos(math.pi * i / 6) ** 10 for i in range(6))
    return [[value(y, x, turn) / abs(response) / math.sqrt(energy) for x in range(-3, 4)] for y in range(-3, 4)]


def _mirror(e: str, n: int) -> str:
    return f"CASE WHEN {e} < 0 THEN -({e}) WHEN {e} > {n - 1} THEN {2 * (n - 1)} - ({e}) ELSE {e} END"


def _filtered(source: str, name: str, filters: dict[str, list[list[float]]], n: int, step: int = 1) -> str:
    """Correlations by a join of every place with all taps."""
    size = max(len(f) for f in filters.values())
    h = size // 2
    at = lambda f, i, j: f[i + len(f) // 2][j + len(f) // 2] if max(abs(i), abs(j)) <= len(f) // 2 else 0.0
    taps = ", ".join(f"({i}, {j}, {', '.join(f'{at(f, i, j)!r}::DOUBLE' for f in filters.values())})" for i in range(-h, h + 1) for j in range(-h, h + 1))
    near = f"SELECT o.who, o.carrier_id, o.y, o.x, {_mirror('o.y + i', n)} AS sy, {_mirror('o.x + j', n)} AS sx, t.* FROM {source} o JOIN (VALUES {taps}) AS t(i, j, {', '.join(f'w_{f}' for f in filters)}) ON o.y % {step} = 0 AND o.x % {step} = 0"
    return f"{name} AS MATERIALIZED (SELECT n.who, n.carrier_id, (n.y // {step})::INT AS y, (n.x // {step})::INT AS x, {', '.join(f'sum(w_{f} * s.v) AS {f}' for f in filters)} FROM ({near}) n JOIN {source} s ON s.who = n.who AND s.carrier_id = n.carrier_id AND s.y = sy AND s.x = sx GROUP BY 1, 2, 3, 4)"


def _pyramid(orientations: tuple[int, ...]) -> list[str]:
    """bands(who, carrier_id, scale, orientation, y, x, v) of the planes l(who, ...)."""
    out, n = [_filtered("l", "s0", {"v": _gauss2(5, HALF / (0.75 * math.pi))}, SIDE)], SIDE
    for i in range(SCALES):
        out.append(_filtered(f"s{i}", f"b{i}", {f"v{k}": _directional(k) for k in orientations}, n))
        if i + 1 < SCALES:
            out.append(_filtered(f"s{i}", f"s{i + 1}", {"v": _gauss2(9, HALF / (0.5 * math.pi))}, n, 2))
        n = (n + 1) // 2
    each = " UNION ALL ".join(f"SELECT who, carrier_id, {i} AS scale, {k} AS orientation, y, x, v{k} AS v FROM b{i}" for i in range(SCALES) for k in orientations)
    return [*out, f"bands AS MATERIALIZED ({each})"]


def _with(select: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([PX9, *ctes]) + "\n" + select


PAIR = [GM.replace("gm AS (", "gm AS MATERIALIZED ("), f"l AS MATERIALIZED (SELECT 0 AS who, carrier_id, y, x, {_sum(LUMA)} AS v FROM px UNION ALL SELECT 1, carrier_id, y, x, {_sum(LUMA)} FROM gm)"]
ONE = [f"l AS MATERIALIZED (SELECT 0 AS who, carrier_id, y, x, {_sum(LUMA)} AS v FROM px)"]
ORACLE_SQL["oriented_subbands"] = _with("SELECT carrier_id, scale, orientation, y, x, round(v, 6) + 0e0 AS v FROM bands", *ONE, *_pyramid(tuple(range(6))))

BAND = "carrier_id, scale, orientation"


def _channel() -> list[str]:
    """est(BAND, y, x, gain, noise): sums over windows by joins of block centres with all places of their windows."""
    both = "ab AS MATERIALIZED (SELECT p.carrier_id, p.scale, p.orientation, p.y, p.x, p.v AS a, q.v AS b FROM bands p JOIN bands q ON q.who = 1 AND p.who = 0 AND q.carrier_id = p.carrier_id AND q.scale = p.scale AND q.orientation = p.orientation AND q.y = p.y AND q.x = p.x)"
    out, n = [both], SIDE
    for i in range(SCALES):
        h, used = 2 ** (SCALES - i - 1), n // 3 * 3
        centre = f"SELECT {BAND}, y // 3 AS block_y, x // 3 AS block_x, {_mirror('y + i', used)} AS sy, {_mirror('x + j', used)} AS sx FROM ab JOIN range({-h}, {h + 1}) AS r(i) ON scale = {i} AND y % 3 = 1 AND x % 3 = 1 AND y < {used} AND x < {used} JOIN range({-h}, {h + 1}) AS s(j) ON true"
        out.append(f"w{i} AS MATERIALIZED (SELECT c.carrier_id, c.scale, c.orientation, block_y::INT AS y, block_x::INT AS x, count(*)::DOUBLE AS n, avg(a) AS ma, avg(b) AS mb, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab FROM ({centre}) c JOIN ab s ON s.carrier_id = c.carrier_id AND s.scale = c.scale AND s.orientation = c.orientation AND s.y = sy AND s.x = sx GROUP BY 1, 2, 3, 4, 5)")
        n = (n + 1) // 2
    union = " UNION ALL ".join(f"SELECT * FROM w{i}" for i in range(SCALES))
    out.append(f"vars AS (SELECT *, ab - n * ma * mb AS c, greatest(aa - n * ma * ma, 0e0) AS va, greatest(bb - n * mb * mb, 0e0) AS vb FROM ({union}))")
    out.append("g AS (SELECT *, c / (va + 1e-15) AS g0 FROM vars)")
    out.append(f"est AS MATERIALIZED (SELECT {BAND}, y, x, CASE WHEN least(va, vb) < 1e-15 THEN 0e0 ELSE greatest(g0, 0e0) END AS gain, greatest(1e-15, CASE WHEN vb < 1e-15 THEN 0e0 WHEN va < 1e-15 OR g0 < 0 THEN vb ELSE (vb - g0 * c) / n END) AS noise FROM g)")
    return out


ORACLE_SQL["vifsub_est"] = _with(f"SELECT {BAND}, y, x, round(gain, 6) AS gain, round(noise, 6) AS noise FROM est", *PAIR, *_pyramid(COUNTED), *_channel())

#: The covariance of neighbourhoods of 3 * 3, as one list a band.
COVARIANCE = [
    "used AS (SELECT *, CASE scale WHEN 0 THEN 72 WHEN 1 THEN 36 WHEN 2 THEN 18 ELSE 9 END AS side FROM bands WHERE who = 0)",
    f"near AS MATERIALIZED (SELECT {BAND}, y - i AS y, x - j AS x, i * 3 + j AS p, v FROM used JOIN range(0, 3) AS r(i) ON y >= i AND y - i <= side - 3 JOIN range(0, 3) AS s(j) ON x >= j AND x - j <= side - 3)",
    "pairs AS (SELECT a.carrier_id, a.scale, a.orientation, a.p * 9 + b.p AS q, covar_pop(a.v, b.v) AS c FROM near a JOIN near b ON a.carrier_id = b.carrier_id AND a.scale = b.scale AND a.orientation = b.orientation AND a.y = b.y AND a.x = b.x GROUP BY 1, 2, 3, 4)",
    f"cov AS MATERIALIZED (SELECT {BAND}, list(c ORDER BY q) AS m FROM pairs GROUP BY 1, 2, 3)",
    f"blocks AS MATERIALIZED (SELECT {BAND}, (y // 3)::INT AS y, (x // 3)::INT AS x, list(v ORDER BY y % 3, x % 3) AS p FROM used GROUP BY 1, 2, 3, y // 3, x // 3)",
]


def _inverse() -> list[str]:
    """Gauss and Jordan on the covariance beside the identity."""
    out = [f"e0 AS (SELECT {BAND}, list_transform(range(0, 162), lambda q: CASE WHEN q % 18 < 9 THEN m[q // 18 * 9 + q % 18 + 1] WHEN q % 18 - 9 = q // 18 THEN 1e0 ELSE 0e0 END) AS m FROM cov)"]
    for k in range(9):
        pivot = f"m[{k * 18 + k + 1}]"
        out.append(f"e{k + 1} AS MATERIALIZED (SELECT {BAND}, list_transform(range(0, 162), lambda q: CASE WHEN q // 18 = {k} THEN m[q + 1] / {pivot} ELSE m[q + 1] - m[q // 18 * 18 + {k + 1}] * m[{k * 18 + 1} + q % 18] / {pivot} END) AS m FROM e{k})")
    form = "list_sum(list_transform(range(0, 81), lambda q: p[q // 9 + 1] * p[q % 9 + 1] * m[q // 9 * 18 + 10 + q % 9]))"
    return [*out, f"mult AS MATERIALIZED (SELECT {BAND}, y, x, {form} / 9e0 AS multiplier FROM blocks JOIN e9 USING ({BAND}))"]


ORACLE_SQL["refparams_vecgsm"] = _with(f"SELECT {BAND}, y, x, round(multiplier, 6) AS multiplier FROM mult", *ONE, *_pyramid(COUNTED), *COVARIANCE, *_inverse())


def _jacobi(sweeps: int = 9) -> list[str]:
    """Eigenvalues by plane rotations, 36 a sweep."""
    pairs = [(p, q) for p in range(9) for q in range(p + 1, 9)]
    ps, qs = f"[{', '.join(str(p) for p, _ in pairs)}]", f"[{', '.join(str(q) for _, q in pairs)}]"
    turned = lambda m, r, at: f"CASE WHEN {r} = p THEN co * {m}[{at('p')}] + si * {m}[{at('q')}] WHEN {r} = q THEN co * {m}[{at('q')}] - si * {m}[{at('p')}] ELSE {m}[k + 1] END"
    rows = turned("m", "k // 9", lambda r: f"{r} * 9 + k % 9 + 1")
    columns = turned("half", "k % 9", lambda c: f"k // 9 * 9 + {c} + 1")
    angle = "0.5e0 * atan2(2e0 * m[p * 9 + q + 1], m[p * 9 + p + 1] - m[q * 9 + q + 1])"
    at = f"SELECT *, {ps}[step % 36 + 1] AS p, {qs}[step % 36 + 1] AS q FROM jac WHERE step < {36 * sweeps}"
    spun = f"SELECT *, cos({angle}) AS co, sin({angle}) AS si FROM ({at})"
    return [f"jac AS (SELECT {BAND}, 0 AS step, m FROM cov UNION ALL SELECT {BAND}, step + 1, list_transform(range(0, 81), lambda k: {columns}) FROM (SELECT *, list_transform(range(0, 81), lambda k: {rows}) AS half FROM ({spun})))", f"vals AS (SELECT {BAND}, list_reverse_sort(list_transform(range(0, 9), lambda k: m[k * 10 + 1])) AS e FROM jac WHERE step = {36 * sweeps})"]


ORACLE_SQL["vecgsm_eigenvalues"] = _with(f"SELECT {BAND}, i::INT AS i, round(e[i + 1], 6) AS eigenvalue FROM vals JOIN range(0, 9) AS r(i) ON true", *ONE, *_pyramid(COUNTED), *COVARIANCE, *_jacobi())


def _score() -> list[str]:
    """Sums of logarithms over eigenvalues as logarithms of determinants, by elimination block by block."""
    inner = " OR ".join(f"scale = {i} AND least(y, x) >= {o} AND greatest(y, x) < {n // 3 - o}" for i, (n, o) in enumerate(((72, 3), (36, 2), (18, 1), (9, 1))))
    out = [f"f AS (SELECT {BAND}, y, x, gain * gain * multiplier / (noise + 0.4e0) AS kept, multiplier / 0.4e0 AS told FROM est JOIN mult USING ({BAND}, y, x) WHERE {inner})"]
    out.append(f"d0 AS (SELECT carrier_id, which, 0e0 AS logs, list_transform(range(0, 81), lambda q: (CASE WHEN q // 9 = q % 9 THEN 1e0 ELSE 0e0 END) + t * m[q + 1]) AS m FROM (SELECT f.*, which, CASE which WHEN 0 THEN kept ELSE told END AS t FROM f JOIN range(0, 2) AS r(which) ON true) JOIN cov USING ({BAND}))")
    for k in range(9):
        pivot = f"m[{k * 10 + 1}]"
        out.append(f"d{k + 1} AS MATERIALIZED (SELECT carrier_id, which, logs + log2({pivot}) AS logs, list_transform(range(0, 81), lambda q: CASE WHEN q // 9 <= {k} THEN m[q + 1] ELSE m[q + 1] - m[q // 9 * 9 + {k + 1}] * m[{k * 9 + 1} + q % 9] / {pivot} END) AS m FROM d{k})")
    return out


ORACLE_SQL["vif"] = _with("SELECT carrier_id, round(sum(logs) FILTER (which = 0) / sum(logs) FILTER (which = 1), 6) AS vif, 'ok' AS status FROM d9 GROUP BY 1", *PAIR, *_pyramid(COUNTED), *_channel(), *COVARIANCE, *_inverse(), *_score())
