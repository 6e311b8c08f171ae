"""For each registered query the same result in SQL, over the given tables."""

from __future__ import annotations

import math

ORACLE_SQL: dict[str, str] = {}
RGB = ("r", "g", "b")


def level(e: str) -> str:
    """Rounded half to even, then clipped."""
    return f"greatest(0, least(255, round_even(({e})::DOUBLE, 0)))::INT"


# Fixed values, written again for the SQL: what the code has in other places isn't read here.
LUMA = (0.299, 0.587, 0.114)
YIQ_I, YIQ_Q = (0.596, -0.274, -0.322), (0.211, -0.523, 0.312)
YCBCR_CB, YCBCR_CR = (-0.168736, -0.331264, 0.5), (0.5, -0.418688, -0.081312)
SSIM_1, SSIM_2 = "6.5025::DOUBLE", "58.5225::DOUBLE"
SCALES = (0.0448, 0.2856, 0.3001, 0.2363, 0.1333)
SCHARR = ((3, 0, -3), (10, 0, -10), (3, 0, -3))
BAYER_4 = (0, 8, 2, 10, 12, 4, 14, 6, 3, 11, 1, 9, 15, 7, 13, 5)
WHITE = (0.95047, 1.0, 1.08883)
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))


def _sum(weights: tuple[float, ...], names: tuple[str, ...] = RGB, start: str = "") -> str:
    return "(" + start + " + ".join(f"({w})::DOUBLE * {n}" for w, n in zip(weights, names, strict=True)) + ")"


def _ycbcr() -> dict[str, str]:
    return {"y_": level(_sum(LUMA)), "cb": level(_sum(YCBCR_CB, start="128e0 + ")), "cr": level(_sum(YCBCR_CR, start="128e0 + "))}


def _from_ycbcr(y: str, cb: str, cr: str) -> dict[str, str]:
    u, v = f"({cb} - 128)::DOUBLE", f"({cr} - 128)::DOUBLE"
    return {"r": level(f"{y} + 1.402e0 * {v}"), "g": level(f"{y} - 0.344136e0 * {u} - 0.714136e0 * {v}"), "b": level(f"{y} + 1.772e0 * {u}")}


def _hsv() -> dict[str, str]:
    top, span = "list_max([r, g, b])", "(list_max([r, g, b]) - list_min([r, g, b]))::DOUBLE"
    sector = f"CASE WHEN {span} = 0 THEN 0e0 WHEN r = {top} THEN (g - b) / {span} WHEN g = {top} THEN 2e0 + (b - r) / {span} ELSE 4e0 + (r - g) / {span} END"
    return {"h": level(f"255e0 * (list_sum([{sector}, CASE WHEN ({sector}) < 0 THEN 6e0 ELSE 0e0 END]) / 6e0)"), "s": level(f"coalesce(255e0 * {span} / nullif({top}, 0), 0e0)"), "v": top}


def _from_hsv(h: str, s: str, v: str) -> dict[str, str]:
    """A channel's place among six for each sixth of the circle: value, falling, low, rising."""
    turn = f"({h} * 6e0 / 255e0)"
    part = f"({turn} - floor({turn}))"
    value, low = f"{v}::DOUBLE", f"{v} * (1e0 - {s} / 255e0)"
    falling, rising = f"{v} * (1e0 - {part} * {s} / 255e0)", f"{v} * (1e0 - (1e0 - {part}) * {s} / 255e0)"
    wheel = [value, falling, low, low, rising, value]
    at = lambda shift: f"[{', '.join(wheel[(k + shift) % 6] for k in range(6))}][floor({turn})::INT % 6 + 1]"
    return {"r": level(at(0)), "g": level(at(4)), "b": level(at(2))}


def _lab() -> dict[str, str]:
    linear = [f"(CASE WHEN {c} > 10 THEN pow(({c} / 255e0 + 0.055e0) / 1.055e0, 2.4e0) ELSE {c} / 255e0 / 12.92e0 END)" for c in RGB]
    t = [f"({_sum(row, tuple(linear))} / {w}::DOUBLE)" for row, w in zip(TO_XYZ, WHITE, strict=True)]
    x, y, z = (f"(CASE WHEN {e} <= 0.008856451679e0 THEN 7.787037037037e0 * {e} + 16e0 / 116e0 ELSE pow({e}, 1e0 / 3e0) END)" for e in t)
    return {"l": level(f"2.55e0 * (116e0 * {y} - 16e0)"), "a": level(f"500e0 * ({x} - {y}) + 128e0"), "b_": level(f"200e0 * ({y} - {z}) + 128e0")}


def _from_lab(l_: str, a: str, b: str) -> dict[str, str]:
    y = f"(({l_} / 2.55e0 + 16e0) / 116e0)"
    parts = (f"({y} + ({a} - 128e0) / 500e0)", y, f"({y} - ({b} - 128e0) / 200e0)")
    xyz = tuple(f"({w}::DOUBLE * (CASE WHEN {e} > 0.206896551724e0 THEN {e} * {e} * {e} ELSE ({e} - 16e0 / 116e0) / 7.787037037037e0 END))" for e, w in zip(parts, WHITE, strict=True))
    back = {"r": (3.2404542, -1.5371385, -0.4985314), "g": (-0.9692660, 1.8760108, 0.0415560), "b": (0.0556434, -0.2040259, 1.0572252)}
    return {c: level(f"255e0 * (CASE WHEN {_sum(w, xyz)} > 0.0031308e0 THEN 1.055e0 * pow(greatest({_sum(w, xyz)}, 0e0), 1e0 / 2.4e0) - 0.055e0 ELSE 12.92e0 * {_sum(w, xyz)} END)") for c, w in back.items()}


def _uniform(key: str) -> str:
    """The first eight digits of an MD5 as a share of 2 to the 32."""
    return f"(('0x' || left(md5({key}), 8))::BIGINT / 4294967296e0)"


def _each(formula) -> str:
    return ", ".join(f"{formula(c)} AS {c}" for c in RGB)


#: Pixels of the mosaics: vectors by carrier, channel and tile; their values by place.
PX = f"""v AS (SELECT vec_id // 48 AS carrier_id, vec_id % 48 AS k, embedding FROM embeddings),
need AS (SELECT carrier_id, k::INT AS k FROM (SELECT DISTINCT carrier_id FROM v), range(0, 48) AS n(k)),
long AS (SELECT carrier_id, k % 3 AS c, k // 3 AS t, i, coalesce(embedding[i + 1]::DOUBLE, -1e0) AS e FROM need LEFT JOIN v USING (carrier_id, k), range(0, 64) AS r(i)),
placed AS (SELECT carrier_id, ((t // 4) * 8 + i // 8)::INT AS y, ((t % 4) * 8 + i % 8)::INT AS x, c, {level("(e + 1e0) * 127.5e0")} AS l FROM long),
px AS (SELECT carrier_id, y, x, max(l) FILTER (c = 0) AS r, max(l) FILTER (c = 1) AS g, max(l) FILTER (c = 2) AS b FROM placed GROUP BY 1, 2, 3)"""
GAMMA = _each(lambda c: level(f"255e0 * pow({c} / 255e0, 1.5e0)"))
DIMS = "dims AS (SELECT carrier_id, max(y) + 1 AS height, max(x) + 1 AS width FROM px GROUP BY 1)"
BITS = "bits AS (SELECT item_id AS wm_id, (SELECT string_agg(((('0x' || substr(md5(item_id::VARCHAR), i // 4 + 1, 1))::INT >> (3 - i % 4)) & 1)::VARCHAR, '' ORDER BY i) FROM range(0, 128) AS n(i)) AS bits FROM benchmark)"
MARKS = f"{BITS},\nmarks AS (SELECT DISTINCT carrier_id, carrier_id % (SELECT count(*) FROM benchmark) AS wm_id, bits FROM px LEFT JOIN bits ON wm_id = carrier_id % (SELECT count(*) FROM benchmark))"
FLAT = f"{DIMS},\nflat AS (SELECT carrier_id, (y::BIGINT * width + x) * 3 + c AS pos, [r, g, b][c + 1] AS level FROM px JOIN dims USING (carrier_id), (VALUES (0), (1), (2)) AS n(c))"
MARKED = "marked AS (SELECT carrier_id, pos, CASE WHEN pos < length(bits) THEN (level & 254) | substr(bits, pos::INT + 1, 1)::INT ELSE level END AS level FROM flat LEFT JOIN marks USING (carrier_id))"
GM = f"gm AS (SELECT carrier_id, y, x, {GAMMA} FROM px)"
MARKED_PX = f"mp AS (SELECT carrier_id, (pos // 3 // width)::INT AS y, (pos // 3 % width)::INT AS x, max(level) FILTER (pos % 3 = 0) AS r, max(level) FILTER (pos % 3 = 1) AS g, max(level) FILTER (pos % 3 = 2) AS b FROM marked JOIN dims USING (carrier_id) GROUP BY 1, 2, 3)"


def px(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([PX, *ctes]) + "\n" + select


def _named(formulas: dict[str, str], source: str = "px") -> str:
    return f"SELECT carrier_id, y, x, {', '.join(f'{e} AS {n}' for n, e in formulas.items())} FROM {source}"


#: What each query over pixels selects, and from which tables: the report applies it to other pixels.
PARTS: dict[str, tuple[str, tuple[str, ...]]] = {}


def add(name: str, select: str, *ctes: str) -> None:
    ORACLE_SQL[name], PARTS[name] = px(select, *ctes), (select, ctes)


def applied(name: str, source: str) -> str:
    """The query's text over the pixels of another table."""
    select, ctes = PARTS[name]
    return "WITH " + ",\n".join([f"px AS (SELECT * FROM {source})", *ctes]) + f" {select}"


# Sources
_value = "(embedding[i + 1]::DOUBLE + 1e0) * 127.5e0"
ORACLE_SQL["pixels_from_arrays"] = f"SELECT vec_id AS carrier_id, (i // 8)::INT AS y, (i % 8)::INT AS x, {level(_value)} AS r, {level(f'255e0 - {_value}')} AS g, {level(f'{_value} / 2e0')} AS b FROM embeddings, range(0, 64) AS n(i)"
add("synthetic_carriers", "SELECT carrier_id, y::INT AS y, x::INT AS x, ((x * 7 + y * 13 + (x * y) // 5 + carrier_id * 31) % 256)::INT AS r, ((x * 11 + y * 5 + carrier_id * 17) % 256)::INT AS g, (((x * x) // 7 + y * 3 + carrier_id * 23) % 256)::INT AS b FROM (SELECT DISTINCT carrier_id FROM px), range(0, 24) AS a(y), range(0, 20) AS c(x)")
add("carrier_sizes", "SELECT * FROM dims", DIMS)
add("flat_samples", "SELECT * FROM flat", FLAT)
DEPTH = _each(lambda c: level(f"({c} >> 4) * 255e0 / 15e0"))
add("write_pixels", f"SELECT carrier_id, y, x, {DEPTH}, 'bit_depth' AS attack_id FROM px UNION ALL SELECT *, 'lossless' FROM px")

ORACLE_SQL["carrier_files"] = px("SELECT * FROM px")
_heights = "CASE WHEN row = 24 THEN 8 ELSE 12 END"
add("carrier_listing", f"SELECT 'carrier-' || carrier_id || '-row-' || row || '.ppm' AS name, (strlen('P6.255.# carrier .# row .# height 32.32 .' || carrier_id || row || {_heights}) + 3 * 32 * {_heights})::BIGINT AS length FROM (SELECT DISTINCT carrier_id FROM px), (VALUES (0), (12), (24)) AS n(row)")

# Colours
add("to_level", f"SELECT carrier_id, y, x, {level('r * 1.37e0 - g * 0.5e0')} AS level FROM px")
add("luma", f"SELECT carrier_id, y, x, round({_sum(LUMA)}, 6) AS v FROM px")
add("yiq", _named({"l": f"round({_sum(LUMA)}, 6)", "i": f"round({_sum(YIQ_I)}, 6) + 0e0", "q": f"round({_sum(YIQ_Q)}, 6) + 0e0"}))
add("rgb_hsv", _named(_hsv()))
add("rgb_ycbcr", _named(_ycbcr()))
add("rgb_lab", _named(_lab()))
add("hsv_rgb", _named(_from_hsv("h", "s", "v"), "z"), f"z AS ({_named(_hsv())})")
add("ycbcr_rgb", _named(_from_ycbcr("y_", "cb", "cr"), "z"), f"z AS ({_named(_ycbcr())})")

# Embedding
add("lsb_embed", "SELECT * FROM marked", MARKS, FLAT, MARKED)
add("lsb_extract", "SELECT carrier_id, string_agg((level & 1)::VARCHAR, '' ORDER BY pos) AS bits FROM marked WHERE pos < 128 GROUP BY 1", MARKS, FLAT, MARKED)
ORACLE_SQL["lsb_embed_table"] = f"""WITH {BITS},
rows AS (SELECT l_suppkey AS carrier_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * 100)::BIGINT) - 1 AS pos, round(l_extendedprice * 100)::BIGINT AS cents FROM lineitem)
SELECT carrier_id, pos, CASE WHEN pos < length(bits) THEN (cents & -2) | substr(bits, pos::INT + 1, 1)::INT ELSE cents END AS level
FROM rows LEFT JOIN bits ON wm_id = carrier_id % (SELECT count(*) FROM benchmark)"""
ORACLE_SQL["dropped_bits"] = f"""WITH {BITS},
n AS (SELECT l_suppkey AS carrier_id, count(*) AS n FROM lineitem GROUP BY 1)
SELECT carrier_id, greatest(6 * length(bits) - n, 0)::BIGINT AS bits_dropped FROM n LEFT JOIN bits ON wm_id = carrier_id % (SELECT count(*) FROM benchmark)"""
_half = "half AS (SELECT carrier_id, pos, CASE WHEN pos < 64 THEN (level & 254) | substr(bits, pos::INT + 1, 1)::INT ELSE level END AS level FROM flat LEFT JOIN marks USING (carrier_id))"
add("embed_suite", "SELECT *, 'whole' AS embedding_id FROM mp UNION ALL SELECT *, 'half' FROM hp", MARKS, FLAT, MARKED, MARKED_PX, _half, MARKED_PX.replace("mp AS", "hp AS").replace("FROM marked", "FROM half"))

# Distortions
add("bit_depth", f"SELECT carrier_id, y, x, {DEPTH} FROM px")
for _name in ("gamma", "gamma_lut_join"):
    add(_name, f"SELECT carrier_id, y, x, {GAMMA} FROM px")
add("grayscale", f"SELECT carrier_id, y, x, {_each(lambda c: level(_sum(LUMA)))} FROM px")


def _dither(levels: int, matrix: tuple[int, ...]) -> str:
    n, step = {16: 4, 64: 8}[len(matrix)], 255 / (levels - 1)
    grid = f"[{', '.join(f'{v / len(matrix)}::DOUBLE' for v in matrix)}][(y % {n}) * {n} + x % {n} + 1]"
    return f"SELECT carrier_id, y, x, {_each(lambda c: level(f'floor({c} / {step}::DOUBLE + {grid}) * {step}::DOUBLE'))} FROM px"


#: Of the matrix of 8 * 8 each cell is four times that of 4 * 4, and that of its quarter in the smallest one.
BAYER_8 = tuple(4 * BAYER_4[(y % 4) * 4 + x % 4] + ((0, 2), (3, 1))[y // 4][x // 4] for y in range(8) for x in range(8))
add("dither_ordered", _dither(2, BAYER_4))
add("dither_ordered_8", _dither(4, BAYER_8))


def _mean(source: str, name: str) -> str:
    return f"{name} AS (SELECT carrier_id, sum(299 * r + 587 * g + 114 * b)::DOUBLE / count(*) / 1000e0 AS mean FROM {source} GROUP BY 1)"


add("brightness_contrast", f"SELECT carrier_id, y, x, {_each(lambda c: level(f'mean + 1.2e0 * ({c} - mean)'))} FROM lit JOIN m USING (carrier_id)", f"lit AS (SELECT carrier_id, y, x, {_each(lambda c: level(f'{c} * 1.2e0'))} FROM px)", _mean("lit", "m"))


def _draw(k: int, width: str) -> str:
    return f"((2e0 * {_uniform(f'''concat_ws(':', '0', carrier_id::VARCHAR, '{k}')''')} - 1e0) * {width}e0)"


add(
    "color_jitter",
    _named(_from_hsv("h", "s", "v"), "turned"),
    f"lit AS (SELECT carrier_id, y, x, {_each(lambda c: level(f'{c} * (1e0 + {_draw(0, '0.2')})'))} FROM px)",
    _mean("lit", "m"),
    f"flat AS (SELECT carrier_id, y, x, {_each(lambda c: level(f'mean + (1e0 + {_draw(1, '0.2')}) * ({c} - mean)'))} FROM lit JOIN m USING (carrier_id))",
    f"grey AS (SELECT *, {level(_sum(LUMA))} AS grey FROM flat)",
    f"full_ AS (SELECT carrier_id, y, x, {_each(lambda c: level(f'grey + (1e0 + {_draw(2, '0.2')}) * ({c} - grey)'))} FROM grey)",
    f"hsv AS ({_named(_hsv(), 'full_')})",
    f"turned AS (SELECT carrier_id, y, x, ((h + trunc({_draw(3, '0.05')} * 255e0)::INT) % 256 + 256) % 256 AS h, s, v FROM hsv)",
)

_normal = lambda c: "sqrt(-2e0 * ln(1e0 - {0})) * cos(6.283185307179586e0 * {1})".format(*(_uniform(f"concat_ws(':', '0', carrier_id::VARCHAR, y::VARCHAR, x::VARCHAR, '{c}{k}')") for k in (0, 1)))
for _space, _to, _back in (("ycbcr", _ycbcr(), _from_ycbcr), ("hsv", _hsv(), _from_hsv), ("lab", _lab(), _from_lab)):
    _noisy = ", ".join(f"{level(f'{n} + 10e0 * ({_normal(n)})')} AS {n}" for n in _to)
    add(f"color_noise_{_space}", _named(_back(*_to), "noisy"), f"own AS ({_named(_to)})", f"noisy AS MATERIALIZED (SELECT carrier_id, y, x, {_noisy} FROM own)")

# Histograms
HIST = "h AS (SELECT carrier_id, c, level, count(*) AS n FROM (SELECT carrier_id, c, [r, g, b][c + 1] AS level FROM px, (VALUES (0), (1), (2)) AS n(c)) GROUP BY 1, 2, 3)"
add("level_histogram", "SELECT * FROM h", HIST)
add(
    "hist_equalize",
    "SELECT carrier_id, y, x, max(w) FILTER (c = 0) AS r, max(w) FILTER (c = 1) AS g, max(w) FILTER (c = 2) AS b FROM (SELECT p.carrier_id, p.y, p.x, t.c, t.w FROM px p JOIN t ON t.carrier_id = p.carrier_id AND t.level = [p.r, p.g, p.b][t.c + 1]) GROUP BY 1, 2, 3",
    HIST,
    "s AS (SELECT *, sum(n) OVER (PARTITION BY carrier_id, c ORDER BY level) - n AS below, (sum(n) OVER (PARTITION BY carrier_id, c) - arg_max(n, level) OVER (PARTITION BY carrier_id, c)) // 255 AS step FROM h)",
    "t AS (SELECT carrier_id, c, level, CASE WHEN step = 0 THEN level ELSE least((step // 2 + below) // step, 255)::INT END AS w FROM s)",
)
add(
    "clahe",
    _named(_from_ycbcr("z", "cb", "cr"), "mixed"),
    DIMS,
    f"yc AS ({_named(_ycbcr())})",
    "own AS MATERIALIZED (SELECT yc.*, (height + 7) // 8 AS th, (width + 7) // 8 AS tw FROM yc JOIN dims USING (carrier_id))",
    "grid AS MATERIALIZED (SELECT carrier_id, ty, tx, bin FROM dims, range(0, 8) AS a(ty), range(0, 8) AS b(tx), range(0, 256) AS c(bin))",
    "cnt AS (SELECT carrier_id, y // th AS ty, x // tw AS tx, y_ AS bin, count(*) AS n FROM own GROUP BY 1, 2, 3, 4)",
    "h0 AS (SELECT grid.*, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY carrier_id, ty, tx) AS size FROM grid LEFT JOIN cnt USING (carrier_id, ty, tx, bin))",
    "h1 AS (SELECT *, greatest(1, trunc(2e0 * size / 256e0)::BIGINT) AS lim FROM h0)",
    "h2 AS (SELECT *, (sum(greatest(n - lim, 0)) OVER (PARTITION BY carrier_id, ty, tx))::BIGINT AS excess FROM h1)",
    "h3 AS (SELECT *, excess % 256 AS residual, CASE WHEN excess % 256 > 0 THEN greatest(1, 256 // (excess % 256)) ELSE 1 END AS stride FROM h2)",
    "h4 AS (SELECT carrier_id, ty, tx, bin, size, least(n, lim) + excess // 256 + CASE WHEN bin % stride = 0 AND bin // stride < residual THEN 1 ELSE 0 END AS m FROM h3)",
    "h5 AS (SELECT *, sum(m) OVER (PARTITION BY carrier_id, ty, tx ORDER BY bin) AS s, sum(m) OVER (PARTITION BY carrier_id, ty, tx) AS total FROM h4)",
    "maps AS MATERIALIZED (SELECT ((carrier_id * 8 + ty) * 8 + tx) * 256 + bin AS key, CASE WHEN size = 0 THEN bin / 255e0 * 255e0 ELSE s::DOUBLE / greatest(1e0, total::DOUBLE) * 255e0 END AS m FROM h5)",
    "near AS (SELECT *, least(greatest((y + 0.5e0) / th - 0.5e0, 0e0), 7e0) AS py, least(greatest((x + 0.5e0) / tw - 0.5e0, 0e0), 7e0) AS px_ FROM own)",
    "spot AS MATERIALIZED (SELECT *, floor(py)::INT AS y0, least(floor(py)::INT + 1, 7) AS y1, floor(px_)::INT AS x0, least(floor(px_)::INT + 1, 7) AS x1 FROM near)",
    "keyed AS MATERIALIZED (SELECT spot.*, " + ", ".join(f"((carrier_id * 8 + y{i}) * 8 + x{j}) * 256 + y_ AS k{i}{j}" for i in (0, 1) for j in (0, 1)) + " FROM spot)",
    "mixed AS MATERIALIZED (SELECT keyed.carrier_id, keyed.y, keyed.x, cb, cr, "
    + level("(m00.m * (1e0 - (px_ - floor(px_))) + m01.m * (px_ - floor(px_))) * (1e0 - (py - floor(py))) + (m10.m * (1e0 - (px_ - floor(px_))) + m11.m * (px_ - floor(px_))) * (py - floor(py))")
    + " AS z FROM keyed "
    + " ".join(f"JOIN maps m{i}{j} ON m{i}{j}.key = k{i}{j}" for i in (0, 1) for j in (0, 1))
    + ")",
)

# Palettes
SAMPLE = "ranked AS (SELECT *, (row_number() OVER (PARTITION BY carrier_id ORDER BY md5(concat_ws(':', '0', carrier_id::VARCHAR, y::VARCHAR, x::VARCHAR)), y, x))::INT AS rank FROM px)"
add("pixel_sample", "SELECT * FROM ranked WHERE rank <= 50", SAMPLE)


def _kmeans(rounds: int, colors: int = 2, size: int = 200) -> list[str]:
    square = " + ".join(f"(s.{c} - k.{c}) * (s.{c} - k.{c})" for c in RGB)
    out = [SAMPLE, "k0 AS (SELECT carrier_id, rank - 1 AS k, r::DOUBLE AS r, g::DOUBLE AS g, b::DOUBLE AS b FROM ranked WHERE rank <= " + f"{colors})"]
    for i in range(rounds):
        out.append(f"n{i} AS MATERIALIZED (SELECT s.carrier_id, s.rank, arg_min(k.k, [{square}, k.k]) AS k FROM ranked s JOIN k{i} k USING (carrier_id) WHERE rank <= {size} GROUP BY 1, 2)")
        out.append(f"m{i} AS (SELECT carrier_id, k, sum(r)::DOUBLE / count(*) AS r, sum(g)::DOUBLE / count(*) AS g, sum(b)::DOUBLE / count(*) AS b FROM n{i} JOIN ranked USING (carrier_id, rank) GROUP BY 1, 2)")
        out.append(f"k{i + 1} AS MATERIALIZED (SELECT o.carrier_id, o.k, {', '.join(f'coalesce(m.{c}, o.{c}) AS {c}' for c in RGB)} FROM k{i} o LEFT JOIN m{i} m USING (carrier_id, k))")
    return out


_square = " + ".join(f"(p.{c} - k.{c}) * (p.{c} - k.{c})" for c in RGB)
def _quantized(rounds: int) -> str:
    return f"SELECT carrier_id, y, x, {_each(lambda c: level(f'q.{c}'))} FROM (SELECT p.carrier_id, p.y, p.x, arg_min({{'r': k.r, 'g': k.g, 'b': k.b}}, [{_square}, k.k]) AS q FROM px p JOIN k{rounds} k USING (carrier_id) GROUP BY 1, 2, 3)"


add("quantize_kmeans", _quantized(3), *_kmeans(3))


def _median_cut(rounds: int) -> list[str]:
    out = ["c0 AS (SELECT carrier_id, r, g, b, count(*) AS n, 0 AS box FROM px GROUP BY 1, 2, 3, 4)"]
    for i in range(rounds):
        w = "OVER (PARTITION BY carrier_id, box)"
        out.append(f"w{i} AS (SELECT *, max(r) {w} - min(r) {w} AS wr, max(g) {w} - min(g) {w} AS wg, max(b) {w} - min(b) {w} AS wb FROM c{i})")
        out.append(f"q{i} AS (SELECT *, CASE WHEN wr >= wg AND wr >= wb THEN r WHEN wg >= wb THEN g ELSE b END AS key FROM w{i})")
        out.append(f"u{i} AS (SELECT *, sum(n) OVER (PARTITION BY carrier_id, box ORDER BY key, r, g, b) AS upto, sum(n) {w} AS total FROM q{i})")
        out.append(f"c{i + 1} AS (SELECT carrier_id, r, g, b, n, box * 2 + CASE WHEN 2 * (upto - n) >= total THEN 1 ELSE 0 END AS box FROM u{i})")
    return out


def _boxed(rounds: int) -> tuple[str, ...]:
    own = f"c{rounds}"
    select = f"SELECT p.carrier_id, p.y, p.x, {_each(lambda c: level(f'm.{c}'))} FROM px p JOIN {own} c ON c.carrier_id = p.carrier_id AND c.r = p.r AND c.g = p.g AND c.b = p.b JOIN m ON m.carrier_id = c.carrier_id AND m.box = c.box"
    means = ", ".join(f"sum({c} * n)::DOUBLE / sum(n) AS {c}" for c in RGB)
    return (select, *_median_cut(rounds), f"m AS (SELECT carrier_id, box, {means} FROM {own} GROUP BY 1, 2)")


add("quantize_median_cut", *_boxed(2))
add("palette_size", "SELECT carrier_id, count(DISTINCT (r, g, b)) AS n_colors FROM px GROUP BY 1")


# Crops
def _region(ratio: str, y_half: str, x_half: str) -> str:
    kept = lambda size: f"greatest(1, least({size}, round_even({size} * {ratio}e0, 0)::INT))"
    return f"{DIMS},\nk AS (SELECT *, {kept('height')} AS kh, {kept('width')} AS kw FROM dims),\nreg AS (SELECT *, {y_half} AS top, {x_half} AS lft FROM k)"


CENTER = _region("0.5", "(height - kh) // 2", "(width - kw) // 2")
INSIDE = "y >= top AND y < top + kh AND x >= lft AND x < lft + kw"


def _pad(values: tuple[int, int, int]) -> str:
    return "SELECT carrier_id, y, x, " + ", ".join(f"CASE WHEN {INSIDE} THEN {c} ELSE {v} END AS {c}" for c, v in zip(RGB, values, strict=True)) + " FROM px JOIN reg USING (carrier_id)"


add("crop_pad", _pad((255, 0, 255)), CENTER)
add("crop_raw", f"SELECT carrier_id, y - top AS y, x - lft AS x, r, g, b FROM px JOIN reg USING (carrier_id) WHERE {INSIDE}", _region("0.6", "height - kh", "width - kw"))
_random = {s: _uniform(f"concat_ws(':', '3', carrier_id::VARCHAR, '{s}')") for s in ("top", "left")}
add("crop_random", _pad((0, 0, 0)), _region("0.5", f"floor({_random['top']} * (height - kh + 1))::INT", f"floor({_random['left']} * (width - kw + 1))::INT"))
CUT = f"cut AS MATERIALIZED (SELECT carrier_id, y - top AS y, x - lft AS x, r, g, b FROM px JOIN reg USING (carrier_id) WHERE {INSIDE})"


def _taps(axis: str, kept: str, size: str, reach: float) -> str:
    """For every new place t of a carrier the old places that it may draw from, and how far each lies from its centre."""
    centre = f"(t + 0.5e0) * {kept} / {size} - 0.5e0"
    places = f"SELECT carrier_id, {kept}, {size}, unnest(range(0, {size}))::INT AS t FROM reg"
    near = f"SELECT *, unnest(range(greatest(0, ceil({centre} - {reach}e0)::INT), least({kept} - 1, floor({centre} + {reach}e0)::INT) + 1))::INT AS s FROM ({places})"
    return f"t{axis} AS MATERIALIZED (SELECT carrier_id, t, s, s - ({centre}) AS d FROM ({near}))"


_nearest = [f"n{a} AS MATERIALIZED (SELECT carrier_id, t, floor((t + 0.5e0) * {k} / {n})::INT AS s FROM (SELECT carrier_id, {k}, {n}, unnest(range(0, {n}))::INT AS t FROM reg))" for a, k, n in (("y", "kh", "height"), ("x", "kw", "width"))]
add("crop_resize_nearest", "SELECT c.carrier_id, ny.t AS y, nx.t AS x, r, g, b FROM cut c JOIN ny ON ny.carrier_id = c.carrier_id AND ny.s = c.y JOIN nx ON nx.carrier_id = c.carrier_id AND nx.s = c.x", CENTER, CUT, *_nearest)
_PI = "3.141592653589793e0"
_sinc = lambda e: f"(sin({_PI} * ({e})) / ({_PI} * ({e})))"
WEIGHTS = {
    "bilinear": "CASE WHEN abs(d) < 1 THEN 1e0 - abs(d) ELSE 0e0 END",
    "bicubic": "CASE WHEN abs(d) < 1 THEN 1e0 + d * d * (1.5e0 * abs(d) - 2.5e0) WHEN abs(d) < 2 THEN 2e0 + abs(d) * (-4e0 + abs(d) * (2.5e0 - 0.5e0 * abs(d))) ELSE 0e0 END",
    "lanczos": f"CASE WHEN d = 0 THEN 1e0 WHEN abs(d) < 3 THEN {_sinc('d')} * {_sinc('d / 3e0')} ELSE 0e0 END",
}
for _name, _weight in WEIGHTS.items():
    _reach = {"bilinear": 1, "bicubic": 2, "lanczos": 3}[_name]
    _weighted = [f"w{a} AS MATERIALIZED (SELECT carrier_id, t, s, {_weight} AS w FROM t{a})" for a in "yx"]
    _columns = "cols AS MATERIALIZED (SELECT c.carrier_id, c.y, t AS x, " + ", ".join(f"sum({c} * w) / sum(w) AS {c}" for c in RGB) + " FROM cut c JOIN wx ON wx.carrier_id = c.carrier_id AND s = c.x GROUP BY 1, 2, 3)"
    _rows = "SELECT c.carrier_id, t AS y, c.x, " + _each(lambda c: level(f"round(sum({c} * w) / sum(w), 6)")) + " FROM cols c JOIN wy ON wy.carrier_id = c.carrier_id AND s = c.y GROUP BY 1, 2, 3"
    add(f"crop_resize_{_name}", _rows, CENTER, CUT, _taps("y", "kh", "height", _reach), _taps("x", "kw", "width", _reach), *_weighted, _columns)

# Cosine coefficients
#: Fixed values, written again: the example tables of ITU-T T.81, annex K, by row.
T81 = (
    (16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99),
    (17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99, *[99] * 32),
)
_waves = ", ".join(f"({u}, {i}, {math.sqrt((2 if u else 1) / 8) * math.cos(math.pi * u * (i + 0.5) / 8)!r}::DOUBLE)" for u in range(8) for i in range(8))
_steps = ", ".join(f"({p}, {k // 8}, {k % 8}, {max(1, (v * 50 + 50) // 100)})" for p in range(3) for k, v in enumerate(T81[p > 0]))
add(
    "block_dct",
    _named(_from_ycbcr("p0", "p1", "p2"), "back"),
    f"waves AS MATERIALIZED (SELECT * FROM (VALUES {_waves}) AS t(u, i, w))",
    f"steps AS MATERIALIZED (SELECT * FROM (VALUES {_steps}) AS t(p, v, u, q))",
    f"yc AS ({_named(_ycbcr())})",
    "vals AS MATERIALIZED (SELECT carrier_id, y, x, p, [y_, cb, cr][p + 1] - 128e0 AS v FROM yc, range(0, 3) AS r(p))",
    "c1 AS MATERIALIZED (SELECT carrier_id, p, y, x // 8 AS bx, u, sum(v * w) AS c FROM vals JOIN waves ON i = x % 8 GROUP BY 1, 2, 3, 4, 5)",
    "c2 AS MATERIALIZED (SELECT carrier_id, p, y // 8 AS by_, bx, c1.u AS u, waves.u AS v, round(sum(c * w), 9) AS c FROM c1 JOIN waves ON i = y % 8 GROUP BY 1, 2, 3, 4, 5, 6)",
    "kept AS MATERIALIZED (SELECT c2.*, round_even(c / q, 0) * q AS k FROM c2 JOIN steps USING (p, u, v))",
    "b1 AS MATERIALIZED (SELECT carrier_id, p, by_, bx, kept.u AS u, i AS iy, sum(k * w) AS c FROM kept JOIN waves ON waves.u = v GROUP BY 1, 2, 3, 4, 5, 6)",
    "b2 AS MATERIALIZED (SELECT carrier_id, p, (by_ * 8 + iy)::INT AS y, (bx * 8 + i)::INT AS x, round(sum(c * w) + 128, 6) AS z FROM b1 JOIN waves USING (u) GROUP BY 1, 2, 3, 4)",
    "back AS MATERIALIZED (SELECT carrier_id, y, x, max(z) FILTER (p = 0) AS p0, max(z) FILTER (p = 1) AS p1, max(z) FILTER (p = 2) AS p2 FROM b2 GROUP BY 1, 2, 3)",
)

# Suites of distortions
_suite = f"SELECT *, 'compression' AS category, 'lossless' AS attack_id FROM {{0}} UNION ALL SELECT carrier_id, y, x, {DEPTH}, 'color', 'bit_depth' FROM {{0}} UNION ALL SELECT carrier_id, y, x, {GAMMA}, 'color', 'gamma' FROM {{0}} UNION ALL SELECT carrier_id, y, x, " + ", ".join(f"CASE WHEN {INSIDE} THEN {c} ELSE 0 END AS {c}" for c in RGB) + ", 'geometric', 'crop_pad' FROM {0} JOIN reg USING (carrier_id)"
add("attack_suite", _suite.format("px"), CENTER)
add("attack_chain", "SELECT carrier_id, y, x, " + ", ".join(f"CASE WHEN {INSIDE} THEN {c} ELSE 0 END AS {c}" for c in RGB) + " FROM ch JOIN reg USING (carrier_id)", CENTER, f"bd AS (SELECT carrier_id, y, x, {DEPTH} FROM px)", f"ch AS (SELECT carrier_id, y, x, {GAMMA} FROM bd)")
add("param_sweep", " UNION ALL ".join(f"SELECT carrier_id, y, x, {_each(lambda c, p=p: level(f'255e0 * pow({c} / 255e0, {p}e0)'))}, {p}e0 AS param FROM px" for p in ("0.5", "1.0", "2.0")))
add("lut_sweep", f"SELECT carrier_id, y, x, {_each(lambda c: level(f'255e0 * pow({c} / 255e0, param)'))}, param FROM px, (VALUES (0.4e0), (0.8e0), (1.6e0), (3.2e0)) AS n(param)")
_near3 = "SELECT carrier_id, y, x, least(greatest(y + i, 0), 31) AS sy, least(greatest(x + j, 0), 31) AS sx, (2 - abs(i)) * (2 - abs(j)) AS w FROM px, range(-1, 2) AS a(i), range(-1, 2) AS b(j)"
add("tiled_attack", f"SELECT o.carrier_id, o.y, o.x, {_each(lambda c: level(f'sum(w * s.{c}) / 16e0'))} FROM ({_near3}) o JOIN px s ON s.carrier_id = o.carrier_id AND s.y = sy AND s.x = sx GROUP BY 1, 2, 3")
add("palette_sketch", "SELECT carrier_id, count(DISTINCT (r, g, b)) AS exact, true AS within FROM all_ GROUP BY 1 UNION ALL SELECT NULL, count(DISTINCT (r, g, b)), true FROM all_", CENTER, f"all_ AS ({_suite.format('px')})")
add("lossless_diff", "SELECT *, 'first' AS side FROM px WHERE false")
add("custom_attack", "SELECT carrier_id, y, 31 - x AS x, r, g, b FROM px")

# Pixel metrics
PAIR = f"{GM},\nd AS (SELECT px.carrier_id, px.y, px.x, px.r - gm.r AS dr, px.g - gm.g AS dg, px.b - gm.b AS db FROM px JOIN gm USING (carrier_id, y, x))"
MSE = "e AS (SELECT carrier_id, sum(dr * dr + dg * dg + db * db)::DOUBLE / (3 * count(*)) AS mse, max(greatest(abs(dr), abs(dg), abs(db)))::DOUBLE AS most, avg(CASE WHEN dr <> 0 OR dg <> 0 OR db <> 0 THEN 1e0 ELSE 0e0 END) AS changed FROM d GROUP BY 1)"
PSNR = "CASE WHEN mse = 0 THEN 'inf'::DOUBLE ELSE 10e0 * log10(65025e0 / mse) END"
add("paired_pixels", "SELECT * FROM d", PAIR)
add("mse", "SELECT carrier_id, round(mse, 6) AS mse FROM e", PAIR, MSE)
add("psnr", f"SELECT carrier_id, round({PSNR}, 6) AS psnr FROM e", PAIR, MSE)
add("watermark_psnr", f"SELECT carrier_id, round({PSNR}, 6) AS psnr FROM e", GM, "e AS (SELECT carrier_id, avg(pow(" + _sum(LUMA, ("px.r", "px.g", "px.b")) + " - " + _sum(LUMA, ("gm.r", "gm.g", "gm.b")) + ", 2)) AS mse FROM px JOIN gm USING (carrier_id, y, x) WHERE y < 16 AND x < 16 GROUP BY 1)")
add("metric_suite", f"SELECT carrier_id, metric, round(CASE metric WHEN 'mse' THEN mse WHEN 'psnr' THEN {PSNR} WHEN 'max_difference' THEN most ELSE changed END, 6) AS value FROM e, (VALUES ('mse'), ('psnr'), ('max_difference'), ('changed')) AS n(metric)", PAIR, MSE)
_levels = "SELECT carrier_id, c, which, level, count(*) AS n FROM (SELECT px.carrier_id, c, which, CASE which WHEN 0 THEN [px.r, px.g, px.b][c + 1] ELSE [gm.r, gm.g, gm.b][c + 1] END AS level FROM px JOIN gm USING (carrier_id, y, x), range(0, 3) AS a(c), range(0, 2) AS b(which)) GROUP BY 1, 2, 3, 4"
_apart = f"apart AS (SELECT carrier_id, sum(abs(a)) / (2 * sum(first)) AS far FROM (SELECT carrier_id, c, level, sum(CASE which WHEN 0 THEN n ELSE -n END) AS a, sum(CASE which WHEN 0 THEN n ELSE 0 END) AS first FROM ({_levels}) GROUP BY 1, 2, 3) GROUP BY 1)"
add("user_metrics", f"SELECT carrier_id, metric, round(CASE metric WHEN 'mse' THEN mse WHEN 'own_mse' THEN mse WHEN 'psnr' THEN {PSNR} WHEN 'max_difference' THEN most WHEN 'changed' THEN changed ELSE far END, 6) AS value FROM e JOIN apart USING (carrier_id), (VALUES ('mse'), ('psnr'), ('max_difference'), ('changed'), ('own_mse'), ('histogram_distance')) AS n(metric)", PAIR, MSE, _apart)

# Bits
_seven = level("(level >> 1) * 255e0 / 127e0")
PAIRS = f"got AS (SELECT carrier_id, string_agg(({_seven} & 1)::VARCHAR, '' ORDER BY pos) AS extracted FROM marked WHERE pos < 128 GROUP BY 1),\npairs AS (SELECT carrier_id, bits AS original, extracted FROM marks JOIN got USING (carrier_id))"
SHORT = "short AS (SELECT carrier_id, original, CASE WHEN carrier_id % 2 = 0 THEN left(extracted, 100) ELSE extracted END AS extracted FROM pairs)"
_wrong = "(SELECT count(*) FROM range(1, length(extracted) + 1) AS n(i) WHERE substr(original, i::INT, 1) <> substr(extracted, i::INT, 1))"
_bits = (MARKS, FLAT, MARKED, PAIRS)
add("ber", f"SELECT carrier_id, CASE WHEN length(original) <> length(extracted) THEN 'length_mismatch' ELSE 'ok' END AS status, CASE WHEN length(original) = length(extracted) THEN round({_wrong} / length(extracted)::DOUBLE, 6) END AS ber FROM short", *_bits, SHORT)
add("ber_common_prefix", f"SELECT carrier_id, 'ok' AS status, round({_wrong} / length(extracted)::DOUBLE, 6) AS ber FROM short", *_bits, SHORT)
add("nc", f"SELECT carrier_id, 'ok' AS status, round((128 - 2 * {_wrong}) / 128e0, 6) AS nc FROM pairs", *_bits)
add("bit_length_mismatch", "SELECT carrier_id, length(original)::INT AS n_original, length(extracted)::INT AS n_extracted FROM short WHERE length(original) <> length(extracted)", *_bits, SHORT)

# Detectors
DET = "det AS (SELECT lang AS detector_id, doc_id AS sample_id, toxic AS y_true, 1 - quality AS y_pred, n_chars::DOUBLE AS y_score FROM labels JOIN documents USING (doc_id))"
CONF = f"{DET},\nc AS (SELECT detector_id, count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp, count(*) FILTER (y_true <> 1 AND y_pred <> 1) AS tn, count(*) FILTER (y_true <> 1 AND y_pred = 1) AS fp, count(*) FILTER (y_true = 1 AND y_pred <> 1) AS fn FROM det GROUP BY 1),\np AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0e0 ELSE tp / (tp + fp)::DOUBLE END AS pr, CASE WHEN tp + fn = 0 THEN 0e0 ELSE tp / (tp + fn)::DOUBLE END AS re FROM c)"
ORACLE_SQL["confusion_counts"] = f"WITH {CONF} SELECT * FROM c"
ORACLE_SQL["accuracy"] = f"WITH {CONF} SELECT detector_id, round((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 6) AS accuracy FROM c"
ORACLE_SQL["precision"] = f"WITH {CONF} SELECT detector_id, round(pr, 6) AS precision FROM p"
ORACLE_SQL["recall"] = f"WITH {CONF} SELECT detector_id, round(re, 6) AS recall FROM p"
ORACLE_SQL["f1"] = f"WITH {CONF} SELECT detector_id, round(CASE WHEN pr + re = 0 THEN 0e0 ELSE 2 * pr * re / (pr + re) END, 6) AS f1 FROM p"
ORACLE_SQL["avg_ranks"] = f"WITH {DET} SELECT *, rank() OVER (PARTITION BY detector_id ORDER BY y_score) + (count(*) OVER (PARTITION BY detector_id, y_score) - 1) / 2e0 AS rank FROM det"
ORACLE_SQL["auc"] = f"""WITH {DET}, pairs AS (SELECT a.detector_id, avg(CASE WHEN a.y_score > b.y_score THEN 1e0 WHEN a.y_score = b.y_score THEN 0.5e0 ELSE 0e0 END) AS auc FROM det a JOIN det b ON a.detector_id = b.detector_id AND a.y_true = 1 AND b.y_true = 0 GROUP BY 1)
SELECT d.detector_id, coalesce(round(auc, 6), 'nan'::DOUBLE) AS auc FROM (SELECT DISTINCT detector_id FROM det) d LEFT JOIN pairs USING (detector_id)"""
ORACLE_SQL["p_value"] = """WITH s AS (SELECT user_id, round(avg(value), 9) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT user_id, s.value, round(((SELECT count(*) FROM events e WHERE event_type = 'view' AND e.value >= s.value) + 1) / ((SELECT count(*) FROM events WHERE event_type = 'view' AND value IS NOT NULL) + 1)::DOUBLE, 6) AS p_value FROM s"""
ORACLE_SQL["p_value_by_detector"] = """WITH e AS (SELECT event_type AS detector_id, user_id, value FROM events), s AS (SELECT detector_id, user_id, round(avg(value), 9) AS value FROM e GROUP BY 1, 2)
SELECT s.detector_id, s.user_id, s.value, CASE WHEN s.detector_id = 'purchase' THEN 'nan'::DOUBLE ELSE round((count(*) FILTER (e.value >= s.value) + 1) / (count(e.value) + 1)::DOUBLE, 6) END AS p_value FROM s JOIN e USING (detector_id) GROUP BY 1, 2, 3"""
ORACLE_SQL["unmatched_labels"] = "SELECT doc_id AS sample_id, 'no_prediction' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'no_truth' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)"

# Neighbourhoods
_bell = [math.exp(-(i * i) / 4.5) for i in range(-5, 6)]
TAPS = [v / sum(_bell) for v in _bell]


def _luma(name: str, source: str) -> str:
    return f"{name} AS (SELECT carrier_id, y, x, {_sum(LUMA)} AS v FROM {source})"


def _valid(source: str, name: str, columns: tuple[str, ...]) -> str:
    """Two passes by joins with the taps."""
    taps = ", ".join(f"({i}, {t}::DOUBLE)" for i, t in enumerate(TAPS))
    total = ", ".join(f"sum(w * s.{c}) AS {c}" for c in columns)
    one = lambda a, src, out: f"{out} AS (SELECT s.carrier_id, {'s.y' if a == 'x' else 's.y - i'} AS y, {'s.x - i' if a == 'x' else 's.x'} AS x, {total}, count(*) AS taps FROM {src} s, (VALUES {taps}) AS t(i, w) WHERE s.{a} >= i GROUP BY 1, 2, 3 HAVING count(*) = {len(TAPS)})"
    return one("x", source, f"{name}_x") + ",\n" + one("y", f"{name}_x", name)


def _ssim(first: str, second: str, name: str) -> str:
    c1, c2 = SSIM_1, SSIM_2
    five = f"{name}_five AS (SELECT p.carrier_id, p.y, p.x, p.v AS a, q.v AS b, p.v * p.v AS aa, q.v * q.v AS bb, p.v * q.v AS ab FROM {first} p JOIN {second} q USING (carrier_id, y, x))"
    cs = f"(2e0 * (ab - a * b) + {c2}) / ((aa - a * a) + (bb - b * b) + {c2})"
    return f"{five},\n{_valid(f'{name}_five', f'{name}_f', ('a', 'b', 'aa', 'bb', 'ab'))},\n{name} AS (SELECT carrier_id, y, x, (2e0 * a * b + {c1}) / (a * a + b * b + {c1}) * ({cs}) AS ssim, {cs} AS cs FROM {name}_f)"


def _half2(source: str, name: str) -> str:
    at = lambda a: f"CASE WHEN {a} = 0 THEN 0 ELSE {a} - 1 END"
    return f"{name} AS (SELECT p.carrier_id, p.y // 2 AS y, p.x // 2 AS x, (p.v + q.v + r.v + s.v) / 4e0 AS v FROM {source} p JOIN {source} q ON q.carrier_id = p.carrier_id AND q.y = p.y AND q.x = {at('p.x')} JOIN {source} r ON r.carrier_id = p.carrier_id AND r.y = {at('p.y')} AND r.x = p.x JOIN {source} s ON s.carrier_id = p.carrier_id AND s.y = {at('p.y')} AND s.x = {at('p.x')} WHERE p.y % 2 = 0 AND p.x % 2 = 0)"


add("sepfilter_valid", "SELECT carrier_id, y, x, round(v, 6) AS v FROM z", _luma("l", "px"), _valid("l", "z", ("v",)))
_taps = ", ".join(f"({i - 5}, {t}::DOUBLE)" for i, t in enumerate(TAPS))
add("sepfilter_same", f"SELECT carrier_id, y::INT AS y, x::INT AS x, round(sum(w * v), 6) AS v FROM (SELECT carrier_id, y - i AS y, x, w, v FROM zx, (VALUES {_taps}) AS t(i, w)) WHERE y BETWEEN 0 AND 31 GROUP BY 1, 2, 3", _luma("l", "px"), f"zx AS (SELECT carrier_id, y, x, sum(w * v) AS v FROM (SELECT carrier_id, y, x - i AS x, w, v FROM l, (VALUES {_taps}) AS t(i, w)) WHERE x BETWEEN 0 AND 31 GROUP BY 1, 2, 3)")
_two = (GM, _luma("a0", "px"), _luma("b0", "gm"))
add("ssim_map", "SELECT carrier_id, y, x, round(ssim, 6) AS ssim, round(cs, 6) AS cs FROM z", *_two, _ssim("a0", "b0", "z"))
add("ssim", "SELECT carrier_id, round(avg(ssim), 6) AS ssim, 'ok' AS status FROM z GROUP BY 1", *_two, _ssim("a0", "b0", "z"))
add("downsample2", "SELECT carrier_id, y, x, round(v, 6) AS v FROM z", _luma("l", "px"), _half2("l", "z"))
_big = "big AS (SELECT carrier_id, (y * 6 + dy)::INT AS y, (x * 6 + dx)::INT AS x, r, g, b FROM px, range(0, 6) AS i(dy), range(0, 6) AS j(dx))"
_scales = [_ssim(f"a{k}", f"b{k}", f"z{k}") + (f",\n{_half2(f'a{k}', f'a{k + 1}')},\n{_half2(f'b{k}', f'b{k + 1}')}" if k < 4 else "") for k in range(5)]
_means = ",\n".join(f"m{k} AS (SELECT carrier_id, pow(greatest(avg({'ssim' if k == 4 else 'cs'}), 1e-8), {w}e0) AS s{k} FROM z{k} GROUP BY 1)" for k, w in enumerate(SCALES))
add("ms_ssim", "SELECT carrier_id, round(s0 * s1 * s2 * s3 * s4, 6) AS ms_ssim, 'ok' AS status FROM m0 JOIN m1 USING (carrier_id) JOIN m2 USING (carrier_id) JOIN m3 USING (carrier_id) JOIN m4 USING (carrier_id)", _big, f"gb AS (SELECT carrier_id, y, x, {GAMMA} FROM big)", _luma("a0", "big"), _luma("b0", "gb"), *_scales, _means)


def _conv3(source: str, name: str) -> str:
    taps = ", ".join(f"({i - 1}, {j - 1}, ({SCHARR[i][j] / 16})::DOUBLE, ({SCHARR[j][i] / 16})::DOUBLE)" for i in range(3) for j in range(3))
    return f"{name} AS (SELECT o.carrier_id, o.y, o.x, sum(hw * s.v) AS h, sum(ww * s.v) AS w FROM (SELECT carrier_id, y, x, least(greatest(y + i, 0), 31) AS sy, least(greatest(x + j, 0), 31) AS sx, hw, ww FROM {source}, (VALUES {taps}) AS t(i, j, hw, ww)) o JOIN {source} s ON s.carrier_id = o.carrier_id AND s.y = sy AND s.x = sx GROUP BY 1, 2, 3)"


add("conv3", "SELECT carrier_id, y, x, round(h, 9) + 0e0 AS h, round(w, 9) + 0e0 AS w FROM z", _luma("l", "px"), _conv3("l", "z"))
add("scharr_gradient", "SELECT carrier_id, y, x, round(sqrt(h * h + w * w), 6) AS v FROM z", _luma("l", "px"), _conv3("l", "z"))
add("gradient_similarity", "SELECT carrier_id, round(avg((2e0 * a * b + 160e0) / (a * a + b * b + 160e0)), 6) AS similarity FROM (SELECT p.carrier_id, sqrt(p.h * p.h + p.w * p.w) AS a, sqrt(q.h * q.h + q.w * q.w) AS b FROM za p JOIN zb q USING (carrier_id, y, x)) GROUP BY 1", *_two, _conv3("a0", "za"), _conv3("b0", "zb"))


def _box(source: str, name: str, factor: int) -> str:
    """Symmetric edge: place -1 is 0, -2 is 1."""
    edge = lambda a: f"CASE WHEN {a} < 0 THEN -{a} - 1 WHEN {a} > 31 THEN 63 - {a} ELSE {a} END"
    h = factor // 2
    return f"{name} AS (SELECT o.carrier_id, (o.y // {factor})::INT AS y, (o.x // {factor})::INT AS x, avg(s.v) AS v FROM (SELECT carrier_id, y, x, {edge(f'(y + i - {h})')} AS sy, {edge(f'(x + j - {h})')} AS sx FROM {source}, range(0, {factor}) AS a(i), range(0, {factor}) AS b(j) WHERE y % {factor} = 0 AND x % {factor} = 0) o JOIN {source} s ON s.carrier_id = o.carrier_id AND s.y = sy AND s.x = sx GROUP BY 1, 2, 3)"


add("downsample_box", "SELECT carrier_id, y, x, round(v, 9) AS v FROM z", _luma("l", "px"), _box("l", "z", 4))
_planes = [f"{n}{s} AS (SELECT carrier_id, y, x, {e} AS v FROM {src})" for n, e in (("i", _sum(YIQ_I)), ("q", _sum(YIQ_Q))) for s, src in (("a", "px"), ("b", "gm"))]
_boxes = [_box(f"{n}{s}", f"{n}{s}2", 2) for n in "iq" for s in "ab"]
_like = lambda n: f"(2e0 * {n}a2.v * {n}b2.v + 200e0) / ({n}a2.v * {n}a2.v + {n}b2.v * {n}b2.v + 200e0)"
add("chroma_similarity", "SELECT carrier_id, round(avg(sign(c) * pow(abs(c), 0.03e0)), 6) AS similarity FROM t GROUP BY 1", GM, *_planes, *_boxes, f"t AS (SELECT carrier_id, {_like('i')} * {_like('q')} AS c FROM ia2 JOIN ib2 USING (carrier_id, y, x) JOIN qa2 USING (carrier_id, y, x) JOIN qb2 USING (carrier_id, y, x))")
_k5 = ", ".join(f"({i}, {j}, {(5 - abs(i - 2)) * (5 - abs(j - 2)) / 100}::DOUBLE)" for i in range(5) for j in range(5))
_refl = lambda a: f"CASE WHEN {a} < 0 THEN -{a} WHEN {a} > 31 THEN 62 - {a} ELSE {a} END"
add("correlate_strided", "SELECT o.carrier_id, ((o.y - 1) // 3)::INT AS y, ((o.x - 1) // 3)::INT AS x, round(sum(w * s.v), 6) AS v FROM o JOIN l s ON s.carrier_id = o.carrier_id AND s.y = sy AND s.x = sx GROUP BY 1, 2, 3", _luma("l", "px"), f"o AS (SELECT carrier_id, y, x, {_refl('(y + i - 2)')} AS sy, {_refl('(x + j - 2)')} AS sx, w FROM l, (VALUES {_k5}) AS t(i, j, w) WHERE y % 3 = 1 AND x % 3 = 1)")

# Report
_means = "SELECT category, attack_id, round(avg(ber), 6) AS ber, round(avg(1 - 2 * ber), 6) AS nc, round(avg(CASE WHEN mse > 0 THEN 10e0 * log10(65025e0 / mse) END), 6) AS psnr, count(*) FILTER (mse = 0) AS n_unchanged, count(*) AS n FROM b JOIN q USING (carrier_id, attack_id, category) GROUP BY ROLLUP (category, attack_id)"
_scored = (
    "s AS (SELECT carrier_id, category, attack_id, (y * width + x) * 3 + c AS pos, [r, g, b][c + 1] & 1 AS bit FROM hit JOIN dims USING (carrier_id), (VALUES (0), (1), (2)) AS n(c))",
    "b AS (SELECT carrier_id, category, attack_id, avg(CASE WHEN bit::VARCHAR <> substr(bits, pos::INT + 1, 1) THEN 1e0 ELSE 0e0 END) AS ber FROM s JOIN marks USING (carrier_id) WHERE pos < 128 GROUP BY 1, 2, 3)",
    "q AS (SELECT carrier_id, h.category, h.attack_id, avg((pow(h.r - mp.r, 2) + pow(h.g - mp.g, 2) + pow(h.b - mp.b, 2)) / 3e0) AS mse FROM hit h JOIN mp USING (carrier_id, y, x) GROUP BY 1, 2, 3)",
)
_marked = (MARKS, FLAT.replace(DIMS + ",\n", CENTER + ",\n"), MARKED, MARKED_PX)
add("suite_report", _means, *_marked, f"hit AS ({_suite.format('mp')})", *_scored)
PARTS["kmeans_default"], PARTS["median_cut_default"] = (_quantized(10), tuple(_kmeans(10, 16, 5000))), (_boxed(4)[0], _boxed(4)[1:])
#: The distortions of the report over all, with their default parameters: category and text.
WHOLE = {"block_dct": ("compression", "block_dct"), "brightness_contrast": ("color", "brightness_contrast"), "color_jitter": ("color", "color_jitter"), "color_noise": ("color", "color_noise_ycbcr"), "grayscale": ("color", "grayscale"), "hist_equalize": ("color", "hist_equalize"), "clahe": ("color", "clahe"), "quantize_kmeans": ("color", "kmeans_default"), "quantize_median_cut": ("color", "median_cut_default"), "dither": ("color", "dither_ordered"), "crop_resize": ("geometric", "crop_resize_bilinear")}
_hits = [f"hit_{name} AS MATERIALIZED ({applied(text, 'mp')})" for name, (_, text) in WHOLE.items()]
_all = " UNION ALL ".join([_suite.format("mp"), *(f"SELECT carrier_id, y, x, r, g, b, '{category}', '{name}' FROM hit_{name}" for name, (category, _) in WHOLE.items())])
add("suite_report_all", _means, *_marked[:-1], MARKED_PX.replace("mp AS (", "mp AS MATERIALIZED ("), *_hits, f"hit AS MATERIALIZED ({_all})", *_scored)
