"""Row-local formulas over levels, as SQL expressions that Spark and the SQL of the tests both read.

`half_even` is the engine's name for rounding half to even. Numbers carry an exponent so that they are doubles.
"""

from __future__ import annotations

SPARK, DUCKDB = "bround", "round_even"
KEYS = ("carrier_id", "y", "x")
RGB = ("r", "g", "b")


def level(e: str, half_even: str = SPARK) -> str:
    """Clipped to 0..255 and rounded half to even: the boundary rule of every distortion."""
    return f"cast({half_even}(least(greatest(cast({e} as double), 0e0), 255e0), 0) as int)"


def luma(r: str = "r", g: str = "g", b: str = "b") -> str:
    return f"(0.299e0 * {r} + 0.587e0 * {g} + 0.114e0 * {b})"


def yiq_i(r: str = "r", g: str = "g", b: str = "b") -> str:
    return f"(0.596e0 * {r} - 0.274e0 * {g} - 0.322e0 * {b})"


def yiq_q(r: str = "r", g: str = "g", b: str = "b") -> str:
    return f"(0.211e0 * {r} - 0.523e0 * {g} + 0.312e0 * {b})"


def to_ycbcr(half_even: str = SPARK) -> dict[str, str]:
    return {
        "y_": level(luma(), half_even),
        "cb": level("128e0 - 0.168736e0 * r - 0.331264e0 * g + 0.5e0 * b", half_even),
        "cr": level("128e0 + 0.5e0 * r - 0.418688e0 * g - 0.081312e0 * b", half_even),
    }


def from_ycbcr(y: str, cb: str, cr: str, half_even: str = SPARK) -> dict[str, str]:
    return {
        "r": level(f"{y} + 1.402e0 * ({cr} - 128e0)", half_even),
        "g": level(f"{y} - 0.344136e0 * ({cb} - 128e0) - 0.714136e0 * ({cr} - 128e0)", half_even),
        "b": level(f"{y} + 1.772e0 * ({cb} - 128e0)", half_even),
    }


def to_hsv(half_even: str = SPARK) -> dict[str, str]:
    """Hue, saturation and value, each 0..255."""
    top, low = "greatest(r, g, b)", "least(r, g, b)"
    d = f"cast({top} - {low} as double)"
    turn = f"(case when {top} = {low} then 0e0 when {top} = r then (g - b) / {d} when {top} = g then 2e0 + (b - r) / {d} else 4e0 + (r - g) / {d} end)"
    return {
        "h": level(f"255e0 * ((case when {turn} < 0e0 then {turn} + 6e0 else {turn} end) / 6e0)", half_even),
        "s": level(f"case when {top} = 0 then 0e0 else 255e0 * {d} / {top} end", half_even),
        "v": top,
    }


def from_hsv(h: str, s: str, v: str, half_even: str = SPARK) -> dict[str, str]:
    sixth = f"({h} * 6e0 / 255e0)"
    i = f"(cast(floor({sixth}) as int) % 6)"
    f = f"({sixth} - floor({sixth}))"
    p, q, t = f"{v} * (1e0 - {s} / 255e0)", f"{v} * (1e0 - {f} * {s} / 255e0)", f"{v} * (1e0 - (1e0 - {f}) * {s} / 255e0)"
    at = {"r": (v, q, p, p, t, v), "g": (t, v, v, q, p, p), "b": (p, p, t, v, v, q)}
    return {c: level(f"case {i} " + " ".join(f"when {k} then {e}" for k, e in enumerate(x)) + " end", half_even) for c, x in at.items()}


def to_lab(half_even: str = SPARK) -> dict[str, str]:
    """CIE L*a*b* of sRGB under D65, scaled to levels: L by 2.55, a and b moved by 128."""

    def linear(c: str) -> str:
        return f"(case when {c} <= 10 then {c} / 255e0 / 12.92e0 else pow(({c} / 255e0 + 0.055e0) / 1.055e0, 2.4e0) end)"

    r, g, b = map(linear, RGB)

    def f(e: str) -> str:
        return f"(case when {e} > 0.008856451679e0 then pow({e}, 1e0 / 3e0) else 7.787037037037e0 * {e} + 16e0 / 116e0 end)"

    x = f(f"((0.4124564e0 * {r} + 0.3575761e0 * {g} + 0.1804375e0 * {b}) / 0.95047e0)")
    y = f(f"(0.2126729e0 * {r} + 0.7151522e0 * {g} + 0.0721750e0 * {b})")
    z = f(f"((0.0193339e0 * {r} + 0.1191920e0 * {g} + 0.9503041e0 * {b}) / 1.08883e0)")
    return {"l": level(f"2.55e0 * (116e0 * {y} - 16e0)", half_even), "a": level(f"500e0 * ({x} - {y}) + 128e0", half_even), "b_": level(f"200e0 * ({y} - {z}) + 128e0", half_even)}


def from_lab(l_: str, a: str, b: str, half_even: str = SPARK) -> dict[str, str]:
    y = f"(({l_} / 2.55e0 + 16e0) / 116e0)"
    x, z = f"({y} + ({a} - 128e0) / 500e0)", f"({y} - ({b} - 128e0) / 200e0)"

    def back(e: str, white: str) -> str:
        return f"({white} * (case when {e} > 0.206896551724e0 then {e} * {e} * {e} else ({e} - 16e0 / 116e0) / 7.787037037037e0 end))"

    x, y, z = back(x, "0.95047e0"), back(y, "1e0"), back(z, "1.08883e0")
    rows = {"r": f"(3.2404542e0 * {x} - 1.5371385e0 * {y} - 0.4985314e0 * {z})", "g": f"(-0.9692660e0 * {x} + 1.8760108e0 * {y} + 0.0415560e0 * {z})", "b": f"(0.0556434e0 * {x} - 0.2040259e0 * {y} + 1.0572252e0 * {z})"}
    return {c: level(f"255e0 * (case when {e} <= 0.0031308e0 then 12.92e0 * {e} else 1.055e0 * pow(greatest({e}, 0e0), 1e0 / 2.4e0) - 0.055e0 end)", half_even) for c, e in rows.items()}


def uniform(key: str, half_even: str = SPARK) -> str:
    """0 to 1, from the first 32 bits of the MD5 of a text: independent of order and partitioning."""
    if half_even == SPARK:
        return f"(cast(conv(substr(md5({key}), 1, 8), 16, 10) as double) / 4294967296e0)"
    return f"(cast(cast('0x' || substr(md5({key}), 1, 8) as bigint) as double) / 4294967296e0)"
