"""Oriented bands, window sums, mixture parameters and fidelity against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkmark.functions.formulas import KEYS
from inkmark.operators import fidelity, neighbourhood, pyramid


def plane(spark, *frames, first=0):
    rows = [(first + i, y, x, float(v)) for i, f in enumerate(frames) for y, row in enumerate(f) for x, v in enumerate(row)]
    return spark.createDataFrame(rows, "carrier_id long, y int, x int, v double").repartition(3)


def array(df, column, where="true"):
    p = df.where(where).toPandas()
    out = np.full((p.y.max() + 1, p.x.max() + 1), np.nan)
    out[p.y, p.x] = p[column]
    return out


def correlated(image, kernel, step=1, start=0, mode="reflect"):
    k = np.asarray(kernel)
    padded = np.pad(image, [(n // 2, (n - 1) // 2) for n in k.shape], mode=mode)
    near = np.lib.stride_tricks.sliding_window_view(padded, k.shape)
    return np.einsum("ijkl,kl->ij", near, k)[start::step, start::step]


def picture(h, w, seed):
    r = np.random.default_rng(seed)
    y, x = np.mgrid[0:h, 0:w]
    return np.clip(100 + 60 * np.sin(y / 5) * np.cos(x / 7) + 30 * ((x // 9) % 2) + r.normal(0, 8, (h, w)), 0, 255)


@pytest.mark.parametrize(("edge", "mode"), [("reflect", "reflect"), ("symmetric", "symmetric")])
def test_correlation_at_every_edge(spark, edge, mode):
    """Kernels of any shape, frames smaller than the kernel, steps; two windows, nothing is exploded."""
    r = np.random.default_rng(2)
    for (h, w), (kh, kw), step, start in [((9, 11), (5, 3), 1, 0), ((8, 7), (4, 4), 3, 1), ((2, 5), (7, 5), 1, 0), ((1, 1), (3, 3), 1, 0), ((3, 1), (1, 5), 2, 0)]:
        image, kernel = r.normal(0, 9, (h, w)), r.normal(0, 1, (kh, kw))
        found = neighbourhood.correlate(plane(spark, image), kernel.tolist(), step, start, edge)
        assert np.abs(array(found, "v") - correlated(image, kernel, step, start, mode)).max() < 1e-9
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Window [") == 2 and "Generate" not in plan


def test_filters_follow_from_the_rule():
    """No band passes what is flat, orientations are turns of one filter, and their energies add up to about 1."""
    kernels = [np.array(pyramid.kernel(k)) for k in range(6)]
    assert all(abs(k.sum()) < 1e-12 and np.allclose(k, -k[::-1, ::-1]) for k in kernels)
    assert np.allclose(np.rot90(kernels[0], -1), kernels[3], atol=1e-12) or np.allclose(np.rot90(kernels[0]), kernels[3], atol=1e-12)
    assert np.isclose(sum(pyramid.bell(9, 0.7)), 1) and max(abs(np.array(pyramid.bell(9, 0.7, 3)) + np.array(pyramid.bell(9, 0.7, 3))[::-1])) < 1e-12
    w = np.pi / 2
    y, x = np.mgrid[-3:4, -3:4]
    for angle in (0, np.pi / 2):
        energy = sum(abs((k * np.exp(1j * w * (x * np.cos(angle) + y * np.sin(angle)))).sum()) ** 2 for k in kernels)
        assert abs(energy - 1) < 0.05  # seven taps cut the bell off


def test_an_impulse_gives_the_filter(spark):
    image = np.zeros((21, 24))
    image[10, 12] = 1
    first = np.outer(*[pyramid.bell(pyramid.FIRST_TAPS, pyramid.FIRST_SPREAD)] * 2)
    low = correlated(image, first)
    smooth = np.outer(*[pyramid.bell(pyramid.LOW_TAPS, pyramid.LOW_SPREAD)] * 2)
    for s, scale in enumerate(pyramid.oriented_subbands(plane(spark, image), 3)):
        for k in range(6):
            assert np.abs(array(scale, f"v_{k}") - correlated(low, pyramid.kernel(k))).max() < 1e-12, (s, k)
        low = correlated(low, smooth, 2)


@pytest.mark.parametrize(("edge", "side", "step"), [("reflect", 5, 3), ("reflect", 17, 3), ("inside", 3, 2), ("inside", 7, 1), ("reflect", 1, 1)])
def test_window_sums(spark, edge, side, step):
    """Equal to sums one by one to the last digits, where next to nothing lies beside large values too."""
    image = np.random.default_rng(3).normal(0, 1, (19, 22)) * np.where(np.arange(22) < 12, 1e6, 1e-9)
    found = array(fidelity.window_sums(plane(spark, image), ["v"], side, step, edge), "v")
    whole, start, h = correlated(image, np.ones((side, side))), step // 2, side // 2
    expected = whole[start::step, start::step]
    if edge == "inside":
        y, x = (np.arange(n)[start::step] for n in whole.shape)
        for n, v, axis in ((19, y, 0), (22, x, 1)):
            expected = np.where(np.expand_dims((v >= h) & (v + h < n), 1 - axis), expected, np.nan)
        found = np.pad(found, [(0, n - m) for n, m in zip(expected.shape, found.shape, strict=True)], constant_values=np.nan)
    assert (np.isnan(found) == np.isnan(expected)).all()
    scale = correlated(np.abs(image), np.ones((side, side)))[start::step, start::step]
    assert np.nanmax(np.abs(found - expected) / scale) < 1e-12


def channel(a, b, side, block=3, least=1e-15):
    """The rules of the estimate one after the other, block by block."""
    h, w = (n // block * block for n in a.shape)
    mean = lambda v: correlated(v[:h, :w], np.full((side, side), 1 / side**2), block, block // 2)[: h // block, : w // block]
    n = side * side
    va, vb = (np.maximum(n * (mean(v * v) - mean(v) ** 2), 0) for v in (a, b))
    c = n * (mean(a * b) - mean(a) * mean(b))
    gain = c / (va + least)
    noise = (vb - gain * c) / n
    for rule, g, s in ((va < least, 0, vb), (vb < least, 0, np.zeros_like(vb)), (None, 0, vb)):
        rule = gain < 0 if rule is None else rule
        gain, noise = np.where(rule, g, gain), np.where(rule, s, noise)
    return gain, np.where(noise <= least, least, noise)


@pytest.mark.parametrize("side", [3, 9])
def test_gain_and_noise(spark, side):
    r = np.random.default_rng(4)
    a = r.normal(0, 5, (32, 29))
    b = 0.6 * a + r.normal(0, 1, a.shape)
    a[:12, :12] = 0  # no variance here
    b[18:, :10] = 0  # nor here
    b[:, 20:] *= -1  # the gain is negative
    both = plane(spark, a).withColumnRenamed("v", "a").join(plane(spark, b).withColumnRenamed("v", "b"), list(KEYS))
    found = fidelity.vifsub_est(both, side)
    for got, own in zip((array(found, "gain_a"), array(found, "noise_a")), channel(a, b, side), strict=True):
        assert np.allclose(got, own, rtol=1e-9, atol=1e-9)
    assert array(found, "gain_a").min() == 0


def mixture(v, block=3):
    h, w = (n // block * block for n in v.shape)
    v = v[:h, :w]
    c = np.cov(np.lib.stride_tricks.sliding_window_view(v, (block, block)).reshape(-1, block**2), rowvar=False, bias=True)
    cells = v.reshape(h // block, block, w // block, block).transpose(0, 2, 1, 3).reshape(h // block, w // block, block**2)
    return np.einsum("ijk,kl,ijl->ij", cells, np.linalg.inv(c), cells) / block**2, np.linalg.eigvalsh(c)[::-1]


def test_mixture_parameters(spark):
    """Of several frames at once; a flat band has neither."""
    r = np.random.default_rng(6)
    frames = [picture(29, 32, 1) - 100, r.normal(0, 3, (29, 32)).cumsum(1), np.zeros((29, 32))]
    own = plane(spark, *frames).withColumnRenamed("v", "v_0").withColumn("v_3", F.col("v_0") * 2 + F.col("x"))
    multiplier, values = fidelity.refparams_vecgsm([own])
    rows = values.toPandas()
    for i, f in enumerate(frames[:2]):
        for k, band in ((0, f), (3, f * 2 + np.arange(32))):
            m, e = mixture(band)
            assert np.allclose(array(multiplier, "multiplier", f"carrier_id = {i} and orientation = {k}"), m, rtol=1e-7)
            assert np.allclose(rows[(rows.carrier_id == i) & (rows.orientation == k)].eigenvalues.iloc[0], e, rtol=1e-8)
    assert rows[(rows.carrier_id == 2) & (rows.orientation == 0)].eigenvalues.iloc[0] is None
    assert multiplier.where("carrier_id = 2 and orientation = 0 and multiplier is not null").count() == 0


def fidelity_of(a, b):
    def bands(v):
        low, out = correlated(v, np.outer(*[pyramid.bell(5, pyramid.FIRST_SPREAD)] * 2)), []
        for _ in range(4):
            out.append([correlated(low, pyramid.kernel(k)) for k in (0, 3)])
            low = correlated(low, np.outer(*[pyramid.bell(9, pyramid.LOW_SPREAD)] * 2), 2)
        return out

    top = bottom = 0.0
    for s, (xs, ys) in enumerate(zip(bands(a), bands(b), strict=True)):
        side = 2 ** (4 - s) + 1
        off = -(-(side // 2) // 3)
        for x, y in zip(xs, ys, strict=True):
            m, e = mixture(x)
            g, n, m = (v[off:-off, off:-off] for v in (*channel(x, y, side), m))
            top += sum(np.log2(1 + g * g * m * v / (n + 0.4)).sum() for v in e)
            bottom += sum(np.log2(1 + m * v / 0.4).sum() for v in e)
    return top / bottom


def test_fidelity(spark):
    """1 for equal frames, falling with noise, equal to numpy; sides of all remainders; no value for small and flat ones."""
    r = np.random.default_rng(9)
    a = picture(75, 80, 7)
    ladder = [a, *[np.clip(a + r.normal(0, s, a.shape), 0, 255) for s in (2, 8, 20, 40)]]
    flat, small = np.full((72, 72), 9.0), picture(71, 90, 3)
    first = plane(spark, *[a] * 5, flat, small)
    second = plane(spark, *ladder, flat + 1, small)
    found = {x.carrier_id: x for x in fidelity.vif(first, second).collect()}
    values = [found[i].vif for i in range(5)]
    assert abs(values[0] - 1) < 1e-9 and all(p > q for p, q in zip(values, values[1:], strict=False))
    assert all(abs(v - fidelity_of(a, b)) < 1e-7 for v, b in zip(values, ladder, strict=True))
    assert [(found[i].vif, found[i].status) for i in (5, 6)] == [(None, "flat"), (None, "too_small")]
    assert fidelity.vif(first.limit(0), second.limit(0)).count() == 0


def test_bad_parameters(spark):
    p = plane(spark, np.ones((4, 4)))
    for call in (lambda: fidelity.vif(p, p, block=0), lambda: fidelity.vif(p, p, sigma=0.0), lambda: fidelity.window_sums(p, ["v"], 3, edge="wrap"), lambda: neighbourhood.correlate(p, [[1]], edge="zero")):
        with pytest.raises(ValueError, match=r"must be|unknown"):
            call()
