"""Exact cases, errors, and laws of the watermark operators."""

import math
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from inkmark.functions.formulas import KEYS, RGB
from inkmark.operators import crop, dct, detector, embed, histogram, metrics, neighbourhood, ordered, palette, point
from inkmark.plans import suite
from inkmark.sources import carriers
from inkmark.streaming.attacks import attack_stream


def frame(spark, height, width, carrier=1):
    return carriers.synthetic(spark.createDataFrame([(carrier, height, width)], "carrier_id long, height int, width int"))


def pairs(spark, *rows):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "wm_id int, original string, extracted string")


def test_ber_and_nc(spark):
    """Random strings against a count of their differing places."""
    r = random.Random(21)
    rows = []
    for n in (1, 3, 17, 48, 200):
        first = "".join(r.choice("01") for _ in range(n))
        rows += [(first, first), (first, "".join("10"[int(c)] for c in first)), (first, "".join(r.choice("01") for _ in range(n)))]
    shares = [sum(x != y for x, y in zip(a, b, strict=True)) / len(a) for a, b in rows]
    assert [r.ber for r in metrics.ber(pairs(spark, *rows)).orderBy("wm_id").collect()] == shares
    assert [abs(r.nc - (1 - 2 * s)) < 1e-12 for r, s in zip(metrics.nc(pairs(spark, *rows)).orderBy("wm_id").collect(), shares, strict=True)] == [True] * len(rows)


def test_bad_bits_have_no_score(spark):
    bad = pairs(spark, ("1010", "10101"), ("", ""), ("10x1", "1011"), ("10", None))
    got = [(r.status, r.ber) for r in metrics.ber(bad).orderBy("wm_id").collect()]
    assert got == [("length_mismatch", None), ("empty", None), ("not_binary", None), ("empty", None)]
    assert metrics.ber(bad.where("wm_id = 0"), True).first().ber == 0
    with pytest.raises(Exception, match="length_mismatch"):
        metrics.strict(metrics.ber(bad.where("wm_id = 0")), "ber").collect()


def test_embedding_round_trip(spark):
    px = frame(spark, 5, 7)
    mark = spark.createDataFrame([(1, "1011001110001111000011111")], "carrier_id long, bits string")
    flat = embed.lsb_embed(carriers.samples(px), mark)
    assert embed.lsb_extract(flat, 25).first().bits == mark.first().bits
    assert embed.extract_pixels(embed.embed_pixels(px, mark), 25).first().bits == mark.first().bits
    long = mark.withColumn("bits", F.expr("repeat('10', 60)"))
    assert embed.dropped_bits(carriers.samples(px), long).first().bits_dropped == 15
    assert len(embed.extract_pixels(embed.embed_pixels(px, long), 500).first().bits) == 105
    with pytest.raises(Exception, match="not a bit string"):
        embed.embed_pixels(px, mark.withColumn("bits", F.lit("102"))).collect()


ATTACKS = {
    "bit_depth": point.bit_depth,
    "gamma": point.gamma,
    "grayscale": point.grayscale,
    "dither": point.dither,
    "brightness_contrast": point.brightness_contrast,
    "color_jitter": point.color_jitter,
    "color_noise": point.color_noise,
    "hist_equalize": histogram.hist_equalize,
    "quantize_kmeans": lambda px: palette.quantize_kmeans(px, 2, 50, 2),
    "quantize_median_cut": lambda px: palette.quantize_median_cut(px, 4),
    "crop_pad": crop.crop_pad,
    "crop_resize": crop.crop_resize,
    "block_dct": lambda px: dct.block_dct(px, 30),
}


@pytest.mark.parametrize("name", ATTACKS)
def test_distortions_keep_the_contract(spark, name):
    px = frame(spark, 24, 30)
    out = ATTACKS[name](px)
    assert out.columns == [*KEYS, *RGB]
    a, b = out.orderBy(*KEYS).collect(), ATTACKS[name](px.repartition(7)).orderBy(*KEYS).collect()
    assert a == b
    assert len(a) == 720 and all(0 <= v <= 255 for r in a for v in r[3:])
    assert a != px.orderBy(*KEYS).collect()


@pytest.mark.parametrize("size", [(1, 2), (23, 1), (1, 9), (5, 4)])
def test_degenerate_frames(spark, size):
    px = frame(spark, *size)
    for name in ("gamma", "dither", "hist_equalize", "crop_pad", "crop_resize", "block_dct"):
        assert ATTACKS[name](px).count() == size[0] * size[1], name


def test_identities_and_bounds(spark):
    px = frame(spark, 16, 16)
    for same in (point.lossless(px), point.bit_depth(px, 8), point.gamma(px, 1.0), crop.crop_pad(px, 1.0), crop.crop_raw(px, 1.0)):
        assert metrics.lossless_diff(px, same).count() == 0
    assert palette.palette_size(palette.quantize_kmeans(px, 3, 64, 2)).first().n_colors <= 3
    assert palette.palette_size(palette.quantize_median_cut(px, 4)).first().n_colors <= 4
    assert point.dither(px, 3).select("r").distinct().count() <= 3
    worse = [metrics.mse(px, dct.block_dct(px, q)).first().mse for q in (90, 50, 10)]
    assert worse == sorted(worse)


@pytest.mark.parametrize("position", ["top_left", "top_right", "bottom_left", "bottom_right", "center"])
def test_crop_positions(spark, position):
    """A frame of 12 by 20: what is kept touches the sides that the position names, or none."""
    cut = crop.crop_pad(frame(spark, 12, 20).withColumns({c: F.lit(7) for c in RGB}), 0.25, position, (9, 30, 200)).where("g = 7")
    top, left, bottom, right, n = cut.selectExpr("min(y)", "min(x)", "max(y)", "max(x)", "count(*)").first()
    assert (bottom - top + 1, right - left + 1, n) == (3, 5, 15)
    assert [top == 0, bottom == 11, left == 0, right == 19] == [s in position for s in ("top", "bottom", "left", "right")]


@pytest.mark.parametrize(
    "call",
    [
        lambda px: point.bit_depth(px, 12),
        lambda px: point.bit_depth(px, -3),
        lambda px: point.gamma(px, -0.25),
        lambda px: point.dither(px, 0),
        lambda px: point.dither(px, 5, 0),
        lambda px: point.color_noise(px, "CMYK"),
        lambda px: histogram.clahe(px, tiles=0),
        lambda px: histogram.clahe(px, bins=257),
        lambda px: palette.quantize_kmeans(px, 0),
        lambda px: palette.quantize_kmeans(px, 9, 5),
        lambda px: palette.quantize_median_cut(px, 12),
        lambda px: crop.crop_pad(px, -0.2),
        lambda px: crop.crop_raw(px, 1.01),
        lambda px: crop.crop_pad(px, 0.5, "left"),
        lambda px: crop.crop_pad(px, 0.5, "center", (7, 8, 9, 10)),
        lambda px: crop.crop_pad(px, 0.5, "center", -1),
        lambda px: crop.crop_resize(px, resample="cubic"),
        lambda px: dct.block_dct(px, 101),
    ],
)
def test_bad_parameters(spark, call):
    with pytest.raises(ValueError):
        call(frame(spark, 4, 4))


def test_detector(spark):
    """Random detections with ties, against direct counts and all pairs."""
    r = random.Random(33)
    rows = [(f"d{k}", i, int(r.random() < 0.4), int(r.random() < 0.5), r.randint(0, 12) / 4) for k in range(3) for i in range(70)]
    d = spark.createDataFrame(rows, "detector_id string, sample_id int, y_true int, y_pred int, y_score double").repartition(5)
    ranks = {(x.detector_id, x.sample_id): x["rank"] for x in detector.avg_ranks(d, "detector_id", "y_score").collect()}
    aucs = {x.detector_id: x.auc for x in detector.auc(d).collect()}
    for s in detector.scores(d).collect():
        own = [x for x in rows if x[0] == s.detector_id]
        tp, tn, fp, fn = (sum(x[2] == t and x[3] == p for x in own) for t, p in ((1, 1), (0, 0), (0, 1), (1, 0)))
        assert (s.tp, s.tn, s.fp, s.fn) == (tp, tn, fp, fn)
        expected = ((tp + tn) / 70, tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn))
        assert all(abs(a - b) < 1e-12 for a, b in zip((s.accuracy, s.precision, s.recall, s.f1), expected, strict=True))
        won = [(a[4] > b[4]) + (a[4] == b[4]) / 2 for a in own if a[2] for b in own if not b[2]]
        assert abs(aucs[s.detector_id] - sum(won) / len(won)) < 1e-12
        for x in own:
            assert ranks[x[0], x[1]] == sum(y[4] < x[4] for y in own) + (sum(y[4] == x[4] for y in own) + 1) / 2
    assert {x.auc for x in detector.auc(d.withColumn("y_score", F.lit(1.0))).collect()} == {0.5}
    assert all(math.isnan(x.auc) for x in detector.auc(d.where("y_true = 1")).collect())
    nothing = detector.scores(d.withColumns({"y_true": F.lit(0), "y_pred": F.lit(0)})).first()
    assert (nothing.precision, nothing.recall, nothing.f1) == (0, 0, 0)


def test_running_sums(spark):
    rows = [(k % 3 if k % 7 else None, (k * 37) % 101, k) for k in range(300)]
    df = spark.createDataFrame(rows, "g int, o int, k int").repartition(6)
    for x in ordered.running(df, "g", ["o", "k"], F.col("k"), "before").collect():
        assert x.before == sum(k for g, o, k in rows if g == x.g and (o, k) < (x.o, x.k))


def test_an_incomplete_carrier_is_padded(spark):
    vectors = spark.createDataFrame([(i, [0.0] * 64) for i in range(50)], "vec_id long, embedding array<float>")
    px = carriers.mosaic(vectors)
    assert px.count() == 2 * 1024 and px.where("carrier_id = 0 and r = 128 and g = 128 and b = 128").count() == 1024
    assert px.where("carrier_id = 1 and r = 128").count() == px.where("carrier_id = 1 and g = 128").count() == 64 and px.where("carrier_id = 1 and b > 0").count() == 0


def test_positions_beyond_32_bits(spark):
    px = spark.createDataFrame([(1, 0, 0, 2, 2, 2), (1, 49_999, 49_999, 2, 2, 2)], "carrier_id long, y int, x int, r int, g int, b int")
    mark = spark.createDataFrame([(1, "111")], "carrier_id long, bits string")
    assert [tuple(r)[3:] for r in embed.embed_pixels(px, mark).orderBy("y").collect()] == [(3, 3, 3), (2, 2, 2)]
    assert embed.extract_pixels(embed.embed_pixels(px, mark), 3).first().bits == "111"


@pytest.mark.parametrize("n", [1, 10, 1000])
def test_p_value(spark, n):
    null = spark.range(n).select(F.lit(0.0).alias("value"))
    at = lambda v: detector.p_value(spark.createDataFrame([(v,)], "value double"), null).first().p_value
    assert at(1e9) == 1 / (n + 1) and at(-1e9) == 1 and at(0.0) == 1
    assert math.isnan(detector.p_value(spark.createDataFrame([(1.0,)], "value double"), null.limit(0)).first().p_value)


def test_identical_images(spark):
    px = frame(spark, 24, 24)
    l = neighbourhood.luma_plane(px)  # noqa: E741
    assert metrics.mse(px, px).first().mse == 0 and metrics.psnr(px, px).first().psnr == math.inf
    assert abs(neighbourhood.ssim(l, l).first().ssim - 1) < 1e-12
    assert abs(neighbourhood.gradient_similarity(l, l).first().similarity - 1) < 1e-12
    tiny = neighbourhood.luma_plane(frame(spark, 10, 10))
    assert tuple(neighbourhood.ssim(tiny, tiny).first()) == tuple(neighbourhood.ms_ssim(l, l).first()) == (1, None, "too_small")
    noisy = [neighbourhood.ssim(l, neighbourhood.luma_plane(point.color_noise(px, noise_std=s))).first().ssim for s in (2.0, 8.0, 40.0)]
    assert noisy == sorted(noisy, reverse=True)
    with pytest.raises(Exception, match="differ in size"):
        metrics.mse(px, frame(spark, 24, 23)).collect()


def test_suite(spark):
    px = frame(spark, 16, 16)
    mark = spark.createDataFrame([(1, "10" * 40)], "carrier_id long, bits string")
    report = {r.attack_id: r for r in suite.robustness(px, mark, 80, suite.BASIC).collect()}
    assert report["lossless"].ber == 0 and report["lossless"].psnr == math.inf
    assert all(report[n].ber > 0 for n in ("bit_depth", "gamma", "crop_pad"))


def png(path, rgb, width, height):
    raw = b"".join(b"\0" + bytes(v for p in rgb[y * width : (y + 1) * width] for v in p) for y in range(height))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    rgb = [(i, 2 * i, 255 - i) for i in range(6)]
    png(tmp_path / "b.PNG", rgb, 3, 2)
    png(tmp_path / "deep/a.png", rgb, 3, 2)
    (tmp_path / "notes.txt").write_text("x")
    assert carriers.list_carriers(spark, str(tmp_path)).count() == 2
    assert carriers.list_carriers(spark, str(tmp_path), recursive=False).count() == 1
    got = carriers.read_images(spark, str(tmp_path / "deep")).orderBy("y", "x").collect()
    assert [(r.r, r.g, r.b) for r in got] == rgb
    tagged = frame(spark, 3, 3).withColumn("attack_id", F.lit("a"))
    assert carriers.write_pixels(tagged, str(tmp_path / "out")).exceptAll(tagged).count() == 0


def test_stream(spark, tmp_path):
    px = frame(spark, 4, 4)
    px.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(px.schema).parquet(str(tmp_path / "in"))
    attack_stream(stream, point.gamma, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).exceptAll(point.gamma(px)).count() == 0


def test_arrays(spark):
    df = spark.sql("select 1L as carrier_id, array(array(array(-5.0, 0.5, 300.0), array(1.5, 2.5, 3.5))) as matrix")
    assert [tuple(r) for r in carriers.pixels_from_arrays(df).orderBy("x").collect()] == [(1, 0, 0, 0, 0, 255), (1, 0, 1, 2, 2, 4)]


def test_report_stores_scores_and_calls_each_distortion_once(spark):
    """The last plan reads rows of scores, not pixels through all distortions (1.4 million characters of plan before)."""
    px = frame(spark, 24, 20)
    marks = spark.createDataFrame([(1, "01" * 64)], "carrier_id long, bits string")
    called = []

    def once(pixels, colors=4):
        called.append(colors)
        return palette.quantize_kmeans(pixels, colors, 50, 2)

    attacks = {"lossless": ("compression", point.lossless), "kmeans": ("color", once), "clahe": ("color", histogram.clahe), "crop_pad": ("geometric", crop.crop_pad), "crop_resize": ("geometric", crop.crop_resize)}
    scored = suite.robustness(px, marks, 128, attacks)
    assert not [f for f in scored.inputFiles() if "/marked-" in f] and called == [4]
    got = {r.attack_id: (r.ber, r.psnr) for r in scored.collect()}
    marked = embed.embed_pixels(px, marks)
    for name, (_, attack) in attacks.items():
        hit = attack(marked)
        wrong = metrics.ber(marks.withColumnRenamed("bits", "original").join(embed.extract_pixels(hit, 128).withColumnRenamed("bits", "extracted"), "carrier_id")).first().ber
        assert got[name] == (wrong, metrics.psnr(marked, hit).first().psnr)


@pytest.mark.parametrize("size", [(24, 20), (9, 3)])
def test_clahe_joins_pixels_with_maps_once_in_any_number_of_parts(spark, monkeypatch, size):
    px = frame(spark, *size)
    whole = {tuple(r) for r in histogram.clahe(px).collect()}
    plan = histogram.clahe(px)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 4 and "strategy=merge" in plan  # seven before: maps are joined once, and never broadcast
    monkeypatch.setattr(histogram, "PART", 50)
    assert {tuple(r) for r in histogram.clahe(px).collect()} == whole and len(whole) == size[0] * size[1]


def test_scales_of_tiles_are_those_of_whole_frames(spark, monkeypatch):
    """One shuffle of pixels, the means at all scales those of the whole frame in any cut, and nothing stored."""
    import numpy as np

    px = frame(spark, 190, 215)
    a, b = neighbourhood.luma_plane(px), neighbourhood.luma_plane(point.color_noise(px, noise_std=20.0))
    whole = {r.k: r.mean for r in neighbourhood._scale_means(a, b, 5).collect()}
    plane = a
    other = b
    for k in range(2):  # the windows' form
        name = "cs"
        assert abs(neighbourhood.ssim_map(plane, other).agg(F.avg(name)).first()[0] - whole[k]) < 1e-12
        plane, other = neighbourhood.downsample2(plane), neighbourhood.downsample2(other)
    monkeypatch.setattr(neighbourhood, "SIDE", 176)  # closures carry the module's values by reference
    import pyarrow as pa

    rows = a.collect(), b.collect()
    batches = [pa.RecordBatch.from_pydict({"carrier_id": [1] * len(r), "y": pa.array([x.y for x in r], pa.int32()), "x": pa.array([x.x for x in r], pa.int32()), "v": [x.v for x in r], "side": pa.array([i] * len(r), pa.int32())}) for i, r in enumerate(rows)]
    packed = pa.Table.from_batches(neighbourhood._packed(iter(batches)))
    tiles = {}
    for i, at in enumerate(zip(packed["ty"].to_pylist(), packed["tx"].to_pylist(), strict=True)):
        tiles.setdefault(at, []).append(i)
    assert len(tiles) == 4
    sums = np.zeros((5, 2))
    for own in tiles.values():
        t = neighbourhood._tile_sums(packed.take(pa.array(own)), 5)
        sums += np.column_stack([t["total"].to_numpy(), t["n"].to_numpy()])
    assert np.allclose(sums[:, 0] / sums[:, 1], [whole[k] for k in range(5)], rtol=0, atol=1e-12)
    plan = neighbourhood.ms_ssim(a, b)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan  # a join and eighteen windows before
    with pytest.raises(Exception, match="differ in size"):
        neighbourhood.ms_ssim(a, neighbourhood.luma_plane(frame(spark, 190, 214))).collect()
