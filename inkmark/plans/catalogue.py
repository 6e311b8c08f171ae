"""All registered queries of the watermark operators: carriers are laid out from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmark.functions import formulas as f
from inkmark.functions.formulas import KEYS, RGB, level
from inkmark.operators import crop, dct, detector, embed, fidelity, histogram, metrics, neighbourhood, palette, point, pyramid, tiles
from inkmark.plans import suite
from inkmark.plans.oracle_bands import ORACLE_SQL
from inkmark.sources import carriers, files
from inkmark.sources.scratch import new_folder, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
N_BITS = 128

__all__ = ["ORACLE_SQL", "QUERIES"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carriers.mosaic(_table(spark, sf_dir, "embeddings"))


def marks(spark: SparkSession, sf_dir: str, px: DataFrame) -> DataFrame:
    """A mark for each carrier: that of the item whose id is the carrier's, modulo the number of items."""
    return _marked(spark, sf_dir, px.select("carrier_id").distinct()).select("carrier_id", "wm_id", "bits")


def _marked(spark: SparkSession, sf_dir: str, own: DataFrame) -> DataFrame:
    items = _table(spark, sf_dir, "benchmark").select("item_id")
    number = max(1, items.count())
    return own.withColumn("wm_id", F.col("carrier_id") % number).join(carriers.marks(items, N_BITS), "wm_id", "left")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detector a language: toxic documents, called by low quality, scored by length."""
    both = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return both.select(F.col("lang").alias("detector_id"), F.col("doc_id").alias("sample_id"), F.col("toxic").alias("y_true"), (1 - F.col("quality")).alias("y_pred"), F.col("n_chars").cast("double").alias("y_score"))


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if c in names else F.col(c) for c in df.columns])  # no -0.0


def query(function: Callable[[DataFrame], DataFrame], name: str) -> None:
    """Registers a query of the carriers' pixels."""
    QUERIES[name] = lambda spark, sf_dir: function(pixels(spark, sf_dir))


def _distorted(px: DataFrame) -> DataFrame:
    return point.gamma(px, 1.5)


def _luma_pair(px: DataFrame) -> tuple[DataFrame, DataFrame]:
    return neighbourhood.luma_plane(px), neighbourhood.luma_plane(_distorted(px))


def _named(px: DataFrame, formulas: dict[str, str]) -> DataFrame:
    return px.select(*KEYS, *[F.expr(e).alias(n) for n, e in formulas.items()])


# Sources
def pixels_from_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a frame of 8 * 8, with its values, their complement, and their half."""
    value = "(double(embedding[8 * i + j]) + 1e0) * 127.5e0"
    matrix = f"transform(sequence(0, 7), i -> transform(sequence(0, 7), j -> array({value}, 255e0 - {value}, {value} / 2e0)))"
    return carriers.pixels_from_arrays(_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("carrier_id"), F.expr(matrix).alias("matrix")))


QUERIES["pixels_from_arrays"] = pixels_from_arrays
query(lambda px: carriers.synthetic(px.select("carrier_id").distinct().withColumns({"height": F.lit(24), "width": F.lit(20)})), "synthetic_carriers")
query(carriers.sizes, "carrier_sizes")
query(carriers.samples, "flat_samples")


def write_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = suite.attack_suite(pixels(spark, sf_dir), {"bit_depth": ("color", point.bit_depth), "lossless": ("compression", point.lossless)})
    return carriers.write_pixels(px.select(*KEYS, *RGB, "attack_id"), new_folder(spark, "pixels"))


def carrier_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mosaics as image files in strips of twelve rows, read again in splits of a few rows."""
    path = new_folder(spark, "images")
    files.write_carriers(pixels(spark, sf_dir), path, strip=12)
    return files.read_carriers(spark, path, split=4096).select(*KEYS, *RGB)


def carrier_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and bytes of the files that hold the mosaics."""
    path = new_folder(spark, "images")
    files.write_carriers(pixels(spark, sf_dir), path, strip=12)
    return carriers.list_carriers(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


QUERIES["write_pixels"], QUERIES["carrier_files"], QUERIES["carrier_listing"] = write_pixels, carrier_files, carrier_listing

# Colours
query(lambda px: px.select(*KEYS, F.expr(level("r * 1.37e0 - g * 0.5e0")).alias("level")), "to_level")
query(lambda px: _rounded(neighbourhood.luma_plane(px), "v"), "luma")
query(lambda px: _rounded(_named(px, {"l": f.luma(), "i": f.yiq_i(), "q": f.yiq_q()}), "l", "i", "q"), "yiq")
query(lambda px: _named(px, f.to_hsv()), "rgb_hsv")
query(lambda px: _named(px, f.to_ycbcr()), "rgb_ycbcr")
query(lambda px: _named(px, f.to_lab()), "rgb_lab")
query(lambda px: _named(_named(px, f.to_hsv()), f.from_hsv("h", "s", "v")), "hsv_rgb")
query(lambda px: _named(_named(px, f.to_ycbcr()), f.from_ycbcr("y_", "cb", "cr")), "ycbcr_rgb")


# Embedding
def lsb_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir)
    return embed.lsb_embed(carriers.samples(px), marks(spark, sf_dir, px))


def lsb_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir)
    return embed.extract_pixels(embed.embed_pixels(px, marks(spark, sf_dir, px)), N_BITS)


def _prices(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.expr("cast(round(l_extendedprice * 100) as bigint)").alias("cents"))
    own = rows.select(F.col("l_suppkey").alias("carrier_id")).distinct()
    return rows, _marked(spark, sf_dir, own).select("carrier_id", "bits")


def lsb_embed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, own = _prices(spark, sf_dir)
    return embed.lsb_embed_table(rows, own, "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey", "cents"], "cents")


def embed_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir)
    own = marks(spark, sf_dir, px)
    return embed.embed_suite(px, {"whole": own, "half": own.withColumn("bits", F.left("bits", F.lit(64)))})


def dropped_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, own = _prices(spark, sf_dir)
    return embed.dropped_bits(rows.select(F.col("l_suppkey").alias("carrier_id")), own.withColumn("bits", F.expr("repeat(bits, 6)")))


for _f in (lsb_embed, lsb_extract, lsb_embed_table, embed_suite, dropped_bits):
    QUERIES[_f.__name__] = _f

# Distortions
query(point.bit_depth, "bit_depth")
query(point.gamma, "gamma")
query(point.gamma_by_join, "gamma_lut_join")
query(point.grayscale, "grayscale")
query(point.dither, "dither_ordered")
query(lambda px: point.dither(px, 4, 8), "dither_ordered_8")
query(point.brightness_contrast, "brightness_contrast")
query(point.color_jitter, "color_jitter")
for _space in point.SPACES:
    query(lambda px, s=_space: point.color_noise(px, s), f"color_noise_{_space.lower()}")
query(histogram.level_histogram, "level_histogram")
query(histogram.hist_equalize, "hist_equalize")
query(histogram.clahe, "clahe")
query(lambda px: palette.pixel_sample(px, 50), "pixel_sample")
query(lambda px: palette.quantize_kmeans(px, 2, 200, 3), "quantize_kmeans")
query(lambda px: palette.quantize_median_cut(px, 4), "quantize_median_cut")
query(palette.palette_size, "palette_size")
query(lambda px: crop.crop_pad(px, 0.5, "center", (255, 0, 255)), "crop_pad")
query(lambda px: crop.crop_raw(px, 0.6, "bottom_right"), "crop_raw")
query(lambda px: crop.crop_pad(px, 0.5, "random", seed=3), "crop_random")
for _filter in ("nearest", *crop.RESAMPLE):
    query(lambda px, r=_filter: crop.crop_resize(px, 0.5, "center", r), f"crop_resize_{_filter}")
query(dct.block_dct, "block_dct")
query(suite.attack_suite, "attack_suite")
query(lambda px: suite.attack_chain(px, point.bit_depth, point.gamma, crop.crop_pad), "attack_chain")
query(lambda px: suite.param_sweep(px, point.gamma, [0.5, 1.0, 2.0]), "param_sweep")
query(lambda px: suite.lut_sweep(px, point.gamma_table, [0.4, 0.8, 1.6, 3.2]), "lut_sweep")
query(lambda px: metrics.lossless_diff(px, point.lossless(px)), "lossless_diff")


def _mirrored(frame):
    return frame.assign(x=frame["x"].max() - frame["x"])


query(lambda px: suite.custom_attack(px, _mirrored), "custom_attack")

def _softened(levels):
    """Means of three by three, nearer pixels weighing more, of an array."""
    for axis in (0, 1):
        before, after = (levels.take(range(levels.shape[axis]), axis).copy() for _ in range(2))
        if axis == 0:
            before[1:], after[:-1] = levels[:-1], levels[1:]
        else:
            before[:, 1:], after[:, :-1] = levels[:, :-1], levels[:, 1:]
        levels = (before + 2 * levels + after) / 4
    return levels


query(lambda px: tiles.tiled_attack(px, _softened, tile=12, halo=1), "tiled_attack")


def palette_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of each carrier, and of all, over several distortions: whether sketches of each carrier and distortion,
    merged, come within four standard errors of the exact number."""
    px = suite.attack_suite(pixels(spark, sf_dir))
    parts = stored(palette.color_sketches(px, "attack_id"), "sketches")
    about = palette.merged_colors(parts, "carrier_id").unionByName(palette.merged_colors(parts).withColumn("carrier_id", F.lit(None).cast("bigint")))
    exact = px.groupBy("carrier_id").agg(F.countDistinct(*RGB).alias("exact")).unionByName(px.agg(F.countDistinct(*RGB).alias("exact")).withColumn("carrier_id", F.lit(None).cast("bigint")))
    both = about.join(exact, about.carrier_id.eqNullSafe(exact.carrier_id)).select(about.carrier_id, "n_colors", "exact")
    return both.select("carrier_id", "exact", (F.abs(F.col("n_colors") - F.col("exact")) <= F.greatest(F.lit(1), 0.065 * F.col("exact"))).alias("within"))


QUERIES["palette_sketch"] = palette_sketch

# Pixel metrics
query(lambda px: metrics.paired_pixels(px, _distorted(px)), "paired_pixels")
query(lambda px: _rounded(metrics.mse(px, _distorted(px)), "mse"), "mse")
query(lambda px: _rounded(metrics.psnr(px, _distorted(px)), "psnr"), "psnr")
query(lambda px: _rounded(metrics.watermark_psnr(px, crop.crop_raw(_distorted(px), 0.5, "top_left")), "psnr"), "watermark_psnr")
query(lambda px: _rounded(metrics.metric_suite(px, _distorted(px)), "value"), "metric_suite")


def user_metrics() -> dict[str, tiles.Mergeable]:
    """Written as a user would: the mean squared error, and how far the histograms of the levels lie apart."""
    import numpy as np

    def counted(levels):
        return np.stack([np.bincount(levels[:, c].astype(int), minlength=256) for c in range(3)]).astype(float)

    square = tiles.Mergeable(lambda: np.zeros(2), lambda s, a, b: s + [((a - b).astype(float) ** 2).sum(), a.size], lambda s: s[0] / s[1])
    apart = tiles.Mergeable(lambda: np.zeros((2, 3, 256)), lambda s, a, b: s + np.stack([counted(a), counted(b)]), lambda s: np.abs(s[0] - s[1]).sum() / (2 * s[0].sum()))
    return {"own_mse": square, "histogram_distance": apart}


query(lambda px: _rounded(metrics.metric_suite(px, _distorted(px), user_metrics()), "value"), "user_metrics")


# Bits
def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir)
    own = marks(spark, sf_dir, px)
    got = embed.extract_pixels(point.bit_depth(embed.embed_pixels(px, own), 7), N_BITS)
    return own.select("carrier_id", F.col("bits").alias("original")).join(got.withColumnRenamed("bits", "extracted"), "carrier_id")


def _short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).withColumn("extracted", F.expr("case when carrier_id % 2 = 0 then left(extracted, 100) else extracted end"))


QUERIES["ber"] = lambda spark, sf_dir: _rounded(metrics.ber(_short(spark, sf_dir)), "ber")
QUERIES["ber_common_prefix"] = lambda spark, sf_dir: _rounded(metrics.ber(_short(spark, sf_dir), True), "ber")
QUERIES["nc"] = lambda spark, sf_dir: _rounded(metrics.nc(_pairs(spark, sf_dir)), "nc")
QUERIES["bit_length_mismatch"] = lambda spark, sf_dir: metrics.bit_length_mismatch(_short(spark, sf_dir))


# Detectors
def _scores(*names: str) -> Query:
    return lambda spark, sf_dir: _rounded(detector.scores(detections(spark, sf_dir)).select("detector_id", *names), *names)


QUERIES["confusion_counts"] = lambda spark, sf_dir: detector.confusion_counts(detections(spark, sf_dir))
for _name in ("accuracy", "precision", "recall", "f1"):
    QUERIES[_name] = _scores(_name)
QUERIES["avg_ranks"] = lambda spark, sf_dir: detector.avg_ranks(detections(spark, sf_dir), "detector_id", "y_score")
QUERIES["auc"] = lambda spark, sf_dir: _rounded(detector.auc(detections(spark, sf_dir)), "auc")


def p_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").groupBy("user_id").agg(F.round(F.avg("value"), 9).alias("value"))
    return _rounded(detector.p_value(bought, events.where("event_type = 'view'").select("value")), "p_value")


def p_value_by_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detector a type of event: users' means against all values of the type; purchases have no null sample."""
    events = _table(spark, sf_dir, "events").withColumnRenamed("event_type", "detector_id")
    means = events.groupBy("detector_id", "user_id").agg(F.round(F.avg("value"), 9).alias("value"))
    return _rounded(detector.p_value(means, events.where("detector_id <> 'purchase'").select("detector_id", "value"), "detector_id"), "p_value")


def unmatched_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"))
    return detector.unmatched_labels(docs, _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("sample_id")))


QUERIES["p_value"], QUERIES["p_value_by_detector"], QUERIES["unmatched_labels"] = p_value, p_value_by_detector, unmatched_labels

# Neighbourhoods
_TAPS = neighbourhood.gauss1d()
query(lambda px: _rounded(neighbourhood.sepfilter(neighbourhood.luma_plane(px), _TAPS, "valid"), "v"), "sepfilter_valid")
query(lambda px: _rounded(neighbourhood.sepfilter(neighbourhood.luma_plane(px), _TAPS, "same"), "v"), "sepfilter_same")
query(lambda px: _rounded(neighbourhood.ssim_map(*_luma_pair(px)), "ssim", "cs"), "ssim_map")
query(lambda px: _rounded(neighbourhood.ssim(*_luma_pair(px)), "ssim"), "ssim")
query(lambda px: _rounded(neighbourhood.downsample2(neighbourhood.luma_plane(px)), "v"), "downsample2")
query(lambda px: _rounded(neighbourhood.ms_ssim(*_luma_pair(carriers.upscaled(px, 6))), "ms_ssim"), "ms_ssim")
query(lambda px: _rounded(neighbourhood.conv3(neighbourhood.luma_plane(px), {"h": neighbourhood.SCHARR_X, "w": neighbourhood.SCHARR_Y}), "h", "w", digits=9), "conv3")
query(lambda px: _rounded(neighbourhood.scharr_gradient(neighbourhood.luma_plane(px)), "v"), "scharr_gradient")
query(lambda px: _rounded(neighbourhood.gradient_similarity(*_luma_pair(px)), "similarity"), "gradient_similarity")
query(lambda px: _rounded(neighbourhood.downsample_box(neighbourhood.luma_plane(px), 4), "v", digits=9), "downsample_box")
query(lambda px: _rounded(neighbourhood.chroma_similarity(px, _distorted(px), 2), "similarity"), "chroma_similarity")
_KERNEL = [[(5 - abs(i - 2)) * (5 - abs(j - 2)) / 100 for j in range(5)] for i in range(5)]
query(lambda px: _rounded(neighbourhood.correlate(neighbourhood.luma_plane(px), _KERNEL, 3, 1), "v"), "correlate_strided")


# Oriented bands
def large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mosaics of 72 * 72, which all scales of the bands fit in."""
    return carriers.mosaic(_table(spark, sf_dir, "embeddings"), tiles=9)


def oriented_subbands(spark: SparkSession, sf_dir: str) -> DataFrame:
    scales = pyramid.oriented_subbands(neighbourhood.luma_plane(large(spark, sf_dir)))
    return _rounded(pyramid.long_subbands(scales), "v")


def vifsub_est(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the scales and orientations that count, edges mirrored."""
    both = neighbourhood.paired(*_luma_pair(large(spark, sf_dir)))
    scales = pyramid.oriented_subbands(both, fidelity.HEIGHT, fidelity.ORIENTATIONS, ("a", "b"))
    pairs = tuple((f"a_{k}", f"b_{k}") for k in fidelity.ORIENTATIONS)
    found = [fidelity.vifsub_est(s, fidelity.window_side(i), pairs=pairs) for i, s in enumerate(scales)]
    each = [s.select(*KEYS, *[F.col(f"{n}_a_{k}").alias(f"{n}_{k}") for k in fidelity.ORIENTATIONS for n in ("gain", "noise")]) for s in found]
    return _rounded(pyramid.long_subbands(each, fidelity.ORIENTATIONS, ("gain", "noise")), "gain", "noise")


def _parameters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    scales = pyramid.oriented_subbands(neighbourhood.luma_plane(large(spark, sf_dir)), fidelity.HEIGHT, fidelity.ORIENTATIONS)
    return fidelity.refparams_vecgsm(scales)


def vecgsm_eigenvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _parameters(spark, sf_dir)[1].select(*fidelity.BAND, F.posexplode("eigenvalues").alias("i", "eigenvalue"))
    return _rounded(each, "eigenvalue")


for _f in (oriented_subbands, vifsub_est, vecgsm_eigenvalues):
    QUERIES[_f.__name__] = _f
QUERIES["refparams_vecgsm"] = lambda spark, sf_dir: _rounded(_parameters(spark, sf_dir)[0], "multiplier")
QUERIES["vif"] = lambda spark, sf_dir: _rounded(fidelity.vif(*_luma_pair(large(spark, sf_dir))), "vif")


# Suites
def suite_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir)
    return suite.suite_report(suite.robustness(px, marks(spark, sf_dir, px), N_BITS, suite.BASIC))


def suite_report_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all registered distortions."""
    px = pixels(spark, sf_dir)
    return suite.suite_report(suite.robustness(px, marks(spark, sf_dir, px), N_BITS))


QUERIES["suite_report"], QUERIES["suite_report_all"] = suite_report, suite_report_all
