"""A user's own functions on tiles, own metrics, image files, p-values by detector, sketches of colours, sweeps."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkmark.functions.formulas import KEYS, RGB
from inkmark.operators import detector, metrics, palette, point, tiles
from inkmark.plans import suite
from inkmark.plans.catalogue import _softened, user_metrics
from inkmark.sources import carriers, files


def frames(spark, *sizes):
    return carriers.synthetic(spark.createDataFrame([(i, h, w) for i, (h, w) in enumerate(sizes)], "carrier_id long, height int, width int"))


def array(px, carrier):
    p = px.where(F.col("carrier_id") == carrier).toPandas()
    out = np.full((p.y.max() + 1, p.x.max() + 1, 3), -1)
    out[p.y, p.x] = p[list(RGB)].to_numpy()
    return out


def levels(v):
    return np.rint(np.clip(v, 0, 255)).astype(int)


@pytest.mark.parametrize("tile", [5, 8, 64])
def test_tiles_equal_the_whole_frame(spark, tile):
    """Frames of all remainders, one row or one pixel, and last tiles smaller than the border."""
    sizes = [(13, 16), (16, 11), (1, 9), (1, 1), (17, 17)]
    px = frames(spark, *sizes).repartition(5)
    soft = tiles.tiled_attack(px, _softened, tile=tile, halo=1)
    assert soft.columns == px.columns and soft.count() == px.count()
    for i in range(len(sizes)):
        assert (array(soft, i) == levels(_softened(array(px, i).astype(float)))).all()


@pytest.mark.parametrize("edge", tiles.EDGES)
def test_a_wide_border_at_every_edge(spark, edge):
    """Sums over seven places each way, of the frame padded as the border is."""
    px = frames(spark, (19, 22), (4, 15))

    def shifted(v):
        return np.roll(v, (3, -2), (0, 1)) / 2 + np.roll(v, (-3, 3), (0, 1)) / 2

    found = tiles.tiled_attack(px, shifted, tile=6, halo=3, edge=edge)
    for i in (0, 1):
        whole = np.pad(array(px, i).astype(float), [(3, 3), (3, 3), (0, 0)], mode=edge)
        assert (array(found, i) == levels(shifted(whole)[3:-3, 3:-3])).all()


def test_tiles_that_can_not_be(spark):
    px = frames(spark, (8, 8))
    for bad in ({"tile": 0}, {"halo": -1}, {"tile": 4, "halo": 5}, {"edge": "wrap"}):
        with pytest.raises(ValueError, match=r"tile must|unknown"):
            tiles.tiled_attack(px, _softened, **bad)
    with pytest.raises(Exception, match="lacks pixels"):
        tiles.tiled_attack(px.where("x <> 3 or y <> 3"), _softened).count()
    with pytest.raises(Exception, match="the function made"):
        tiles.tiled_attack(px, lambda v: v[1:]).count()
    assert tiles.tiled_attack(px.limit(0), _softened).count() == 0
    named = px.withColumn("carrier_id", F.lit("a"))
    assert {r.carrier_id for r in tiles.tiled_attack(named, _softened, tile=3).collect()} == {"a"}


def test_own_metrics_equal_the_built_in_ones(spark, monkeypatch):
    """Whatever the batches and however often states are passed on; a state without sums, merged by its own rule."""
    monkeypatch.setattr(tiles, "HELD", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        px = frames(spark, (16, 12), (5, 7), (1, 1)).repartition(6)
        other = point.gamma(px, 1.7)
        most = tiles.Mergeable(lambda: np.zeros(1), lambda s, a, b: np.maximum(s, np.abs(a - b).max()), lambda s: s[0], np.maximum)
        found = {(r.carrier_id, r.metric): r.value for r in metrics.metric_suite(px, other, user_metrics() | {"most": most}).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == 3 * 7
    for i in range(3):
        a, b = array(px, i), array(other, i)
        assert math.isclose(found[i, "own_mse"], found[i, "mse"], abs_tol=1e-12) and found[i, "most"] == found[i, "max_difference"]
        counts = [np.stack([np.bincount(v[..., c].ravel(), minlength=256) for c in range(3)]) for v in (a, b)]
        assert math.isclose(found[i, "histogram_distance"], np.abs(counts[0] - counts[1]).sum() / (2 * a.size))
    with pytest.raises(Exception, match="differ in size"):
        tiles.user_metrics(px, other.where("y > 0"), user_metrics()).collect()


def test_files_of_strips(spark, tmp_path):
    """What is written is read again, whatever the splits; each strip is an image of its own; jobs leave nothing else."""
    path = str(tmp_path / "images")
    px = frames(spark, (21, 9), (7, 30), (1, 1))
    files.write_carriers(px, path, strip=6)
    for split in (40, 700, files.SPLIT):
        found = files.read_carriers(spark, path, split=split)
        assert found.select(*px.columns).exceptAll(px).count() == 0 and found.count() == px.count()
    names = sorted(p.rsplit("/", 1)[1] for p, _ in files.listed(path))
    assert names == sorted(f"carrier-{c}-row-{r}.ppm" for c, h in ((0, 21), (1, 7), (2, 1)) for r in range(0, h, 6))
    assert not list((tmp_path / "images").glob("_temporary*"))
    first = next((tmp_path / "images").rglob("carrier-0-row-18.ppm")).read_bytes()
    assert first.startswith(b"P6\n# carrier 0\n# row 18\n# height 21\n9 3\n255\n") and first[-81:] == array(px, 0)[18:].astype(np.uint8).tobytes()
    files.write_carriers(px, path, mode="append")
    assert files.read_carriers(spark, path).count() == 2 * px.count()
    files.write_carriers(px.where("carrier_id = 1"), path, mode="overwrite")
    assert files.read_carriers(spark, path).count() == 210
    files.write_carriers(px.limit(0), path, mode="overwrite")
    assert files.read_carriers(spark, path).count() == 0
    with pytest.raises(Exception, match="lacks pixels"):
        files.write_carriers(px.where("not (x = 4 and y = 2)"), path)
    assert files.read_carriers(spark, path).count() == 0 and not list((tmp_path / "images").glob("_temporary*"))


def test_files_of_others(spark, tmp_path):
    """Endings in any case, by path; comments and white space anywhere in a header; what isn't such a file is an error."""
    (tmp_path / "b").mkdir()
    rgb = bytes(range(18))
    (tmp_path / "b" / "One.PPM").write_bytes(b"P6 # made by hand\n3\t# wide\n 2\n255\n" + rgb)
    (tmp_path / "a.ppm").write_bytes(b"P6\n1 6\n255\n" + rgb)
    (tmp_path / "c.txt").write_text("P6")
    assert [p.rsplit("/", 1)[1] for p, _ in files.listed(str(tmp_path))] == ["a.ppm", "One.PPM"]
    assert len(files.listed(str(tmp_path), False)) == 1 and len(files.listed(str(tmp_path / "a.ppm"))) == 1
    rows = files.read_carriers(spark, str(tmp_path), split=5).orderBy("path", "y", "x").collect()
    assert len(rows) == 12 and {r.carrier_id for r in rows} == {None}
    assert [(r.y, r.x, r.r, r.g, r.b) for r in rows[:6]] == [(i, 0, 3 * i, 3 * i + 1, 3 * i + 2) for i in range(6)]
    assert [(r.y, r.x, r.r) for r in rows[6:]] == [(i // 3, i % 3, 3 * i) for i in range(6)]
    for name, data in (("short", b"P6\n3 2\n255\n" + rgb[:9]), ("deep", b"P6\n1 1\n65535\n123456"), ("other", b"P5\n1 1\n255\n1"), ("endless", b"P6\n# " + b"x" * 90_000)):
        (tmp_path / f"{name}.d").mkdir()
        (tmp_path / f"{name}.d" / "x.ppm").write_bytes(data)
        with pytest.raises(Exception, match=r"cut short|256 levels|not a binary|without end"):
            files.read_carriers(spark, str(tmp_path / f"{name}.d")).count()


def test_p_values_by_detector(spark):
    """Against counts one by one; ties, a detector without null values, null values and statistics, a null detector."""
    r = random.Random(3)
    null_ = [(d, r.choice([0.5, 1.0, r.random(), None])) for d in ("a", "b", None) for _ in range(200)]
    stats = [(i, d, v) for i, (d, v) in enumerate((d, v) for d in ("a", "b", "c", None) for v in (-1.0, 0.5, 1.0, 2.0, r.random(), None, float("inf")))]
    found = detector.p_value(spark.createDataFrame(stats, "id int, detector_id string, value double"), spark.createDataFrame(null_, "detector_id string, value double"), "detector_id")
    assert found.columns == ["id", "detector_id", "value", "p_value"]
    rows = found.collect()
    assert len(rows) == len(stats)
    for x in rows:
        own = [v for d, v in null_ if d == x.detector_id and v is not None]
        if x.value is None:
            assert x.p_value is None
        elif not own:
            assert math.isnan(x.p_value)
        else:
            assert x.p_value == (sum(v >= x.value for v in own) + 1) / (len(own) + 1)


def test_color_sketches(spark):
    """Exact for few colours, within four standard errors for many, and alike whether merged or made at once."""
    px = spark.range(60_000).select(F.lit(1).cast("long").alias("carrier_id"), F.expr("int(id div 300)").alias("y"), F.expr("int(id % 300)").alias("x"), F.expr("int(id % 256)").alias("r"), F.expr("int(id div 256 % 256)").alias("g"), F.lit(7).alias("b"), F.expr("id % 5").alias("part"))
    parts = palette.color_sketches(px, "part")
    merged, whole = palette.merged_colors(parts, "carrier_id").first().n_colors, palette.merged_colors(palette.color_sketches(px)).first().n_colors
    assert abs(merged - 60_000) < 0.065 * 60_000 and abs(whole - 60_000) < 0.065 * 60_000
    few = palette.merged_colors(palette.color_sketches(frames(spark, (3, 3))), "carrier_id").first().n_colors
    assert few == palette.palette_size(frames(spark, (3, 3))).first().n_colors
    assert palette.merged_colors(palette.color_sketches(px.limit(0)), "carrier_id").count() == 0


def test_sweep_reads_once(spark):
    px = frames(spark, (6, 5))
    values = [0.5, 1.0, 2.5]
    found = suite.lut_sweep(px, point.gamma_table, values)
    assert found.exceptAll(suite.param_sweep(px, point.gamma, values).select(*found.columns)).count() == 0 and found.count() == 90
    assert found.select(*KEYS).distinct().count() == 30
    with pytest.raises(ValueError, match="over zero"):
        suite.lut_sweep(px, point.gamma_table, [1.0, 0.0])
