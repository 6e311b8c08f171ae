"""Histogram equalisation, over whole carriers and over tiles with a clip limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkmark.functions import formulas as f
from inkmark.functions.formulas import RGB, level
from inkmark.operators.point import others
from inkmark.sources.carriers import sizes

#: Pixels of a carrier that meet one copy of its tiles' maps.
PART = 1 << 20


def level_histogram(pixels: DataFrame) -> DataFrame:
    """(carrier_id, c, level, n)."""
    long = pixels.select("carrier_id", F.expr("stack(3, 0, r, 1, g, 2, b) as (c, level)"))
    return long.groupBy("carrier_id", "c", "level").agg(F.count("*").alias("n"))


def hist_equalize(pixels: DataFrame) -> DataFrame:
    """Each channel through its cumulative histogram, in integers.

    step = (count - count of the highest level) div 255; a level becomes (step div 2 + count below it) div step. With
    fewer than two levels, or a step of zero, the channel stays. The table of a channel has 256 rows at most; three of
    them, as maps, are joined by carrier, never by broadcast.
    """
    by = Window.partitionBy("carrier_id", "c").orderBy("level")
    whole = Window.partitionBy("carrier_id", "c")
    h = level_histogram(pixels).withColumn("below", F.sum("n").over(by) - F.col("n"))
    h = h.withColumn("step", ((F.sum("n").over(whole) - F.max_by("n", "level").over(whole)) / 255).cast("bigint"))
    to = F.expr("case when step = 0 then level else cast(least((step div 2 + below) div step, 255) as int) end")
    tables = h.groupBy("carrier_id", "c").agg(F.map_from_entries(F.collect_list(F.struct("level", to.alias("to")))).alias("lut"))
    tables = tables.groupBy("carrier_id").agg(*[F.first(F.when(F.col("c") == i, F.col("lut")), ignorenulls=True).alias(f"lut{i}") for i in range(3)])
    return pixels.join(tables.hint("merge"), "carrier_id").select(*[c for c in pixels.columns if c not in RGB], *[F.col(f"lut{i}")[F.col(c)].alias(c) for i, c in enumerate(RGB)])


def clahe(pixels: DataFrame, tiles: int = 8, clip_limit: float = 2.0, bins: int = 256) -> DataFrame:
    """Luma equalised in tiles with clipped histograms, mixed bilinearly between the tiles' maps.

    Only bins that a tile has are counted rows; a tile's map is an array of `bins` running sums, and what redistribution
    adds follows from four numbers. All maps of a carrier are one row, which its pixels are joined with once. A large
    carrier is dealt into parts of about PART pixels, each with its copy of the maps.
    """
    if tiles < 2 or not 2 <= bins <= 256:
        raise ValueError("tiles must be 2 at least, bins 2 to 256")
    kept = others(pixels)
    own = pixels.select(*kept, *[F.expr(e).alias(n) for n, e in f.to_ycbcr().items()])
    parts = F.expr(f"cast(ceil(cast(height as bigint) * width / {PART}e0) as int)").alias("parts")
    dims = sizes(pixels).select("carrier_id", F.expr(f"(height + {tiles - 1}) div {tiles}").alias("th"), F.expr(f"(width + {tiles - 1}) div {tiles}").alias("tw"), parts)
    own = own.join(dims, "carrier_id").withColumn("bin", F.expr(f"least(y_ * {bins} div 256, {bins - 1})").cast("int"))
    counts = own.groupBy("carrier_id", F.expr(f"cast((y div th) * {tiles} + x div tw as int)").alias("t"), "bin").agg(F.count("*").alias("n"))
    tile = Window.partitionBy("carrier_id", "t")
    h = counts.withColumn("limit", F.expr(f"greatest(1, cast({float(clip_limit)}e0 * sum(n) over (partition by carrier_id, t) / {bins} as bigint))"))
    h = h.withColumn("excess", F.sum(F.expr("greatest(n - limit, 0)")).over(tile)).withColumn("sum", F.sum(F.expr("least(n, limit)")).over(tile.orderBy("bin")))
    h = h.withColumn("wide", F.lead("bin", 1, bins).over(tile.orderBy("bin")) - F.col("bin"))
    one = h.groupBy("carrier_id", "t").agg(F.first("excess").alias("excess"), F.max("sum").alias("kept"), F.array_sort(F.collect_list(F.struct("bin", "wide", "sum"))).alias("all"))  # bins at most
    one = one.withColumn("residual", F.expr(f"excess % {bins}")).withColumn("stride", F.expr(f"case when residual > 0 then greatest(1, {bins} div residual) else 1 end"))
    added = "({bin} + 1) * {m}each + least({m}residual, {bin} div {m}stride + 1)"
    sums = F.expr("concat(array_repeat(0L, all[0].bin), flatten(transform(all, e -> array_repeat(e.sum, e.wide))))")
    one = one.select("carrier_id", "t", sums.alias("sums"), F.expr(f"excess div {bins}").alias("each"), "residual", "stride", "kept")
    one = one.withColumn("total", F.expr(f"kept + {added.format(m='', bin=bins - 1)}"))
    m = one.groupBy("carrier_id").agg(F.collect_list(F.struct("t", F.struct("sums", "each", "residual", "stride", "total").alias("m"))).alias("all"))  # tiles ** 2 at most
    lacks = f"transform(array_except(sequence(0, {tiles * tiles - 1}), all.t), t -> struct(t, cast(null as {m.schema['all'].dataType.elementType['m'].dataType.simpleString()}) as m))"
    m = m.select("carrier_id", F.expr(f"transform(array_sort(concat(all, {lacks})), e -> e.m)").alias("maps"))
    m = m.join(dims.select("carrier_id", "parts"), "carrier_id").select("carrier_id", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), "maps")
    for a, t in (("y", "th"), ("x", "tw")):
        own = own.withColumn(f"p{a}", F.expr(f"least(greatest(({a} + 0.5e0) / {t} - 0.5e0, 0e0), {tiles - 1}e0)"))
        own = own.withColumn(f"{a}0", F.floor(f"p{a}").cast("int")).withColumn(f"{a}1", F.least(F.floor(f"p{a}").cast("int") + 1, F.lit(tiles - 1))).withColumn(f"w{a}", F.col(f"p{a}") - F.floor(f"p{a}"))
    own = own.withColumn("part", F.expr("pmod(xxhash64(y, x), parts)").cast("int")).select(*kept, "part", "bin", "cb", "cr", "y0", "y1", "x0", "x1", "wy", "wx")
    own = own.join(m.hint("merge"), ["carrier_id", "part"])  # rows of many kilobytes: never broadcast
    empty = f"bin / {max(1, bins - 1)}e0 * 255e0"
    for i in (0, 1):
        for j in (0, 1):
            at = f"get(maps, y{i} * {tiles} + x{j})"
            value = f"(get({at}.sums, bin) + {added.format(m=at + '.', bin='bin')}) / greatest(1e0, cast({at}.total as double)) * 255e0"
            own = own.withColumn(f"v{i}{j}", F.expr(f"coalesce({value}, {empty})"))
    rows = [f"(v{i}0 * (1e0 - wx) + v{i}1 * wx)" for i in (0, 1)]
    own = own.withColumn("y_", F.expr(level(f"{rows[0]} * (1e0 - wy) + {rows[1]} * wy")))
    return own.select(*kept, *[F.expr(e).alias(c) for c, e in f.from_ycbcr("y_", "cb", "cr").items()])
