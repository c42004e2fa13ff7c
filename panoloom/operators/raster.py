"""Image kernels over pixel rows ``(keys…, y, x, v)``.

Every kernel windows inside one image. Rows co-located by the image keys stay put: row-wise and
column-wise windows, histograms and neighbour aggregations of a whole kernel chain need a single
shuffle. A panorama has no bounded width, so it is first cut into column tiles that overlap by the
reach of the chain (``tiled``), and the overlap is dropped at the end (``own_columns``).
Images are dense: every pixel is present. Pixels outside an image are ignored by the rank windows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panoloom.operators.segments import spread
from panoloom.session import settle
from panoloom.settings import (ADAPTIVE_BLOCK, ADAPTIVE_C, BLACKHAT_SIZE, CLAHE_CLIP, CLAHE_GRID,
                               FIXED_LEVEL, GAIN, LINE_DIVISOR, LINE_MIN, NOISE_FLOOR, NOISE_MIN_AREA,
                               POLARITY_OPAQUE, POLARITY_TRANSLUCENT, TILE_COLUMNS)

LEVELS = 256
FRAME = ["video_id", "frame_idx"]
TILE = ["video_id", "tile"]


def co_locate(df: DataFrame, keys=FRAME) -> DataFrame:
    """Bring the pixels of an image together; the only shuffle of a kernel chain."""
    return spread(df, *keys)


def tiled(pano: DataFrame, halo: int, width: int = TILE_COLUMNS) -> DataFrame:
    """Copy each panorama pixel to every column tile within ``halo`` of it."""
    near = F.expr(f"sequence(greatest(0, x - {halo}) div {width}, (x + {halo}) div {width})")
    return co_locate(pano.withColumn("tile", F.explode(near)), TILE)


def own_columns(df: DataFrame, width: int = TILE_COLUMNS) -> DataFrame:
    return df.where(f"x div {width} = tile").drop("tile")


# ---- pixel-wise

def luma(df: DataFrame) -> DataFrame:
    return df.withColumn("v", F.expr("cast((299 * r + 587 * g + 114 * b + 500) div 1000 as int)")).drop("b", "g", "r")


def to_bgr(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if c != "v"], *[F.col("v").alias(c) for c in "bgr"])


def invert(df: DataFrame) -> DataFrame:
    return df.withColumn("v", 255 - F.col("v"))


def gain(df: DataFrame, factor: int = GAIN) -> DataFrame:
    return df.withColumn("v", F.least(F.lit(255), F.col("v") * factor))


def noise_floor(df: DataFrame, level: int = NOISE_FLOOR) -> DataFrame:
    return df.withColumn("v", F.when(F.col("v") > level, F.col("v")).otherwise(0))


def fixed_ink(df: DataFrame, level: int = FIXED_LEVEL) -> DataFrame:
    return df.where(F.col("v") > level).drop("v")


def crop(df: DataFrame, rect: Column) -> DataFrame:
    """The rectangle ``STRUCT<x,y,w,h>`` with its corner as the new origin."""
    x, y, w, h = (rect[c] for c in ("x", "y", "w", "h"))
    inside = df.where((F.col("x") >= x) & (F.col("x") < x + w) & (F.col("y") >= y) & (F.col("y") < y + h))
    return inside.withColumn("x", F.col("x") - x).withColumn("y", F.col("y") - y)


def upsample(df: DataFrame, factor: int = 3) -> DataFrame:
    """Nearest-neighbour enlargement."""
    cells = F.sequence(F.lit(0), F.lit(factor - 1))
    return (df.withColumn("__dy", F.explode(cells)).withColumn("__dx", F.explode(cells))
            .withColumn("y", F.col("y") * factor + F.col("__dy"))
            .withColumn("x", F.col("x") * factor + F.col("__dx")).drop("__dy", "__dx"))


# ---- whole image

def auto_polarity(df: DataFrame, level: int, keys=FRAME) -> DataFrame:
    """Invert images whose mean is below ``level``; integer comparison, so the boundary is exact."""
    w = Window.partitionBy(*keys)
    dark = F.sum("v").over(w) < F.count(F.lit(1)).over(w) * level
    return df.withColumn("__dark", dark).withColumn(
        "v", F.when(F.col("__dark"), 255 - F.col("v")).otherwise(F.col("v"))).drop("__dark")


def otsu_thresholds(df: DataFrame, keys=FRAME) -> DataFrame:
    """``(keys…, t)``: the level of greatest between-class variance of each image (the lowest such; 0 for a flat image).

    Levels are counted with partial results, so at most ``LEVELS`` rows an image are put in order, whatever its size.
    """
    levels = df.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("__m"))
    image, upto = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("v")
    total = F.col("__m") * F.col("v")
    d = levels.select(*keys, "v", F.sum("__m").over(image).alias("__n"), F.sum(total).over(image).alias("__s"),
                      F.sum("__m").over(upto).alias("__n1"), F.sum(total).over(upto).alias("__s1"))
    diff = (F.col("__n1") * F.col("__s") - F.col("__n") * F.col("__s1")).cast("double")
    rest = F.col("__n") - F.col("__n1")
    spread = F.when(rest == 0, 0.0).otherwise(
        diff * diff / (F.col("__n1").cast("double") * F.when(rest != 0, rest).cast("double")))
    best = d.groupBy(*keys).agg(F.max(F.struct(spread.alias("s"), (-F.col("v")).alias("nv"))).alias("__b"))
    return best.select(*keys, F.when(F.col("__b.s") > 0, -F.col("__b.nv")).otherwise(0).alias("t"))


def otsu_level(df: DataFrame, keys=FRAME) -> DataFrame:
    """Add ``t`` of ``otsu_thresholds`` to pixels that a chain of kernels makes: by windows, so that the chain runs once."""
    image, upto = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("v")
    one = F.lit(1)
    d = df.select("*", F.count(one).over(image).alias("__n"), F.sum("v").over(image).alias("__s"),
                  F.count(one).over(upto).alias("__n1"), F.sum("v").over(upto).alias("__s1"))
    diff = (F.col("__n1") * F.col("__s") - F.col("__n") * F.col("__s1")).cast("double")
    rest = F.col("__n") - F.col("__n1")
    spread = F.when(rest == 0, 0.0).otherwise(
        diff * diff / (F.col("__n1").cast("double") * F.when(rest != 0, rest).cast("double")))
    best = F.max(F.struct(spread.alias("s"), (-F.col("v")).alias("nv"))).over(image)
    return (d.withColumn("__b", best)
            .withColumn("t", F.when(F.col("__b.s") > 0, -F.col("__b.nv")).otherwise(0))
            .drop("__n", "__s", "__n1", "__s1", "__b"))


def otsu_join(df: DataFrame, keys=FRAME) -> DataFrame:
    """Add ``t`` of ``otsu_thresholds`` to pixels at rest, which are read twice and never put in order; keys are never null."""
    return df.join(otsu_thresholds(df, keys).hint("shuffle_hash"), list(keys))     # the hashed side has a row per image


def otsu(df: DataFrame, keys=FRAME) -> DataFrame:
    """Pixels above the automatic threshold."""
    return otsu_level(df, keys).where("v > t").drop("v", "t")


def frame_stats(df: DataFrame, keys=FRAME) -> DataFrame:
    """Pixel count, sums, mean and population deviation of each image."""
    a = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("sum_v"),
                              F.sum(F.col("v") * F.col("v")).alias("sum_v2"))
    var = (F.col("n") * F.col("sum_v2") - F.col("sum_v") * F.col("sum_v")).cast("double")
    return a.withColumn("mean", F.col("sum_v") / F.col("n")).withColumn("stddev", F.sqrt(var) / F.col("n"))


# ---- neighbourhoods

def _slide(df, keys, axis, fn, before, after):
    other = "y" if axis == "x" else "x"
    w = Window.partitionBy(*keys, other).orderBy(axis).rowsBetween(-before, after)
    return df.withColumn("v", fn("v").over(w))


def dilate(df: DataFrame, k: int, keys=FRAME, axes="xy") -> DataFrame:
    for a in axes:
        df = _slide(df, keys, a, F.max, k // 2, k // 2)
    return df


def erode(df: DataFrame, k: int, keys=FRAME, axes="xy") -> DataFrame:
    for a in axes:
        df = _slide(df, keys, a, F.min, k // 2, k // 2)
    return df


def opening(df: DataFrame, k: int, keys=FRAME) -> DataFrame:
    return dilate(erode(df, k, keys, "xy"), k, keys, "yx")   # the two y passes share one sort


def closing(df: DataFrame, k: int, keys=FRAME) -> DataFrame:
    return erode(dilate(df, k, keys, "xy"), k, keys, "yx")


def blackhat(df: DataFrame, k: int = BLACKHAT_SIZE, keys=FRAME) -> DataFrame:
    """Dark thin marks by local contrast."""
    return closing(df.withColumn("__v", F.col("v")), k, keys).withColumn("v", F.col("v") - F.col("__v")).drop("__v")


def thicken(df: DataFrame, keys=FRAME) -> DataFrame:
    """Widen dark strokes by one pixel down and right."""
    for a in "xy":
        df = _slide(df, keys, a, F.min, 1, 0)
    return df


def legacy_mask(df: DataFrame, level: int = FIXED_LEVEL, keys=FRAME) -> DataFrame:
    """Fixed threshold, then a 3×3 opening."""
    binary = df.withColumn("v", F.when(F.col("v") > level, 255).otherwise(0))
    return opening(binary, 3, keys).where("v > 0").drop("v")


def gaussian_weights(block: int) -> list[int]:
    """Integer weights of a Gaussian over ``block`` pixels, scaled by 65536."""
    sigma = 0.3 * ((block - 1) * 0.5 - 1) + 0.8
    raw = [math.exp(-((i - block // 2) ** 2) / (2 * sigma * sigma)) for i in range(block)]
    return [round(w / sum(raw) * 65536) for w in raw]


def _smooth(df, keys, axis, src, dst, weights):
    """Weighted sum along one axis, repeating the edge pixel outside the image."""
    other, size, r = ("y" if axis == "x" else "x"), len(weights), len(weights) // 2
    w = Window.partitionBy(*keys, other).orderBy(axis)
    df = df.select("*", F.collect_list(src).over(w.rowsBetween(-r, r)).alias("__a"),
                   F.least(F.lit(r), F.row_number().over(w) - 1).alias("__k"))
    taps = f"array({', '.join(f'{i}L' for i in weights)})"
    near = (f"concat(array_repeat(__a[0], {r} - __k), __a, "
            f"array_repeat(__a[size(__a) - 1], {size - r} + __k - size(__a)))")
    return df.withColumn(dst, F.expr(
        f"aggregate(zip_with({near}, {taps}, (v, t) -> v * t), 0L, (s, p) -> s + p)")).drop("__a", "__k")


def adaptive_marks(df: DataFrame, block: int = ADAPTIVE_BLOCK, c: int = ADAPTIVE_C, keys=FRAME) -> DataFrame:
    """255 where a pixel is at least ``c`` below its Gaussian neighbourhood mean, else 0."""
    weights = gaussian_weights(block)
    area = sum(weights) ** 2
    s = _smooth(_smooth(df, keys, "x", "v", "__h", weights), keys, "y", "__h", "__s", weights)
    mean = F.expr(f"(2 * __s + {area}L) div {2 * area}L")
    return s.withColumn("v", F.when(F.col("v") <= mean - c, 255).otherwise(0)).drop("__h", "__s")


def adaptive_ink(df: DataFrame, block: int = ADAPTIVE_BLOCK, c: int = ADAPTIVE_C, keys=FRAME) -> DataFrame:
    return adaptive_marks(df, block, c, keys).where("v > 0").drop("v")


def line_length(width: int) -> int:
    """Shortest horizontal run taken for a staff line."""
    return max(LINE_MIN, width // LINE_DIVISOR)


def drop_hlines(ink: DataFrame, width: int, keys=FRAME) -> DataFrame:
    """Remove horizontal runs of ink of at least ``line_length(width)`` pixels."""
    row = Window.partitionBy(*keys, "y").orderBy("x")
    run = Window.partitionBy(*keys, "y", "__run")
    return (ink.withColumn("__run", F.col("x") - F.row_number().over(row))
            .withColumn("__len", F.count(F.lit(1)).over(run))
            .where(F.col("__len") < line_length(width)).drop("__run", "__len"))


def _offers(df, keys):
    """Each mark offers its label to its eight neighbours and itself: rows ``(keys…, y, x, me, v, label)``."""
    around = F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"),
                                F.lit(dy == 0 and dx == 0).alias("me")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    alone = F.array(F.struct(F.col("y"), F.col("x"), F.lit(True).alias("me")))
    sent = df.select(*keys, "v", "label", F.explode(F.when(F.col("v") > 0, around).otherwise(alone)).alias("q"))
    return sent.select(*keys, "q.y", "q.x", "q.me", "v", "label").groupBy(*keys, "y", "x")


def despeckle(df: DataFrame, min_area: int = NOISE_MIN_AREA, keys=FRAME) -> DataFrame:
    """Set marks (``v > 0``) in 8-connected groups of fewer than ``min_area`` pixels to 0.

    Smallest labels travel ``min_area - 2`` steps, enough to settle every group that small. A label's
    pixels count as a group only if all their neighbours carry that label too, so pieces of larger
    groups are never removed.
    """
    if min_area <= 1:
        return df
    own = F.max(F.when(F.col("me"), F.col("v"))).alias("v")
    df = df.withColumn("label", F.when(F.col("v") > 0, F.col("y") * F.lit(1 << 40) + F.col("x")))
    for _ in range(min_area - 2):
        df = _offers(df, keys).agg(own, F.min("label").alias("label")).where("v is not null")
        df = df.withColumn("label", F.when(F.col("v") > 0, F.col("label")))
    df = (_offers(df, keys).agg(own, F.max(F.when(F.col("me"), F.col("label"))).alias("label"),
                                F.min("label").alias("lo"), F.max("label").alias("hi")).where("v is not null"))
    group = Window.partitionBy(*keys, "label")
    df = (df.withColumn("__n", F.count(F.lit(1)).over(group))
          .withColumn("__open", F.max((F.col("lo") != F.col("hi")).cast("int")).over(group)))
    small = (F.col("v") > 0) & (F.col("__n") < min_area) & (F.col("__open") == 0)
    return df.withColumn("v", F.when(small, 0).otherwise(F.col("v"))).drop("label", "lo", "hi", "__n", "__open")


def readable_gate(df: DataFrame, level: int, uniform: float, blank: float, keys=FRAME) -> DataFrame:
    """Why an image would be skipped before text recognition: uniform, blank or ok."""
    image = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(image)
    s1, s2 = F.sum("v").over(image), F.sum(F.col("v") * F.col("v")).over(image)
    d = df.select("*", (F.sqrt((n * s2 - s1 * s1).cast("double")) / n).alias("__sd"))
    t = otsu_level(auto_polarity(d, level, keys), keys)
    a = t.groupBy(*keys).agg(F.max("__sd").alias("__sd"), F.count(F.lit(1)).alias("__n"),
                             F.count_if(F.col("v") <= F.col("t")).alias("n_dark"))
    reason = (F.when(F.col("__sd") < uniform, "uniform")
              .when(F.col("n_dark") / F.col("__n") < blank, "blank").otherwise("ok"))
    return a.select(*keys, "n_dark", reason.alias("reason"))


# ---- features of frames

def feature_translucent(bgr: DataFrame, width: int, keys=FRAME) -> DataFrame:
    gray = auto_polarity(luma(bgr), POLARITY_TRANSLUCENT, keys)
    return drop_hlines(otsu(blackhat(gray, keys=keys), keys), width, keys)


def feature_opaque(bgr: DataFrame, width: int, keys=FRAME) -> DataFrame:
    gray = auto_polarity(luma(bgr), POLARITY_OPAQUE, keys)
    return drop_hlines(adaptive_ink(gray, keys=keys), width, keys)


# ---- panorama clean-up

def scene(pano: DataFrame, level: int, width: int = TILE_COLUMNS) -> DataFrame:
    """What all pixels of a panorama must know, ``(video_id, bx, dark, mx, my)``.

    Sums combine before the shuffle; the result has one row per column tile ``bx``, so attaching it to
    pixels joins on ``(video_id, bx)`` and no video is hot. It is small and used by several passes, hence stored.
    """
    parts = pano.groupBy("video_id", F.expr(f"x div {width}").alias("bx")).agg(
        F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"), F.max("x").alias("mx"), F.max("y").alias("my"))
    w = Window.partitionBy("video_id")
    return settle(parts.select("video_id", "bx", (F.sum("s").over(w) < F.sum("n").over(w) * level).alias("dark"),
                               F.max("mx").over(w).alias("mx"), F.max("my").over(w).alias("my")))


def in_scene(pano: DataFrame, known: DataFrame, width: int = TILE_COLUMNS) -> DataFrame:
    """Pixels with the columns of ``known``, in the polarity of their panorama."""
    return (pano.withColumn("bx", F.expr(f"x div {width}")).join(known, ["video_id", "bx"])
            .withColumn("v", F.when(F.col("dark"), 255 - F.col("v")).otherwise(F.col("v"))))


def pano_polarity(pano: DataFrame, level: int) -> DataFrame:
    """Polarity by the mean of the whole panorama."""
    return in_scene(pano, scene(pano, level)).select("video_id", "y", "x", "v")


def clahe(pano: DataFrame, polarity: int = 0, clip: float = CLAHE_CLIP, grid: int = CLAHE_GRID) -> DataFrame:
    """Polarity, then contrast-limited equalisation on a grid of tiles.

    Tile histograms combine before the shuffle. The 256-entry tables of a video are attached once per
    column tile of the panorama; applying them joins on ``(video_id, bx)``.
    """
    known = (scene(pano, polarity).withColumn("__tw", F.expr(f"(mx + {grid}) div {grid}"))
             .withColumn("__th", F.expr(f"(my + {grid}) div {grid}")))
    p = in_scene(pano, known)
    hist = (p.groupBy("video_id", F.expr("y div __th").alias("ty"), F.expr("x div __tw").alias("tx"), "v")
            .agg(F.count(F.lit(1)).alias("c")))
    cell, one_tile = ["video_id", "ty", "tx"], Window.partitionBy("video_id", "ty", "tx")
    by_level = one_tile.orderBy("v")
    # every level gets a row: those missing before, between and after the present ones count 0
    gap = (f"transform(filter(sequence(if(first, 0, v + 1), {LEVELS - 1}), q -> q < next and q <> v), "
           "q -> named_struct('v', q, 'c', 0L))")
    full = (hist.withColumn("next", F.coalesce(F.lead("v").over(by_level), F.lit(LEVELS)))
            .withColumn("first", F.lag("v").over(by_level).isNull())
            .select(*cell, F.inline(F.concat(F.array(F.struct("v", "c")), F.expr(gap)))))
    n = F.sum("c").over(one_tile)
    limited = (full.withColumn("n", n).withColumn("cl", F.expr(f"greatest(1L, cast({clip}D * n / {LEVELS} as bigint))"))
               .withColumn("excess", F.sum(F.expr("greatest(c - cl, 0)")).over(one_tile))
               .withColumn("c", F.expr(f"least(c, cl) + excess div {LEVELS} + if(v < excess % {LEVELS}, 1, 0)"))
               .withColumn("cdf", F.sum("c").over(by_level)))
    tables = (limited.select(*cell, "v", F.expr(f"cast(({2 * (LEVELS - 1)} * cdf + n) div (2 * n) as int)").alias("o"))
              .groupBy(*cell).agg(F.sort_array(F.collect_list(F.struct("v", "o"))).alias("t")))
    per_video = (tables.groupBy("video_id")
                 .agg(F.map_from_entries(F.collect_list(F.struct(F.expr(f"ty * {grid} + tx").alias("at"), F.col("t.o").alias("lut")))).alias("m"),
                      F.max("ty").alias("ymax"), F.max("tx").alias("xmax")))
    per_video = per_video.select("video_id", "ymax", "xmax", F.transform(
        F.sequence(F.lit(0), F.lit(grid * grid - 1)), lambda t: F.try_element_at(F.col("m"), t.cast("bigint"))).alias("luts"))
    j = in_scene(pano, known.join(per_video, "video_id"))
    # position between tile centres in half pixels, so all weights are integers
    for a, t, hi in (("x", "__tw", "xmax"), ("y", "__th", "ymax")):
        j = (j.withColumn(f"__c{a}", F.expr(f"cast(floor((2 * {a} - {t}) / (2.0D * {t})) as bigint)"))
             .withColumn(f"__r{a}", F.expr(f"2 * {a} - {t} - __c{a} * 2 * {t}"))
             .withColumn(f"__{a}1", F.expr(f"least(greatest(__c{a}, 0), {hi})"))
             .withColumn(f"__{a}2", F.expr(f"least(greatest(__c{a} + 1, 0), {hi})")))
    at = "luts[cast(__y{0} * %d + __x{1} as int)][v]" % grid
    value = (f"(({at.format(1, 1)} * (2 * __tw - __rx) + {at.format(1, 2)} * __rx) * (2 * __th - __ry)"
             f" + ({at.format(2, 1)} * (2 * __tw - __rx) + {at.format(2, 2)} * __rx) * __ry)")
    den = "(4 * __tw * __th)"
    return j.withColumn("v", F.expr(f"cast((2 * {value} + {den}) div (2 * {den}) as int)")).select("video_id", "y", "x", "v")


_HALO_BLACKHAT = 2 * (BLACKHAT_SIZE // 2)


def clean_translucent(pano: DataFrame) -> DataFrame:
    """White paper and dark marks from a gray panorama; staff lines are kept."""
    t = tiled(clahe(pano, POLARITY_TRANSLUCENT), _HALO_BLACKHAT + NOISE_MIN_AREA)
    marks = despeckle(noise_floor(gain(blackhat(t, keys=TILE))), keys=TILE)
    return to_bgr(invert(own_columns(marks)))


def clean_opaque(pano: DataFrame) -> DataFrame:
    t = tiled(pano_polarity(pano, POLARITY_OPAQUE), ADAPTIVE_BLOCK // 2 + NOISE_MIN_AREA)
    marks = despeckle(noise_floor(adaptive_marks(t, keys=TILE)), keys=TILE)
    return to_bgr(invert(own_columns(marks)))
