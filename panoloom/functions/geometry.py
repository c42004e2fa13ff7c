"""Region and box arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panoloom.settings import BAND_MIN, BAND_RATIO, DEFAULT_ROI, MIN_BOX, SECOND_BAND_RATIO

SIDES = ("top", "bottom", "left", "right")


def clamp(v: Column, lo, hi) -> Column:
    """``lo`` wins when the bounds cross."""
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.greatest(lo, F.least(hi, v))


def parse_roi(text: Column) -> Column:
    """``STRUCT<top,bottom,left,right,ok>``; anything but four numbers gives the default region."""
    parts = F.split(F.regexp_replace(text, ",+$", ""), ",")
    nums = F.transform(parts, lambda p: F.trim(p).try_cast("double"))
    ok = (F.size(parts) == 4) & F.forall(nums, lambda n: n.isNotNull())
    ok = F.coalesce(ok, F.lit(False))
    return F.struct(*[
        F.when(ok, F.get(nums, F.lit(i))).otherwise(F.lit(d)).alias(side)
        for i, (side, d) in enumerate(zip(SIDES, DEFAULT_ROI))], ok.alias("ok"))


def roi_rect(w: Column, h: Column, top, bottom, left, right) -> Column:
    """Ratios to a pixel rectangle of at least one pixel, ``STRUCT<x,y,w,h>``."""
    y1 = clamp((h * top).cast("int"), 0, h - 1)
    y2 = clamp((h * bottom).cast("int"), y1 + 1, h)
    x1 = clamp((w * left).cast("int"), 0, w - 1)
    x2 = clamp((w * right).cast("int"), x1 + 1, w)
    return F.struct(x1.alias("x"), y1.alias("y"), (x2 - x1).alias("w"), (y2 - y1).alias("h"))


def roi_ratio(x, y, w, h, img_w, img_h) -> Column:
    """Pixel box to ratios."""
    iw, ih = img_w.cast("double"), img_h.cast("double")
    return F.struct((y / ih).alias("top"), ((y + h) / ih).alias("bottom"),
                    (x / iw).alias("left"), ((x + w) / iw).alias("right"))


def initial_box(top, bottom, left, right, img_w, img_h) -> Column:
    """Ratios to an editable box, never smaller than the minimum box."""
    return F.struct((left * img_w).cast("int").alias("x"), (top * img_h).cast("int").alias("y"),
                    F.greatest(F.lit(MIN_BOX), ((right - left) * img_w).cast("int")).alias("w"),
                    F.greatest(F.lit(MIN_BOX), ((bottom - top) * img_h).cast("int")).alias("h"))


def clamp_box(x, y, w, h, img_w, img_h) -> Column:
    """Box cut to the image, at least one pixel."""
    cx, cy = clamp(x, 0, img_w - 1), clamp(y, 0, img_h - 1)
    return F.struct(cx.alias("x"), cy.alias("y"), clamp(w, 1, img_w - cx).alias("w"),
                    clamp(h, 1, img_h - cy).alias("h"))


def rect_is_valid(x, y, w, h, img_w, img_h) -> Column:
    return (w > 0) & (h > 0) & (x >= 0) & (y >= 0) & (x + w <= img_w) & (y + h <= img_h)


def safe_rect(x, y, w, h, img_w, img_h) -> Column:
    """The rectangle, or the whole image when it does not lie inside it."""
    ok = rect_is_valid(x, y, w, h, img_w, img_h)
    return F.struct(F.when(ok, x).otherwise(0).alias("x"), F.when(ok, y).otherwise(0).alias("y"),
                    F.when(ok, w).otherwise(img_w).alias("w"), F.when(ok, h).otherwise(img_h).alias("h"))


def roi_label(top, bottom, left, right) -> Column:
    """Percent description of a region."""
    t, b, le, r = [F.floor(v * 100 + 0.5).cast("int") for v in (top, bottom, left, right)]
    return F.format_string("top %d%%-bottom %d%%, left %d%%-right %d%%", t, b, le, r)


def band_geometry(w: Column) -> Column:
    """``STRUCT<tw, inset2, reach2>``: band width, second band position, farthest shift it can confirm."""
    tw = clamp((w * BAND_RATIO).cast("int"), BAND_MIN, w - 1)
    inset2 = clamp((w * SECOND_BAND_RATIO).cast("int"), tw, F.greatest(tw, w - tw * 2))
    return F.struct(tw.alias("tw"), inset2.alias("inset2"), (w - tw - inset2).alias("reach2"))


def text_size(w: Column, h: Column, height: int, min_w: int, max_w: int) -> Column:
    """Target size of an image before text recognition."""
    scale = F.lit(float(height)) / F.greatest(F.lit(1), h)
    sw = F.least(F.lit(max_w), F.greatest(F.lit(min_w), (w * scale).cast("int")))
    return F.struct(sw.alias("w"), F.lit(height).alias("h"))
