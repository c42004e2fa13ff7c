"""Similarity of ink frames by counting.

Both sides are binary, so normalised cross-correlation is the phi coefficient of four counts. Frames
are packed (``ink.pack``), and the counts come from ``bit_count`` over column words: one row per pair
of frames, no pixel join, nothing fanned out over shifts. All counts are integers; one double
expression at the end makes scores equal in every engine.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panoloom.functions.bits import scores, unpack_columns
from panoloom.operators.ink import FRAME, frame_segment, words
from panoloom.operators.segments import previous
from panoloom.settings import (BAND_MIN, BAND_RATIO, BAR_FRACTION, BAR_RANGE, BAR_TARGET, DX_AGREE_TOL,
                               MARGIN, MIN_SCORE, MIN_SHIFT, OVERLAP_BAND, OVERLAP_OFFSET, OVERLAP_SCORE,
                               SAME_PAGE_SCORE, SECOND_BAND_RATIO, STABLE_PAGE_SCORE)


@dataclass(frozen=True)
class Band:
    """Frame size and the template bands used to compare frames of that size."""

    width: int
    height: int

    @property
    def tw(self) -> int:
        return max(BAND_MIN, min(self.width - 1, int(self.width * BAND_RATIO)))

    @property
    def inset2(self) -> int:
        return max(self.tw, min(max(self.tw, self.width - 2 * self.tw), int(self.width * SECOND_BAND_RATIO)))

    @property
    def reach2(self) -> int:
        return self.width - self.tw - self.inset2

    @property
    def words(self) -> int:
        return words(self.height)


def phi(n, nt: Column, np_: Column, n11: Column) -> Column:
    """Correlation of two binary patches of ``n`` pixels; a flat template scores 1, a flat window 0."""
    vt, vp = nt * (n - nt), np_ * (n - np_)
    cov = (n11 * n - nt * np_).cast("double")
    root = F.sqrt(vt.cast("double") * vp.cast("double"))
    return F.when(vt == 0, 1.0).when(vp == 0, 0.0).otherwise(cov / F.when(root != 0, root))


def _sum(arr: str) -> str:
    return f"aggregate({arr}, 0L, (s, c) -> s + c)"


def offset_scores(df: DataFrame, band: Band, inset: int = 0, tpl: str = "cols", ref: str = "prev_cols",
                  tw: int | None = None, out: str = "scores") -> DataFrame:
    """Scores of the ``tpl`` band at ``inset`` against every position of ``ref``, left to right.

    An Arrow function for frames of every size, since the shifts times the columns of a wide frame make a column expression
    slow; null if either side is null.
    """
    width, height, k, tw = band.width, band.height, band.words, tw or band.tw

    @F.pandas_udf("array<double>")
    def run(t: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else scores(
            unpack_columns(b, width, k), unpack_columns(a, width, k)[inset:inset + tw], height)
            for a, b in zip(t, r)], dtype=object)

    return df.withColumn(out, run(tpl, ref))


def peak(scores: Column, inset: int = 0) -> Column:
    """``STRUCT<dx, peak, zero>``; the leftmost of equal peaks wins."""
    best = F.array_max(scores)
    return F.struct((F.array_position(scores, best) - 1 - inset).cast("int").alias("dx"), best.alias("peak"),
                    F.get(scores, F.lit(inset)).alias("zero"))


def consecutive(packed: DataFrame) -> DataFrame:
    """Each frame with the frame before it."""
    pairs = previous(packed, ["video_id"], ["frame_idx"], frame_segment(), ["frame_idx", "cols"])
    return pairs.where("prev_frame_idx is not null")


def match_scores(pairs: DataFrame, band: Band, inset: int = 0) -> DataFrame:
    """One row per pair and shift."""
    s = offset_scores(pairs, band, inset)
    return (s.select(*FRAME, "prev_frame_idx", F.posexplode("scores").alias("loc", "score"))
            .withColumn("dx", F.col("loc") - inset).drop("loc"))


def match_peak(pairs: DataFrame, band: Band, inset: int = 0, out: str = "m") -> DataFrame:
    s = offset_scores(pairs, band, inset)
    return s.withColumn(out, peak(F.col("scores"), inset)).drop("scores")


def scroll_gate(m: Column, band: Band) -> Column:
    """A shift clearly better than standing still."""
    return ((m["dx"] >= MIN_SHIFT) & (m["dx"] <= band.width - band.tw) & (m["peak"] >= MIN_SCORE)
            & (m["peak"] - m["zero"] >= MARGIN))


def consensus(pairs: DataFrame, band: Band) -> DataFrame:
    """Gate decision with the second band's veto; the second band is scored only where it can decide."""
    p = match_peak(pairs, band)
    p = p.withColumn("base", scroll_gate(F.col("m"), band))
    ask = F.col("base") & (F.col("m.dx") <= band.reach2)
    p = p.withColumn("__ref", F.when(ask, F.col("prev_cols")))
    p = offset_scores(p, band, band.inset2, ref="__ref", out="__s2")
    m2 = peak(F.col("__s2"), band.inset2)
    p = p.withColumn("m2", F.when(ask, m2))
    veto = F.coalesce((F.col("m2.peak") >= MIN_SCORE) & (F.abs(F.col("m.dx") - F.col("m2.dx")) > DX_AGREE_TOL), F.lit(False))
    return p.withColumn("vetoed", veto).withColumn("accepted", F.col("base") & ~veto).drop("__ref", "__s2")


def zero_shift(df: DataFrame, band: Band, tpl: str, ref: str, out: str) -> DataFrame:
    """Score of the left band without shift."""
    k = band.tw * band.words
    t, r = F.slice(tpl, 1, k), F.slice(ref, 1, k)
    n11 = F.aggregate(F.zip_with(t, r, lambda a, b: F.bit_count(a.bitwiseAND(b)).cast("bigint")), F.lit(0).cast("bigint"), lambda s, c: s + c)
    ones = [F.aggregate(a, F.lit(0).cast("bigint"), lambda s, c: s + F.bit_count(c)) for a in (t, r)]
    return df.withColumn(out, phi(F.lit(band.tw * band.height), ones[0], ones[1], n11))


def page_sim(pairs: DataFrame, band: Band) -> DataFrame:
    """Same-page and standstill tests against the previous frame."""
    s = zero_shift(pairs, band, "cols", "prev_cols", "sim")
    return s.withColumn("changed", F.col("sim") < SAME_PAGE_SCORE).withColumn("stable", F.col("sim") >= STABLE_PAGE_SCORE)


def overlap_x(pairs: DataFrame, band: Band, strip_w: int = OVERLAP_BAND, offset: int = OVERLAP_OFFSET,
              old: str = "prev_cols", new: str = "cols", out: str = "overlap_x") -> DataFrame:
    """Where the old frame's right end continues in the new frame, else -1."""
    if band.width <= strip_w + offset:
        return pairs.withColumn(out, F.lit(-1))
    s = offset_scores(pairs, band, band.width - strip_w - offset, tpl=old, ref=new, tw=strip_w, out="__s")
    best = F.array_max("__s")
    at = (F.array_position("__s", best) - 1 + strip_w + offset).cast("int")
    return s.withColumn(out, F.when(best > OVERLAP_SCORE, at).otherwise(-1)).drop("__s")


def bar_line(df: DataFrame, band: Band, target: int | None = None, reach: int = BAR_RANGE,
             out: str = "bar_x", cols: str = "cols") -> DataFrame:
    """Column near ``target`` with the most ink if above the bar fraction (rightmost of equals), else -1."""
    target = int(band.width * BAR_TARGET) if target is None else target
    lo, hi, k = max(0, target - reach), min(band.width - 1, target + reach), band.words
    tall = F.expr(f"transform(sequence({lo}, {hi}), x -> named_struct('n', "
                  + _sum(f"transform(slice({cols}, x * {k} + 1, {k}), c -> cast(bit_count(c) as bigint))") + ", 'x', x))")
    best = F.array_max(tall)
    return df.withColumn(out, F.when(best["n"] / band.height > BAR_FRACTION, best["x"]).otherwise(-1))
