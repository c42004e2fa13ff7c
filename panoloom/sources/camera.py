"""Frame tables derived from the embeddings table.

Each vector supplies four columns of a long raster, one raster per video. A camera window of fixed
size moves along it by a known schedule, which gives frames whose true offsets are known. Everything
after numbering the vectors is a map over vectors, so the work is spread evenly whatever the size of
one video.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panoloom.operators.segments import number_rows, spread
from panoloom.settings import VECTOR_SPAN

W, H = 64, 16
VIDEOS = 5
FRAME = ["video_id", "frame_idx"]


@dataclass(frozen=True)
class Schedule:
    """Camera moves: every ``period`` frames it has gone ``advance`` columns (a multiple of 4)."""

    period: int
    advance: int
    within: str             # offset of frame {k} inside its period

    def raw(self, k: str) -> str:
        return f"({self.advance} * ({k} div {self.period}) + {self.within.format(k=k)})"

    def off(self, k: str) -> str:
        """Offset of frame ``k`` of a video of ``n_vec`` vectors; the last frame ends with the raster."""
        return f"least({self.raw(k)}, n_vec * 4 - {W})"

    def kept(self, k: str) -> str:
        """Frames up to the first one that the end of the raster holds back."""
        return f"(if({k} = 0, 0, {self.raw(f'({k} - 1)')}) + {W} <= n_vec * 4)"


# hold, +12, hold, +30, hold, +62 (2 columns of overlap, less than a band), repeat; every column is seen
JUMPY = Schedule(12, 104, "case when {k} % 12 < 3 then 0 when {k} % 12 < 6 then 12 when {k} % 12 < 9 then 42 else 104 end")
# +28 after every three frames
STEADY = Schedule(3, 28, "0")

_GRAY = "cast(greatest(0, least(255, cast(floor((e + 0.55D) * 230) as int))) as int)"


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/embeddings.parquet").select(
        F.expr(f"cast(label % {VIDEOS} as bigint)").alias("video_id"), "vec_id", "embedding")
    return number_rows(df, ["video_id"], ["vec_id"], F.expr(f"vec_id div {VECTOR_SPAN}"),
                       pos="vpos", total="n_vec", unfolds=True).drop("vec_id")


def strip(spark, sf) -> DataFrame:
    """(video_id, width, sx, y, e): the long raster."""
    return (vectors(spark, sf)
            .select("video_id", "n_vec", "vpos", F.posexplode("embedding").alias("i", "e"))
            .selectExpr("video_id", "n_vec * 4 as width", "vpos * 4 + i % 4 as sx", "cast(i div 4 as int) as y",
                        "cast(e as double) as e"))


def frames(spark, sf, plan: Schedule = JUMPY) -> DataFrame:
    """(video_id, frame_idx, off, ts_us, fps): one row per camera window."""
    first = f"vpos * 4 div {plan.advance} * {plan.period}"
    return (vectors(spark, sf)
            .where(f"vpos * 4 % {plan.advance} = 0")
            .select("video_id", "n_vec", F.explode(F.expr(
                f"sequence({first}, {first} + {plan.period - 1})")).alias("frame_idx"))
            .where(plan.kept("frame_idx"))
            .withColumn("off", F.expr(plan.off("frame_idx")))
            .selectExpr("video_id", "frame_idx", "off", "frame_idx * 50000 as ts_us",
                        "cast(20 as double) as fps"))


def frame_vectors(spark, sf, plan: Schedule = JUMPY) -> DataFrame:
    """Vectors copied to every frame that sees them, co-located by frame before pixels are unfolded."""
    off = plan.off("k")
    seen = (f"filter(sequence(greatest(0, (vpos * 4 - {W + plan.advance}) div {plan.advance}) * {plan.period}, "
            f"(vpos * 4 + 3 + {W}) div {plan.advance} * {plan.period} + {plan.period - 1}), "
            f"k -> {off} <= vpos * 4 + 3 and {off} + {W} > vpos * 4 and {plan.kept('k')})")
    return spread(vectors(spark, sf).select(
        "video_id", "vpos", "n_vec", "embedding", F.explode(F.expr(seen)).alias("frame_idx")), *FRAME)


def cells(spark, sf, plan: Schedule = JUMPY) -> DataFrame:
    """(video_id, frame_idx, off, y, x, e): every pixel of every frame, partitioned by frame."""
    off = plan.off("frame_idx")
    return (frame_vectors(spark, sf, plan)
            .select(*FRAME, F.expr(off).alias("off"), F.expr(f"vpos * 4 - {off}").alias("x0"), F.posexplode("embedding").alias("i", "e"))
            .selectExpr(*FRAME, "off", "cast(i div 4 as int) as y", "cast(x0 + i % 4 as int) as x",
                        "cast(e as double) as e")
            .where(f"x >= 0 and x < {W}"))


def marks(spark, sf) -> DataFrame:
    """(video_id, frame_idx, y, x, on): every pixel with its ink flag."""
    return cells(spark, sf).selectExpr(
        *FRAME, "y", "x", f"e < -0.1D or x = (5 * frame_idx) % {W} as on")


def barred_marks(spark, sf) -> DataFrame:
    """Steadily moving frames with a full-height bar every 28 columns of the raster and no cursor."""
    return cells(spark, sf, STEADY).selectExpr(
        *FRAME, "y", "x", "e < -0.1D or (x + off) % 28 = 6 as on")


def ink(spark, sf) -> DataFrame:
    """(video_id, frame_idx, y, x): set pixels only."""
    return marks(spark, sf).where("on").drop("on")


def px(spark, sf) -> DataFrame:
    """(video_id, frame_idx, y, x, v): gray frames."""
    return cells(spark, sf).selectExpr(
        *FRAME, "y", "x", f"case when x = (5 * frame_idx) % {W} then 20 else {_GRAY} end as v")


def bgr(spark, sf) -> DataFrame:
    """(video_id, frame_idx, y, x, b, g, r): colour frames."""
    return px(spark, sf).selectExpr(*FRAME, "y", "x", "v as b", "(v * 7 + 13) % 256 as g",
                                    "(v * 3 + 101) % 256 as r")


def pano(spark, sf) -> DataFrame:
    """(video_id, y, x, v): the long raster as gray, the truth stitching should recover."""
    return strip(spark, sf).selectExpr("video_id", "y", "sx as x", f"{_GRAY} as v")


def planes(spark, sf, plan: Schedule = JUMPY) -> DataFrame:
    """The colour frames as rows of planes, ``(video_id, frame_idx, ts_us, width, height, b, g, r)``.

    Built from the vectors of each frame without a pixel table.
    """
    off = plan.off("frame_idx")
    rows = (frame_vectors(spark, sf, plan).groupBy(*FRAME)
            .agg(F.first("n_vec").alias("n_vec"), F.sort_array(F.collect_list(F.struct("vpos", "embedding"))).alias("vs"))
            .select(*FRAME, F.expr(f"cast({off} - vs[0].vpos * 4 as int)").alias("x0"), F.col("vs.embedding").alias("es")))
    e = (f"cast(es[cast((x0 + i % {W}) div 4 as int)][cast(i div {W} * 4 + (x0 + i % {W}) % 4 as int)] as double)")
    gray = F.expr(f"transform(sequence(0, {W * H - 1}), i -> case when i % {W} = (5 * frame_idx) % {W} then 20 "
                  f"else cast(greatest(0, least(255, cast(floor(({e} + 0.55D) * 230) as int))) as int) end)")
    return (rows.select(*FRAME, gray.alias("v"))
            .select(*FRAME, F.expr("frame_idx * 50000").alias("ts_us"), F.lit(W).alias("width"), F.lit(H).alias("height"),
                    F.expr("cast(v as array<smallint>)").alias("b"),
                    F.expr("transform(v, p -> cast((p * 7 + 13) % 256 as smallint))").alias("g"),
                    F.expr("transform(v, p -> cast((p * 3 + 101) % 256 as smallint))").alias("r")))
