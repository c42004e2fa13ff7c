"""Kernels against direct array code on small images, tiles and frame-wise features included."""

import numpy as np
import pytest
from panoloom.operators import planes as pl
from panoloom.operators import raster as ra
from panoloom.operators import ink as ik
from panoloom.sources import frames as fr

RNG = np.random.default_rng(11)


def table(spark, img, tile=False):
    h, w = img.shape
    data = [(0, 0, y, x, int(img[y, x])) for y in range(h) for x in range(w)]
    df = spark.createDataFrame(data, "video_id long, frame_idx long, y int, x int, v int")
    return df.drop("frame_idx") if tile else ra.co_locate(df)


def image(df, h, w, col="v"):
    out = np.full((h, w), -1)
    for r in df.collect():
        out[r.y, r.x] = r[col]
    return out


def window(img, r, fn):
    h, w = img.shape
    return np.array([[fn(img[max(0, y - r):y + r + 1, max(0, x - r):x + r + 1]) for x in range(w)] for y in range(h)])


def small_groups_removed(on, least):
    """Flood fill."""
    keep, seen = on.copy(), np.zeros_like(on)
    for y, x in zip(*np.nonzero(on)):
        if seen[y, x]:
            continue
        stack, group = [(y, x)], []
        seen[y, x] = True
        while stack:
            a, b = stack.pop()
            group.append((a, b))
            for i in range(max(0, a - 1), min(on.shape[0], a + 2)):
                for j in range(max(0, b - 1), min(on.shape[1], b + 2)):
                    if on[i, j] and not seen[i, j]:
                        seen[i, j] = True
                        stack.append((i, j))
        if len(group) < least:
            for p in group:
                keep[p] = False
    return keep


def test_rank_windows(spark):
    img = RNG.integers(0, 256, (13, 21))
    t = table(spark, img)
    assert (image(ra.dilate(t, 9), 13, 21) == window(img, 4, np.max)).all()
    assert (image(ra.erode(t, 3), 13, 21) == window(img, 1, np.min)).all()
    close = window(window(img, 4, np.max), 4, np.min)
    assert (image(ra.blackhat(t), 13, 21) == close - img).all()


@pytest.mark.parametrize("density", [0.12, 0.3])
def test_despeckle_equals_flood_fill(spark, density):
    on = RNG.random((20, 90)) < density
    want = small_groups_removed(on, 8)
    assert (image(ra.despeckle(table(spark, on * 255)), 20, 90) > 0).tolist() == want.tolist()
    tiles = ra.despeckle(ra.tiled(table(spark, on * 255, tile=True), 8, 16), keys=ra.TILE)
    assert (image(ra.own_columns(tiles, 16), 20, 90) > 0).tolist() == want.tolist()


def test_seven_goes_and_eight_stays(spark):
    img = np.zeros((12, 30), int)
    for i in range(7):
        img[i, i] = 255                      # diagonal of 7
        img[i, i + 12] = 255                 # diagonal of 8
    img[7, 19] = 255
    kept = image(ra.despeckle(table(spark, img)), 12, 30) > 0
    assert not kept[:, :12].any() and kept.sum() == 8


@pytest.mark.parametrize("kernel,halo", [(lambda d, k: ra.blackhat(d, keys=k), 8),
                                         (lambda d, k: ra.adaptive_marks(d, keys=k), 15)])
def test_tiles_equal_the_whole(spark, kernel, halo):
    img = RNG.integers(0, 256, (10, 70))
    whole = image(kernel(table(spark, img), ra.FRAME), 10, 70)
    tiles = kernel(ra.tiled(table(spark, img, tile=True), halo, 16), ra.TILE)
    assert (image(ra.own_columns(tiles, 16), 10, 70) == whole).all()


def test_lines_of_the_limit_go(spark):
    img = np.zeros((2, 64), int)
    img[0, 5:26], img[1, 5:25] = 255, 255    # 21 and 20 pixels; a third of the width is 21
    t = table(spark, img).where("v > 0").drop("v")
    assert {(r.y, r.x) for r in ra.drop_hlines(t, 64).collect()} == {(1, x) for x in range(5, 25)}


def test_flat_image_has_level_zero(spark):
    assert {r.t for r in ra.otsu_level(table(spark, np.full((4, 5), 9))).collect()} == {0}
    v = np.random.default_rng(3).integers(0, 256, (9, 11))
    for image in (v, v // 128 * 200, np.full((4, 5), 9)):
        by_window, by_count = ra.otsu_level(table(spark, image)), ra.otsu_join(table(spark, image))
        assert sorted(map(tuple, by_count.select(*by_window.columns).collect())) == sorted(map(tuple, by_window.collect()))


@pytest.mark.parametrize("opaque", [False, True])
@pytest.mark.parametrize("size", [(70, 48), (9, 12)])
def test_planes_equal_pixels(spark, opaque, size):
    h, w = size
    img = RNG.integers(0, 256, (2, h, w, 3))
    img[1] //= 3                             # a dark frame is inverted
    data = [(0, f, y, x, *map(int, img[f, y, x])) for f in (0, 1) for y in range(h) for x in range(w)]
    bgr = ra.co_locate(spark.createDataFrame(data, "video_id long, frame_idx long, y int, x int, b int, g int, r int"))
    want = (ra.feature_opaque if opaque else ra.feature_translucent)(bgr, w)
    stored = fr.store(bgr, w, h, "RGB")
    got = ik.unpack(pl.features(fr.normalise(stored), opaque), h)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("video_id", "frame_idx", "y", "x").collect()))


def test_gray_layout_and_broken_frames(spark):
    rows = [(1, 0, 0, 2, 1, "GRAY", [7, 8], [], []), (1, 1, 0, 2, 1, "BGR", [1], [2], [3])]
    px = fr.unfold(fr.normalise(spark.createDataFrame(rows, fr.SCHEMA)))
    # a gray frame keeps one plane; the short frame cannot be decoded and drops out
    assert sorted(tuple(r) for r in px.select("frame_idx", "x", "b").collect()) == [(0, 0, 7), (0, 1, 8)]


def test_readable_gate_reasons(spark):
    flat, sparse = np.full((40, 40), 200), np.full((40, 40), 250)
    sparse[0, :4] = 0
    noisy = RNG.integers(0, 256, (40, 40))
    def reason(img):
        return ra.readable_gate(table(spark, img), 128, 8, 0.005).first().reason
    assert (reason(flat), reason(sparse), reason(noisy)) == ("uniform", "blank", "ok")


def test_clean_is_blank_on_blank(spark):
    img = np.full((16, 40), 255)
    out = ra.clean_opaque(table(spark, img, tile=True))
    assert {(r.b, r.g, r.r) for r in out.collect()} == {(255, 255, 255)}
