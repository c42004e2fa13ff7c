"""Page layout of stacked images."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panoloom.operators.fold import fold_scalars
from panoloom.operators.pointers import reached
from panoloom.operators.segments import number_rows, running_sums
from panoloom.session import stored
from panoloom.settings import NUMBERING_SPAN, PAGE_GAP, PAGE_H, PAGE_MARGIN, PAGE_W, SEGMENT_ROWS


def layout_progress(items: DataFrame, doc: str, order: str, every: int = 5, log_every: int = 20) -> DataFrame:
    """Progress rows of a document: each 5th image as a callback, each 20th as a log line."""
    n = number_rows(items, [doc], [order], F.expr(f"{order} div {NUMBERING_SPAN}"), total="total")
    return (n.withColumn("i", F.col("n") + 1)
            .withColumn("pct", F.col("i") / F.col("total") * 100)
            .withColumn("callback", F.col("i") % every == 0)
            .withColumn("logged", F.col("i") % log_every == 0)
            .where("callback or logged"))


def page_layout(items: DataFrame, doc: str, order: str, img_w: str, img_h: str,
                segment_rows: int = SEGMENT_ROWS // 4) -> DataFrame:
    """Place images below each other on pages, next-fit: ``(doc, n, page_no, slot, x, y, w, h)``.

    Page 1 exists from the start, so a first image taller than the page leaves it blank. The fold
    carries only the pen position; page numbers are a running count of page breaks.
    """
    usable, top = PAGE_W - 2 * PAGE_MARGIN, PAGE_H - PAGE_MARGIN
    rows = number_rows(items, [doc], [order], F.expr(f"{order} div {NUMBERING_SPAN}"))
    rows = (rows.withColumn("h", F.col(img_h) * (F.lit(usable) / F.col(img_w)))
            .withColumn("seg", F.expr(f"n div {segment_rows}")))
    item = "struct<n:bigint,h:double,y:double,slot:int,brk:boolean>"
    empty = F.array().cast(f"array<{item}>")

    def acc(pen, slot, log):
        return F.struct(pen.alias("pen"), slot.cast("int").alias("slot"), log.alias("log"))

    def merge(a, x):
        h = x["h"]
        brk = a["pen"] - h < PAGE_MARGIN
        pen, slot = F.when(brk, top).otherwise(a["pen"]), F.when(brk, 0).otherwise(a["slot"])
        row = F.struct(x["n"].alias("n"), h.alias("h"), (pen - h).alias("y"), slot.cast("int").alias("slot"), brk.alias("brk"))
        return acc(pen - (h + PAGE_GAP), slot + 1, F.concat(a["log"], F.array(row)))

    # a guess that is exact where all images are equally high: step down from the top of the page
    fits = F.expr(f"cast(1 + greatest(0, floor(({top}D - items[0].h - {PAGE_MARGIN}D) / (items[0].h + {PAGE_GAP}D))) as bigint)")
    before = (F.col("items")[0]["n"] % fits).cast("int")
    pen = F.aggregate(F.slice(F.sequence(F.lit(0), F.lit(64)), 1, before), F.lit(top),
                      lambda p, _: p - (F.col("items")[0]["h"] + PAGE_GAP))
    placed = fold_scalars(rows, doc, "n", "h", {"pen": "double"}, {"slot": "int"},
                          acc(F.lit(top), F.lit(0), empty), merge, "log", lambda p, s: acc(p, s, empty),
                          acc(pen, before, empty))
    paged = running_sums(placed, [doc], ["n"], F.expr(f"n div {NUMBERING_SPAN}"), {"breaks": F.col("brk").cast("int")})
    return paged.select(doc, "n", (F.col("breaks") + 1).alias("page_no"), "slot", F.lit(PAGE_MARGIN).alias("x"), "y",
                        F.lit(usable).alias("w"), "h")


#: Images a page can hold at most, since each is followed by a gap; the one that no longer fits is counted too.
PAGE_IMAGES = int((PAGE_H - 2 * PAGE_MARGIN) // PAGE_GAP) + 2


def page_starts(rows: DataFrame, doc: str, segment_rows: int) -> tuple[DataFrame, int]:
    """``(doc, n)`` of the images that begin a page, and the rounds of doubling; ``rows`` are ``(doc, n, h)``.

    Whichever image begins a page, the next page's first image is among the following ``PAGE_IMAGES``, so it is found for all images at once; each segment
    borrows that many rows of the next ones.
    """
    top = PAGE_H - PAGE_MARGIN
    reach = F.sequence(F.expr(f"greatest(0, n - {PAGE_IMAGES}) div {segment_rows}"), F.expr(f"n div {segment_rows}"))
    rows_near = rows.select(doc, "n", "h", F.explode(reach).alias("seg"))
    after = Window.partitionBy(doc, "seg").orderBy("n").rowsBetween(1, PAGE_IMAGES)
    near = rows_near.withColumn("hs", F.collect_list("h").over(after)).where(f"n div {segment_rows} = seg")
    fit = F.aggregate("hs", F.struct((F.lit(top) - (F.col("h") + PAGE_GAP)).alias("pen"), F.lit(1).alias("fits"), F.lit(True).alias("open")),
                      lambda a, h: F.when(a["open"] & (a["pen"] - h >= PAGE_MARGIN), F.struct(
                          (a["pen"] - (h + PAGE_GAP)).alias("pen"), (a["fits"] + 1).alias("fits"), F.lit(True).alias("open")))
                      .otherwise(F.struct(a["pen"].alias("pen"), a["fits"].alias("fits"), F.lit(False).alias("open"))))
    hops = near.select(doc, F.col("n").alias("node"), "hs", fit["fits"].alias("fits")).where("fits <= size(hs)")
    found, rounds = reached(stored(hops.select(doc, "node", (F.col("node") + F.col("fits")).alias("to")), "hops"),
                            rows.where("n = 0").select(doc, F.col("n").alias("node")), doc)
    return found.withColumnRenamed("node", "n"), rounds


def page_layout_pointers(items: DataFrame, doc: str, order: str, img_w: str, img_h: str,
                         segment_rows: int = SEGMENT_ROWS // 4) -> DataFrame:
    """The rows of ``page_layout`` by page starts: heights may vary as they like, rounds are the logarithm of a document's pages."""
    usable, top = PAGE_W - 2 * PAGE_MARGIN, PAGE_H - PAGE_MARGIN
    rows = number_rows(items, [doc], [order], F.expr(f"{order} div {NUMBERING_SPAN}"))
    rows = stored(rows.select(doc, "n", (F.col(img_h) * (F.lit(usable) / F.col(img_w))).alias("h")), "heights")
    starts, _ = page_starts(rows, doc, segment_rows)
    begun = rows.join(starts.withColumn("begins", F.lit(True)), [doc, "n"], "left")
    breaks = F.coalesce(F.col("begins"), F.lit(False)) & ((F.col("n") > 0) | (F.lit(top) - F.col("h") < PAGE_MARGIN))
    paged = running_sums(begun, [doc], ["n"], F.expr(f"n div {NUMBERING_SPAN}"), {"page_no": breaks.cast("int")})
    page = paged.groupBy(doc, "page_no").agg(F.sort_array(F.collect_list(F.struct("n", "h"))).alias("items"))     # at most PAGE_IMAGES
    empty = F.array().cast("array<struct<n:bigint,h:double,y:double,slot:int>>")
    placed = F.aggregate("items", F.struct(F.lit(top).alias("pen"), empty.alias("log")), lambda a, x: F.struct(
        (a["pen"] - (x["h"] + PAGE_GAP)).alias("pen"),
        F.concat(a["log"], F.array(F.struct(x["n"].alias("n"), x["h"].alias("h"), (a["pen"] - x["h"]).alias("y"), F.size(a["log"]).alias("slot")))).alias("log")))
    return (page.select(doc, (F.col("page_no") + 1).alias("page_no"), F.inline(placed["log"]))
            .select(doc, "n", "page_no", "slot", F.lit(PAGE_MARGIN).alias("x"), "y", F.lit(usable).alias("w"), "h"))
