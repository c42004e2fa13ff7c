"""Order-dependent decisions by pointers: where a state goes next is computed for all states at once, then pointers are doubled.

A fold whose state only changes at certain rows is a walk: state → the state after its next change. If that successor is known for every possible
state, the walk from the first state is found in as many rounds as the logarithm of its length, whatever the sequence length and without
any task that holds a sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panoloom.operators.ink import FRAME, ink_count
from panoloom.operators.match import Band, zero_shift
from panoloom.operators.segments import latest_before, previous
from panoloom.session import stored
from panoloom.settings import CONTENT_MIN, SAME_PAGE_SCORE, SEGMENT_ROWS, STABLE_PAGE_SCORE


def reached(hops: DataFrame, starts: DataFrame, key: str) -> tuple[DataFrame, int]:
    """``(key, node)`` of all nodes on the walks from ``starts``, and the number of rounds it took.

    ``hops`` is ``(key, node, to)`` with one successor per node and no rings. After a round in which pointers span ``s`` steps, all nodes within ``2 s``
    steps are known; nodes found and doubled pointers are written together, once per round.
    """
    found, rounds = starts.select(key, "node"), 0
    while True:
        a, b = hops.alias("a"), hops.alias("b")
        step = found.join(hops, [key, "node"]).select(key, F.col("to").alias("node"), F.lit(None).cast("bigint").alias("to"))
        longer = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.to") == F.col("b.node"))).select(f"a.{key}", "a.node", "b.to")
        both = stored(step.unionByName(longer), "pointers")
        step, hops = both.where("to is null").select(key, "node"), both.where("to is not null")
        if step.isEmpty():
            return found, rounds
        found, rounds = found.unionByName(step), rounds + 1


# ---- page flips

def _bands(packed: DataFrame, band: Band, block: int) -> DataFrame:
    """Each frame's left band, its block, whether it stands still after the frame before, and whether it holds content."""
    left = F.slice("cols", 1, band.tw * band.words).alias("left")
    enough = (ink_count(F.col("cols")) / (band.width * band.height) >= CONTENT_MIN).alias("enough")
    rows = packed.select(*FRAME, left, enough, F.expr(f"frame_idx div {block}").alias("block"))
    rows = previous(rows, ["video_id"], ["frame_idx"], F.col("block"), ["left"])
    rows = zero_shift(rows, band, "left", "prev_left", "still").drop("prev_left")
    return stored(rows.withColumn("rests", F.coalesce(F.col("still") >= STABLE_PAGE_SCORE, F.lit(False))), "bands")


def next_commits(bands: DataFrame, band: Band) -> DataFrame:
    """``(video_id, frame_idx, page_at, same_at)``: the first later frame that would be a new page after this one, and the first that still shows it.

    Rows look into their own block first, then ahead; those that have found no page look twice as far each round.
    """
    ends = bands.groupBy("video_id").agg(F.max("block").alias("end"))
    mine = bands.select(*FRAME, F.col("left").alias("mine"))
    later = bands.select("video_id", F.col("block").alias("there"), F.col("frame_idx").alias("at"), "left", "rests")
    todo, parts, near, far = bands.select(*FRAME, "block").join(ends, "video_id"), [], 0, 0
    while True:
        looks = todo.join(mine, FRAME).withColumn("there", F.explode(F.sequence(F.col("block") + near, F.least(F.col("block") + far, F.col("end")))))
        pairs = looks.join(later, ["video_id", "there"]).where("at > frame_idx")
        flipped = F.col("sim") < SAME_PAGE_SCORE
        seen = zero_shift(pairs, band, "left", "mine", "sim").groupBy(*FRAME).agg(
            F.min(F.when(flipped & F.col("rests"), F.col("at"))).alias("page_at"), F.min(F.when(~flipped, F.col("at"))).alias("same_at"))
        parts.append(stored(todo.join(seen, FRAME, "left"), "next"))
        near, far = far + 1, max(1, 2 * far + 1)
        todo = parts[-1].where(F.col("page_at").isNull() & (F.col("block") + near <= F.col("end"))).select(*FRAME, "block", "end")
        if todo.isEmpty():
            break
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.groupBy(*FRAME).agg(F.min("page_at").alias("page_at"), F.min("same_at").alias("same_at"))


def page_commits(bands: DataFrame, band: Band) -> tuple[DataFrame, int]:
    """``(video_id, frame_idx, scrolled)`` of the seed and every commit, and the rounds of doubling.

    A state is the confirmed frame and whether a page has been turned yet: node = 2 * frame + turned. Before the first turn a frame that
    still shows the page replaces the seed.
    """
    nexts = next_commits(bands, band)
    turn = F.col("page_at") * 2 + 1
    first = F.least(turn, F.col("same_at") * 2)          # the smaller number is the earlier frame
    hops = nexts.select("video_id", F.explode(F.array(
        F.struct((F.col("frame_idx") * 2).alias("node"), first.alias("to")),
        F.struct((F.col("frame_idx") * 2 + 1).alias("node"), turn.alias("to")))).alias("h")).select("video_id", "h.*").where("to is not null")
    seeds = bands.where("enough").groupBy("video_id").agg((F.min("frame_idx") * 2).alias("node"))
    found, rounds = reached(stored(hops, "hops"), stored(seeds, "seeds"), "video_id")
    return found.select("video_id", F.expr("node div 2").alias("frame_idx"), (F.col("node") % 2 == 1).alias("scrolled")), rounds


def page_fold_pointers(packed: DataFrame, band: Band, block: int = SEGMENT_ROWS // 8) -> DataFrame:
    """The decision log of ``fold.page_fold`` by pointers; ``block`` frames are compared with each other at once."""
    bands = _bands(packed, band, block)
    commits, _ = page_commits(bands, band)
    state = F.struct(F.col("frame_idx").alias("com"), "scrolled")
    rows = bands.join(commits, FRAME, "left").withColumn("mine", F.when(F.col("scrolled").isNotNull(), state))
    rows = latest_before(rows, ["video_id"], ["frame_idx"], F.col("block"), "mine", "held").select(*FRAME, "left", "still", "mine", "held.*")
    ref = bands.select("video_id", F.col("frame_idx").alias("com"), F.col("left").alias("page"))
    rows = zero_shift(rows.join(ref, ["video_id", "com"], "left"), band, "left", "page", "same")
    seed, blank = F.col("com").isNull() & F.col("mine").isNotNull(), F.col("com").isNull()
    flipped = F.col("same") < SAME_PAGE_SCORE
    action = (F.when(seed, "seed").when(blank, "skip").when(flipped & (F.col("still") >= STABLE_PAGE_SCORE), "page")
              .when(~flipped & ~F.col("scrolled"), "refresh").otherwise("static"))

    def known(c):
        return F.when(~blank, c)

    return (rows.withColumn("action", action)
            .select(*FRAME, "action", known(F.lit(0)).alias("dx"), known(F.col("same")).alias("peak"), known(F.col("still")).alias("zero"),
                    F.when(F.col("action").isin("seed", "page"), band.width).otherwise(0).alias("strip_w"), F.lit(False).alias("vetoed")))
