"""Order-dependent decisions along sequences of any length.

A fold needs the state left by the row before, yet one sequence must not be one task. Sequences are
cut into segments and every segment is folded at once from a guessed entry state. A segment whose
predecessor turns out to leave another state is folded again, until each entry equals the exit before
it. That fixpoint is the sequential result: the first segment's entry is exact, so each round settles
at least one more segment of every sequence, and since states forget their past at each commit, two
to four rounds normally settle all of them. Only segment states (one row per segment) move between
rounds, checkpointed in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panoloom.operators import steps
from panoloom.operators.ink import frame_segment
from panoloom.operators.match import Band
from panoloom.session import settle, stored
from panoloom.settings import CHANGE_RATIO, STABLE_COUNT, STABLE_RATIO

SEG = "seg"


def _links(rows: DataFrame, key: str) -> DataFrame:
    """(key, seg, prev_seg) of every segment."""
    segs = rows.select(key, SEG).distinct()
    return settle(segs.withColumn("prev_seg", F.lag(SEG).over(Window.partitionBy(key).orderBy(SEG))))


def settle_entries(links: DataFrame, key: str, carried: list[str], local: list[str], blank: DataFrame,
                   exits_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Entry state of every segment, ``(key, seg, known, *carried, *local)``.

    ``exits_of(entries)`` folds the segments of ``entries`` and returns their exit states; where an
    entry is not ``known`` it starts from a guess. ``carried`` columns only change at a commit, which
    shows in the first of them, so a new value is passed at once through all segments that did not
    commit instead of one segment per round. ``local`` columns come from the segment before.
    """
    if links.where("prev_seg is not null").isEmpty():
        return blank
    mark, state = carried[0], carried + local
    w = Window.partitionBy(key).orderBy(SEG)

    def run(entries):
        used = entries.select(key, SEG, F.col(mark).alias("was"))
        moved = F.col("was").isNull() | ~F.col(mark).eqNullSafe(F.col("was"))
        return exits_of(entries).join(used, [key, SEG]).withColumn("moved", moved).drop("was")

    def propose(exits):
        held = F.last(F.when(F.col("moved"), F.struct(*carried)), ignorenulls=True).over(
            w.rowsBetween(Window.unboundedPreceding, -1))
        near = [F.lag(c).over(w).alias(c) for c in local]
        return (exits.select(key, SEG, F.row_number().over(w).alias("at"), held.alias("held"), *near).where("at > 1")
                .select(key, SEG, F.lit(True).alias("known"), *[F.col(f"held.{c}").alias(c) for c in carried], *local))

    exits = settle(run(blank))
    entries = changed = settle(propose(exits))
    while not changed.isEmpty():
        exits = settle(exits.join(changed.select(key, SEG), [key, SEG], "left_anti").unionByName(run(changed)))
        fresh = settle(propose(exits))
        old = entries.select(key, SEG, F.struct(*state).alias("old"))
        changed = settle(fresh.join(old, [key, SEG]).where(~F.struct(*state).eqNullSafe(F.col("old"))).drop("old"))
        entries = fresh
    return blank.where("known").unionByName(entries)


def _blank(links: DataFrame, key: str, state: dict[str, str]) -> DataFrame:
    """Entries before any folding: only first segments know theirs."""
    return links.select(key, SEG, F.col("prev_seg").isNull().alias("known"),
                        *[F.lit(None).cast(t).alias(c) for c, t in state.items()])


# ---- folds over packed frames

@dataclass(frozen=True)
class FrameFold:
    """A fold over rows with packed ink; ``step(rows, state, known)`` gives decisions and the next state.

    With ``sized``, ``step`` is a function from a ``Band`` to such a step and each video is folded in its own ``width`` and ``height``. With
    ``isolate``, an exception in a segment becomes one row of the log with its text as ``error``, and other videos go on.
    """

    step: Callable
    carried: dict[str, str]
    local: dict[str, str]
    out: dict[str, str]
    cols: list[str] = field(default_factory=lambda: ["cols"])
    sized: bool = False
    isolate: bool = False

    @property
    def state(self) -> dict[str, str]:
        return self.carried | self.local


def _ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in fields.items())


def _run(fold: FrameFold, rows: DataFrame, entries: DataFrame, want_exit: bool, every: bool) -> DataFrame:
    key_fields = {"video_id": "bigint", SEG: "bigint"}
    out = fold.out | ({"error": "string"} if fold.isolate else {})
    fields = key_fields | fold.state if want_exit else {"video_id": "bigint", "frame_idx": "bigint"} | out
    names, state_names, last = list(fields), list(fold.state), next(iter(fold.local))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({c: [] for c in names})
        entry = right.iloc[0]
        state = None if entry[last] is None else {c: entry[c] for c in state_names}
        left = left.sort_values("frame_idx")
        video = left["video_id"].iat[0]
        try:
            step = fold.step(Band(int(left["width"].iat[0]), int(left["height"].iat[0]))) if fold.sized else fold.step
            log, state = step(left, state, bool(entry["known"]))
            log = [[*r, None] for r in log] if fold.isolate else log
        except Exception as e:
            if not fold.isolate:
                raise
            log = [[left["frame_idx"].iat[0], *[None] * len(fold.out), f"{type(e).__name__}: {e}"]]
        if want_exit:
            state = state or dict.fromkeys(state_names)
            return pd.DataFrame([[video, left[SEG].iat[0], *[state[c] for c in state_names]]], columns=names)
        return pd.DataFrame([[video, *r] for r in log], columns=names)

    by = ["video_id", SEG]
    wanted = rows if every else rows.join(entries.select(*by), by, "left_semi")
    # both sides descend from the same rows, so the entry keys get names of their own
    named = entries.select(F.col("video_id").alias("of_video"), F.col(SEG).alias("of_seg"), "known", *state_names)
    return (wanted.groupBy(*by).cogroup(named.groupBy("of_video", "of_seg"))
            .applyInPandas(run, _ddl(fields)))


def fold_frames(packed: DataFrame, fold: FrameFold, segment: Column | None = None) -> DataFrame:
    """Decision log ``(video_id, frame_idx, …)`` of every video."""
    rows = packed.select("video_id", "frame_idx", *fold.cols,
                         (frame_segment() if segment is None else segment).cast("bigint").alias(SEG))
    rows = stored(rows, "ink")      # one row per frame, read again in each round
    links = _links(rows, "video_id")
    blank = _blank(links, "video_id", fold.state)
    entries = settle_entries(links, "video_id", list(fold.carried), list(fold.local), blank,
                             lambda e: _run(fold, rows, e, want_exit=True, every=e is blank))
    return _run(fold, rows, entries, want_exit=False, every=True)


COMMITTED = {"com": "bigint", "com_cols": "array<bigint>", "scrolled": "boolean"}
LAST = {"last_cols": "array<bigint>"}
MASK_STATE = COMMITTED | LAST
DECISION = {"action": "string", "dx": "int", "peak": "double", "zero": "double", "strip_w": "int", "vetoed": "boolean"}


def scroll_fold(packed: DataFrame, band: Band, segment: Column | None = None) -> DataFrame:
    """Continuous scrolling: append what a confirmed shift reveals."""
    return fold_frames(packed, FrameFold(steps.scroll_step(band), COMMITTED, LAST, DECISION), segment)


def page_fold(packed: DataFrame, band: Band, segment: Column | None = None) -> DataFrame:
    """Page flips: append a page that differs from the confirmed one and has come to rest."""
    return fold_frames(packed, FrameFold(steps.page_step(band), COMMITTED, LAST, DECISION), segment)


def sized_fold(packed: DataFrame, step: Callable, segment: Column | None = None) -> DataFrame:
    """Decision log of videos of any sizes with ``error``; ``step`` is ``steps.scroll_step`` or ``steps.page_step``.

    ``packed`` also has ``width`` and ``height``, the same for all frames of a video. An exception ends its segment with an error row.
    """
    fold = FrameFold(step, COMMITTED, LAST, DECISION, ["cols", "width", "height"], sized=True, isolate=True)
    return fold_frames(packed, fold, segment)


def measure_fold(frames: DataFrame, band: Band, strip_w: int, offset: int, segment: Column | None = None) -> DataFrame:
    """Legacy capture of settled screens up to the last bar; ``frames`` adds ``bar_x`` to packed ink."""
    fold = FrameFold(steps.measure_step(band, strip_w, offset),
                     {"saved_cols": "array<bigint>"}, {"prev_cols": "array<bigint>", "stable": "int"},
                     {"changed": "double", "moved": "double", "fired": "boolean", "captured": "boolean", "x0": "int", "x1": "int"},
                     ["cols", "bar_x"])
    return fold_frames(frames, fold, segment)


def fold_summary(log: DataFrame) -> DataFrame:
    """Event counts and canvas width per video."""
    a = F.col("action")
    return log.groupBy("video_id").agg(
        F.count_if(a == "scroll").alias("scrolls"), F.count_if(a == "page").alias("pages"),
        F.count_if(a.isin("static", "hold", "refresh")).alias("statics"),
        F.count_if("vetoed").alias("rejects"), F.sum("strip_w").alias("canvas_w"))


# ---- folds over scalars, as one aggregate expression per segment

def fold_scalars(rows: DataFrame, key: str, order: str, value: str, carried: dict[str, str], local: dict[str, str],
                 start: Column, merge: Callable, log: str, resume: Callable, guess: Column | None = None) -> DataFrame:
    """Explode of the log that ``merge`` builds while folding each segment's values in order.

    ``rows`` has a ``seg`` column. ``start`` is the accumulator of a first segment, ``resume(state
    columns)`` the one for a carried state and ``guess`` the one where the state is still unknown (it
    may use ``items``); all hold the ``log`` array.
    """
    packed = settle(rows.groupBy(key, SEG)
                    .agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("items")))
    links, state = _links(packed, key), carried | local
    names, blank = list(state), _blank(links, key, state)

    def folded(entries):
        init = (F.when(~F.col("known"), start if guess is None else guess)
                .when(F.col(names[0]).isNotNull(), resume(*[F.col(c) for c in names])).otherwise(start))
        return (packed.join(entries, [key, SEG])
                .select(key, SEG, F.aggregate("items", init, merge).alias("acc")))

    entries = settle_entries(links, key, list(carried), list(local), blank,
                             lambda e: folded(e).select(key, SEG, *[F.col(f"acc.{c}") for c in names]))
    return folded(entries).select(key, F.inline(f"acc.{log}"))


def debounce(rows: DataFrame, key: str, order: str, value: str, change: float = CHANGE_RATIO,
             stable: float = STABLE_RATIO, need: int = STABLE_COUNT) -> DataFrame:
    """Fire once a value has left the saved one and stayed put ``need`` times; firing saves it.

    The first value of a sequence is saved without firing.
    """
    item = f"struct<{order}:bigint,run:int,fired:boolean>"

    def acc(saved, prev, run, log):
        return F.struct(saved.alias("saved"), prev.alias("prev"), run.cast("int").alias("run"), log.alias("log"))

    empty = F.array().cast(f"array<{item}>")
    nothing = F.lit(None).cast("double")

    def ratio(v, base):
        return F.abs(v - base) / F.greatest(F.abs(base), F.lit(1.0))

    def merge(a, x):
        v, fresh = x[value], a["saved"].isNull()
        same = ratio(v, a["saved"]) < change
        still = ratio(v, a["prev"]) < stable
        run = F.when(fresh | same | ~still, 0).otherwise(a["run"] + 1)
        fired = run >= need
        entry = F.struct(x[order].alias(order), run.cast("int").alias("run"), fired.alias("fired"))
        return acc(F.when(fresh | fired, v).otherwise(a["saved"]), v, F.when(fired, 0).otherwise(run),
                   F.concat(a["log"], F.array(entry)))

    return fold_scalars(rows, key, order, value, {"saved": "double"}, {"prev": "double", "run": "int"},
                        acc(nothing, nothing, F.lit(0), empty), merge, "log",
                        lambda s, p, r: acc(s, p, r, empty))
