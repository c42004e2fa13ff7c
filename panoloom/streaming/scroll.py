"""The frame folds as stateful streams keyed by video.

A frame is folded as soon as every frame before it has been; frames that run ahead wait in the state. Where frames are
missing, those waiting go on once the watermark has passed them. So the log depends neither on how files are split into micro-batches
nor on their order, as long as nothing is later than the watermark's delay.

A video that has shown nothing for ``idle`` is over: once the watermark has passed that, its waiting frames are folded, its masks and waiting
frames leave the state, and only a number remains for ``remember``, by which frames that still come are logged as ``late`` instead of seeding a new fold.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from panoloom.functions.bits import scores, unpack_columns
from panoloom.operators.fold import DECISION, MASK_STATE
from panoloom.operators.match import Band
from panoloom.operators.steps import page_step, scroll_step
from panoloom.settings import FLUSH_MIN, OVERLAP_BAND, OVERLAP_OFFSET, OVERLAP_SCORE

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = {"video_id": "bigint", "frame_idx": "bigint"} | DECISION
TAIL = {"video_id": "bigint", "frame_idx": "bigint", "x0": "int", "width": "int"}
LATE = ("late", None, None, None, 0, False)
PART = 512              # due frames folded at a time


class _Fold(StatefulProcessor):
    """State per video: the next frame to fold with the fold's state, and the frames that wait for it.

    Rows come in parts of bounded size and are handled part by part. A frame before the next one is a repeat or came after the
    watermark had passed it; it is logged with action ``late`` and changes nothing.
    """

    def __init__(self, step, idle_ms: int | None = None, remember_ms: int = 0):
        self._step, self._idle, self._remember = step, idle_ms, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        ddl = ", ".join(f"{c} {t}" for c, t in ({"next": "bigint"} | MASK_STATE).items())
        self._handle = handle
        self._state = handle.getValueState("fold", ddl)
        self._waiting = handle.getMapState("waiting", "frame_idx bigint", "at bigint, cols array<bigint>")
        self._ends = handle.getValueState("ends", "at bigint, over boolean")     # when an open video ends, or a closed one is forgotten

    def _end(self, at: int, over: bool) -> None:
        """Move the video's own timer."""
        if self._ends.exists():
            before, was_over = self._ends.get()
            if not over and not was_over and at <= before:
                return
            self._handle.deleteTimer(before)
        self._ends.update((at, over))
        self._handle.registerTimer(at)

    def _load(self):
        if not self._state.exists():
            return 0, None
        nxt, *held = self._state.get()
        return nxt, None if held[0] is None else dict(zip(MASK_STATE, held))

    def _save(self, nxt, state) -> None:
        kept = state or dict.fromkeys(MASK_STATE)
        self._state.update((nxt, *[kept[c] for c in MASK_STATE]))

    def _take(self, idx: int):
        _, cols = self._waiting.getValue((idx,))
        self._waiting.removeKey((idx,))
        return idx, cols

    def _folded(self, frames, state):
        rows = pd.DataFrame(frames, columns=["frame_idx", "cols"])
        return self._step(rows, state, True)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self._ends.exists() and self._ends.get()[1]:
            for part in rows:
                yield pd.DataFrame([[key[0], i, *LATE] for i in sorted(part["frame_idx"].tolist())], columns=list(OUT))
            return
        nxt, state = self._load()
        seen = None
        for part in rows:
            ready, log, ahead = [], [], None
            for idx, cols, at in sorted(zip(part["frame_idx"].tolist(), part["cols"], part["at"].tolist()), key=lambda r: r[0]):
                seen = max(at, at if seen is None else seen)
                if idx < nxt or (idx > nxt and self._waiting.containsKey((idx,))):
                    log.append((idx, *LATE))
                elif idx == nxt:
                    ready.append((idx, cols))
                    nxt += 1
                    while self._waiting.containsKey((nxt,)):
                        ready.append(self._take(nxt))
                        nxt += 1
                else:
                    self._waiting.updateValue((idx,), (at, [int(x) for x in cols]))
                    ahead = max(at, ahead or at)
            if ready:
                done, state = self._folded(ready, state)
                log += done
            if ahead is not None:
                self._handle.registerTimer(ahead + 1)
            if log:
                yield pd.DataFrame([[key[0], *r] for r in log], columns=list(OUT))
        self._save(nxt, state)
        if self._idle is not None and seen is not None:
            self._end(seen + self._idle, False)

    def _due(self, key, mark: int) -> Iterator[pd.DataFrame]:
        nxt, state = self._load()
        due = sorted(k[0] for k, v in self._waiting.iterator() if v[0] < mark)
        while due and self._waiting.containsKey((due[-1] + 1,)):       # what follows without a gap goes along
            due.append(due[-1] + 1)
        for i in range(0, len(due), PART):
            done, state = self._folded([self._take(k) for k in due[i:i + PART]], state)
            yield pd.DataFrame([[key[0], *r] for r in done], columns=list(OUT))
        if due:
            self._save(due[-1] + 1, state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Frames the watermark has passed no longer wait for missing ones; a video without news for long ends, and is forgotten later."""
        mark = timerValues.getCurrentWatermarkInMs()
        at, over = self._ends.get() if self._ends.exists() else (None, False)
        if over:
            if at <= mark:
                self._ends.clear()
            return
        yield from self._due(key, mark)
        if at is not None and at <= mark:
            self._state.clear()
            self._waiting.clear()
            self._end(at + self._remember, True)

    def close(self) -> None:
        pass


def fold_stream(packed: DataFrame, band: Band, opaque: bool = False, ts: str = "ts", delay: str = "10 minutes",
                idle: timedelta | None = None, remember: timedelta = timedelta(days=1)) -> DataFrame:
    """Decision log of a stream of packed frames ``(video_id, frame_idx, cols, <ts>)``, numbered from 0 without gaps.

    ``delay`` is how long frames may be late by their time ``ts``; ``idle`` and ``remember`` bound the state, see above (null keeps videos for ever).
    The session must use the RocksDB state store (``use_rocksdb``).
    """
    step = page_step(band) if opaque else scroll_step(band)
    ddl = ", ".join(f"{c} {t}" for c, t in OUT.items())
    fold = _Fold(step, None if idle is None else milliseconds(idle), milliseconds(remember))
    return (packed.withWatermark(ts, delay).select("video_id", "frame_idx", "cols", ts, F.unix_millis(ts).alias("at")).groupBy("video_id")
            .transformWithStateInPandas(fold, outputStructType=ddl, outputMode="append", timeMode="EventTime"))


class _Tail(StatefulProcessor):
    """State per video: its two highest frames, whatever their order of arrival; they go when the tail is emitted."""

    def __init__(self, band: Band, strip_w: int, offset: int, least: int, idle_ms: int):
        self._band, self._strip, self._offset, self._least, self._idle = band, strip_w, offset, least, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", "frame_idx bigint, cols array<bigint>, before bigint, before_cols array<bigint>, at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        top, at = {}, None
        if self._last.exists():
            i, cols, j, other, at = self._last.get()
            top = {i: cols} if j is None else {i: cols, j: other}
            self._handle.deleteTimer(at)
        for part in rows:
            for idx, cols, ts in zip(part["frame_idx"].tolist(), part["cols"], part["at"].tolist()):
                top[idx] = [int(x) for x in cols]
                top = {i: top[i] for i in sorted(top)[-2:]}
                at = max(ts + self._idle, ts + self._idle if at is None else at)
        *before, last = sorted(top)
        self._last.update((last, top[last], before[0] if before else None, top[before[0]] if before else None, at))
        self._handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        idx, cols, before, before_cols, _ = self._last.get()
        self._last.clear()
        if before is None:
            return
        band, start = self._band, self._band.width - self._strip - self._offset
        cur, old = (unpack_columns(c, band.width, band.words) for c in (cols, before_cols))
        x0 = 0
        if start > 0:
            s = scores(cur, old[start:start + self._strip], band.height)
            x0 = int(s.argmax()) + self._strip + self._offset if s.max() > OVERLAP_SCORE else 0
        if band.width - x0 > self._least:
            yield pd.DataFrame([[key[0], idx, x0, band.width - x0]], columns=list(TAIL))

    def close(self) -> None:
        pass


def tail_stream(packed: DataFrame, band: Band, strip_w: int = OVERLAP_BAND, offset: int = OVERLAP_OFFSET, least: int = FLUSH_MIN,
                ts: str = "ts", delay: str = "10 minutes", idle: timedelta = timedelta(minutes=1)) -> DataFrame:
    """What each video's last screen shows beyond its overlap with the one before, once the watermark is ``idle`` past its last frame.

    ``(video_id, frame_idx, x0, width)`` where it is wide enough, as ``sampling.flush_tail`` gives for finished videos.
    """
    ddl = ", ".join(f"{c} {t}" for c, t in TAIL.items())
    return (packed.withWatermark(ts, delay).select("video_id", "frame_idx", "cols", ts, F.unix_millis(ts).alias("at")).groupBy("video_id")
            .transformWithStateInPandas(_Tail(band, strip_w, offset, least, milliseconds(idle)), outputStructType=ddl, outputMode="append", timeMode="EventTime"))


def milliseconds(span: timedelta) -> int:
    return span // timedelta(milliseconds=1)


def use_rocksdb(spark) -> None:
    spark.conf.set(PROVIDER, ROCKS)
