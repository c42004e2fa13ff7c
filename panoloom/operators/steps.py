"""Sequential rules applied inside one segment of packed frames (shared by batch and stream)."""

from __future__ import annotations

import numpy as np

from panoloom.functions.bits import ones, scores, unpack_columns
from panoloom.operators.match import Band
from panoloom.settings import (CAPTURE_FRACTION, CHANGE_RATIO, CONTENT_MIN, DX_AGREE_TOL, MARGIN, MIN_SCORE,
                               MIN_SHIFT, NEWPAGE_MAX_SCORE, OVERLAP_SCORE, SAME_PAGE_SCORE,
                               SEED_REFRESH_SCORE, STABLE_COUNT, STABLE_PAGE_SCORE, STABLE_RATIO, STABLE_SCORE)


def _bits(cols, band: Band) -> np.ndarray:
    return unpack_columns(cols, band.width, band.words)


def _offset(ref, cur, band, inset):
    s = scores(ref, cur[inset:inset + band.tw], band.height)
    loc = int(np.argmax(s))
    return loc - inset, float(s[loc]), float(s[inset])


def _zero(ref, cur, band):
    return float(scores(ref[:band.tw], cur[:band.tw], band.height)[0])


class _Masks:
    """Committed and last frame of a video, to and from state columns."""

    def __init__(self, band, state):
        self.band = band
        self.com_idx = None if state is None else int(state["com"])
        self.com = None if state is None else _bits(state["com_cols"], band)
        self.last = None if state is None else _bits(state["last_cols"], band)
        self.scrolled = state is not None and bool(state["scrolled"])

    def commit(self, idx, cur):
        self.com_idx, self.com = idx, cur

    def state(self):
        if self.com is None:
            return None
        flat = [m.reshape(-1).view(np.int64).tolist() for m in (self.com, self.last)]
        return {"com": self.com_idx, "com_cols": flat[0], "last_cols": flat[1], "scrolled": self.scrolled}


def _walk(band: Band, decide):
    """Step over frames: skip the blank intro, seed with the first content, then ``decide``."""

    def step(rows, state, known):
        m, log = _Masks(band, state), []
        for idx, cols in zip(rows["frame_idx"].tolist(), rows["cols"]):
            cur = _bits(cols, band)
            if m.com is None:
                if ones(cur).sum() / (band.width * band.height) < CONTENT_MIN:
                    log.append((idx, "skip", None, None, None, 0, False))
                    continue
                m.commit(idx, cur)
                m.scrolled = not known        # a guessed entry is most likely past the first commit
                log.append((idx, "seed", None, None, None, band.width, False))
            else:
                log.append((idx, *decide(m, idx, cur)))
            m.last = cur
        return log, m.state()

    return step


def scroll_step(band: Band):
    def decide(m, idx, cur):
        dx, peak, zero = _offset(m.com, cur, band, 0)
        scroll = (MIN_SHIFT <= dx <= band.width - band.tw and peak >= MIN_SCORE and peak - zero >= MARGIN)
        vetoed = False
        if scroll and dx <= band.reach2:
            dx2, peak2, _ = _offset(m.com, cur, band, band.inset2)
            vetoed = peak2 >= MIN_SCORE and abs(dx - dx2) > DX_AGREE_TOL
        if scroll and not vetoed:
            action, width = "scroll", dx
        elif not m.scrolled and zero >= SEED_REFRESH_SCORE:
            action, width = "refresh", 0
        elif peak >= NEWPAGE_MAX_SCORE:
            action, width = "static", 0
        elif _zero(m.last, cur, band) >= STABLE_SCORE:
            action, width = "page", band.width
        else:
            action, width = "hold", 0
        if action in ("scroll", "refresh", "page"):
            m.commit(idx, cur)
            m.scrolled = m.scrolled or action != "refresh"
        return action, dx, peak, zero, width, vetoed

    return _walk(band, decide)


def page_step(band: Band):
    """``peak`` is the similarity to the confirmed page, ``zero`` that to the previous frame."""
    def decide(m, idx, cur):
        same, still = _zero(m.com, cur, band), _zero(m.last, cur, band)
        flipped = same < SAME_PAGE_SCORE
        if flipped and still >= STABLE_PAGE_SCORE:
            m.commit(idx, cur)
            m.scrolled = True
            return "page", 0, same, still, band.width, False
        if not flipped and not m.scrolled:
            m.commit(idx, cur)
            return "refresh", 0, same, still, 0, False
        return "static", 0, same, still, 0, False

    return _walk(band, decide)


def measure_step(band: Band, strip_w: int, offset: int):
    start, area = band.width - strip_w - offset, band.width * band.height

    def step(rows, state, known):
        log = []
        saved = prev = None
        run = 0
        if state is not None:
            saved, prev, run = _bits(state["saved_cols"], band), _bits(state["prev_cols"], band), int(state["stable"])
        for idx, cols, bar in zip(rows["frame_idx"].tolist(), rows["cols"], rows["bar_x"].tolist()):
            cur = _bits(cols, band)
            if saved is None:
                saved = prev = cur
                log.append((idx, None, None, False, False, None, None))
                continue
            changed, moved = (float(ones(m ^ cur).sum() / area) for m in (saved, prev))
            run = run + 1 if changed >= CHANGE_RATIO and moved < STABLE_RATIO else 0
            fired, x0 = run >= STABLE_COUNT, -1
            if fired and bar != -1 and start > 0:
                s = scores(cur, saved[start:start + strip_w], band.height)
                at = int(np.argmax(s))
                x0 = at + strip_w + offset if s[at] > OVERLAP_SCORE else -1
            captured = x0 != -1 and bar - x0 > band.width * CAPTURE_FRACTION
            if captured:
                saved, run = cur, 0
            prev = cur
            log.append((idx, changed, moved, fired, captured, x0 if captured else None, bar if captured else None))
        flat = [m.reshape(-1).view(np.int64).tolist() for m in (saved, prev)]
        return log, {"saved_cols": flat[0], "prev_cols": flat[1], "stable": run}

    return step
