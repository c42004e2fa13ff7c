"""Removal of repeated text by suffix sorting.

Every byte that a string of ``LENGTH`` bytes covers which also starts anywhere else in the corpus is removed. The work is in three parts.

*Anchors.* Among the ``GRAM``-byte strings inside a window of ``LENGTH`` bytes, the one with the smallest hash is the window's anchor. Equal windows
have equal anchors at equal places, so windows with different anchors need no comparison. The windows of one anchor are
neighbours, and the bytes they cover are its context. Anchors that occur once in the corpus end here.

*Suffixes.* Contexts with the same anchor that are equal repeat all their windows; they are counted, once per
(anchor, context). Only different contexts of one anchor are sorted: groups of contexts get suffix arrays by two-stage sorting, and
adjacent common prefixes of ``LENGTH`` or more show the repeated windows. An anchor with very many different contexts is dealt to
several groups; each then also returns one digest per different window, and the digests that several groups share are repeated as
well.

*Removal.* Repeated windows return to their documents as byte ranges, are joined there, and the rest is hashed.

A task holds a bounded piece of some texts, a bounded group of contexts, or the ranges of one document. Anchors and contexts are combined before
they are shuffled; the last join is by (document, text).

Defined cases: null texts are empty; texts shorter than ``LENGTH`` lose nothing; a repeated row repeats its text; an empty table gives an empty
result; other columns are ignored. Anchors and contexts are told apart by 64-bit hashes each; windows of different contexts
are compared byte by byte, except between the groups of one very frequent anchor, where anchor and window hash, 128 bits, decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from . import suffixes as sx
from . import words as wd

LENGTH, GRAM = 200, 64
GROUP = 8192            # different contexts of one anchor that are sorted together: under 3 MB of text
CHUNK_BYTES = 1 << 20   # contexts that are sorted at once
POSITION = np.uint64((1 << 32) - 1)
ANCHORS = f"h long, c long, {c.KEY[0]} long, {c.KEY[1]} long, at long, windows int, n int, more binary"


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours, from running minima of blocks in both directions."""
    n = len(v) - w + 1
    if n <= 0:
        return v[:0]
    blocks = np.full(-(-len(v) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    blocks[:len(v)] = v
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[w - 1:w - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Anchors of the texts of one slice: (document, first window, number of windows, anchor hash, context hash)."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums, inverse = wd.prefix_hash(data), wd.powers(len(data) + 1)[1]
    n = len(data) - gram + 1
    g = wd.scramble((sums[gram:] - sums[:n]) * inverse[:n])
    v = (g & ~POSITION) | np.arange(n, dtype=np.uint64)          # ties go to the leftmost, in any slice
    at = (sliding_min(v, length - gram + 1) & POSITION).astype(np.int64)
    room = np.diff(offsets) - length + 1
    docs = np.flatnonzero(room > 0)
    first = np.repeat(offsets[docs] - np.concatenate([[0], np.cumsum(room[docs])[:-1]]), room[docs])
    p = first + np.arange(len(first))                            # windows that stay inside their document
    doc = np.repeat(docs, room[docs])
    if not len(p):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    a = at[p]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])])
    run = np.flatnonzero(new)
    many = np.diff(np.append(run, len(p)))
    lo, a = p[run], a[run]
    shape = ((a - lo) << 16 | many).astype(np.uint64)
    text = (sums[lo + many - 1 + length] - sums[lo]) * inverse[lo]
    return doc[run], lo, many, g[a], wd.scramble(text ^ wd.scramble(shape))


def _merged(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint ranges that cover the same, touching ones joined."""
    by = np.argsort(s, kind="stable")
    s, e = s[by], np.maximum.accumulate(e[by])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)
    return s[new], e[last]


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(*c.row_key("doc_id", text_col), F.col("doc_id").cast("long"), c.text_of(text_col).alias("__text"))


def _pieces(column, piece: int, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, first byte, bytes, borders): slices of texts, and a long text in pieces that share no window."""
    for first, data, offsets in wd.slices(column, piece):
        if len(offsets) > 2 or len(data) <= 2 * piece:
            yield first, 0, data, offsets
            continue
        for s in range(0, len(data) - length + 1, piece):
            part = data[s:s + piece + length - 1]
            yield first, s, part, np.array([0, len(part)])


def find_anchors(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, text_col: str = "text", hashes_only: bool = False,
                 piece: int = wd.SLICE_BYTES) -> DataFrame:
    """``ANCHORS`` of all texts; equal contexts inside one text are one row with their number and their byte ranges.

    ``piece`` bytes are worked on at a time. A context that a long text's pieces divide is two contexts of one anchor, which ``compare`` handles.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, begin, data, offsets in _pieces(batch.column("__text"), piece, length):
                doc, lo, many, h, ctx = anchors(data, offsets, length, gram)
                if not len(doc):
                    continue
                key = wd.scramble(h ^ wd.scramble(ctx + doc.astype(np.uint64)))
                _, one, which, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                if hashes_only:
                    yield pa.RecordBatch.from_arrays([pa.array(h[one].view(np.int64)), pa.array(n.astype(np.int32))], ["h", "n"])
                    continue
                more: list[bytes | None] = [None] * len(one)
                if (n > 1).any():
                    by = np.argsort(which, kind="stable")
                    edge = np.concatenate([[0], np.cumsum(n)])
                    for k in np.flatnonzero(n > 1):
                        m = by[edge[k]:edge[k + 1]]
                        s = begin + lo[m] - offsets[doc[m]]
                        more[k] = np.stack(_merged(s, s + many[m] - 1 + length), 1).astype(np.int64).tobytes()
                rows = pa.array(first + doc[one])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[one].view(np.int64)), pa.array(ctx[one].view(np.int64)), batch.column(c.KEY[0]).take(rows),
                     batch.column(c.KEY[1]).take(rows), pa.array(begin + lo[one] - offsets[doc[one]]), pa.array(many[one].astype(np.int32)),
                     pa.array(n.astype(np.int32)), pa.array(more, pa.binary())],
                    [f.split()[0] for f in ANCHORS.split(", ")])

    return _texts(docs, text_col).mapInArrow(run, "h long, n int" if hashes_only else ANCHORS)


def _contexts(docs: DataFrame, wanted: DataFrame, length: int, text_col: str) -> DataFrame:
    """``h, c, n, m, windows, bytes`` of the wanted contexts, cut from their documents."""
    lists = wanted.groupBy(*c.KEY).agg(F.collect_list(F.struct("at", "windows", "h", "c", "n", "m")).alias("w"))   # bounded by the text
    rows = _texts(docs, text_col).join(lists, list(c.KEY)).select("__text", "w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                flat = part.column("w").flatten()
                size = part.column("w").value_lengths().to_numpy()
                at, windows = flat.field("at").to_numpy(), flat.field("windows").to_numpy()
                texts = part.column("__text").cast(pa.large_binary()).to_pylist()
                cut = [texts[t][a:a + k - 1 + length] for t, a, k in zip(np.repeat(np.arange(len(size)), size), at, windows)]
                yield pa.RecordBatch.from_arrays([flat.field(x) for x in ("h", "c", "n", "m", "windows")] + [pa.array(cut, pa.binary())],
                                                 ["h", "c", "n", "m", "windows", "bytes"])

    return rows.mapInArrow(run, "h long, c long, n long, m long, windows int, bytes binary")


def _runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2] - 1


def compare(contexts: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """``h, c, first, last, digest``: windows of contexts that repeat in their group (digest null), and of every window of an
    anchor with several groups one row per different window (``last`` is null where it does not repeat in its group)."""
    deal = F.when(F.col("m") > group, F.pmod(F.xxhash64("c"), F.ceil(F.col("m") / group))).otherwise(F.lit(0))
    rows = contexts.withColumn("part", deal.cast("long")).repartition(c.tasks(contexts.sparkSession), "h", "part").sortWithinPartitions("h", "part", "c")
    shape = "h long, c long, first int, last int, digest long"

    def solve(h, ctx, n, m, windows, strings):
        keep = np.concatenate([[True], (h[1:] != h[:-1]) | (ctx[1:] != ctx[:-1])])      # repeated rows of one text
        h, ctx, n, m, windows = (x[keep] for x in (h, ctx, n, m, windows))
        strings = [s for s, k in zip(strings, keep) if k]
        flags, classes = sx.repeated(strings, windows.tolist(), length)
        out = []
        for k, f in enumerate(flags):
            if n[k] < 2 and f.any():
                out += [(h[k], ctx[k], int(s), int(e), None) for s, e in zip(*_runs_of(f))]
        large = np.flatnonzero(m > group)
        if len(large):
            edge = np.concatenate([[0], np.cumsum(windows)])
            seen = set()
            for k in large:
                data = np.frombuffer(strings[k], np.uint8)
                sums, inverse = wd.prefix_hash(data), wd.powers(len(data) + 1)[1]
                at = np.arange(windows[k])
                digest = wd.scramble((sums[at + length] - sums[at]) * inverse[at]).view(np.int64)
                twice = flags[k] | (n[k] > 1)
                for i in at:
                    if classes[edge[k] + i] not in seen:
                        seen.add(classes[edge[k] + i])
                        out.append((h[k], ctx[k], int(i), int(i) if twice[i] else None, int(digest[i])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush():
            t = pa.Table.from_batches(held)
            held.clear()
            cols = [t.column(x).to_numpy() for x in ("h", "c", "n", "m", "windows")]
            out = solve(*cols, t.column("bytes").to_pylist())
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kinds[k]) for k in range(5)], ["h", "c", "first", "last", "digest"])

        total, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column("h").to_numpy(), batch.column("part").to_numpy()], 1)
            size = np.cumsum(pa.compute.binary_length(batch.column("bytes")).to_numpy())
            cuts = np.append(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, batch.num_rows)
            begin = done = 0
            if held and total > CHUNK_BYTES and tuple(key[0]) != last:
                yield flush()
                total = 0
            for end in cuts.tolist():
                if total + size[end - 1] - done > CHUNK_BYTES and end < batch.num_rows:
                    held.append(batch.slice(begin, end - begin))
                    yield flush()
                    begin, done, total = end, size[end - 1], 0
            held.append(batch.slice(begin))
            total += size[-1] - done
            last = tuple(key[-1])
        if held:
            yield flush()

    return rows.select("h", "part", "c", "n", "m", "windows", "bytes").mapInArrow(run, shape)


def repeated_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, text_col: str = "text",
                     piece: int = wd.SLICE_BYTES) -> DataFrame:
    """``KEY, ranges``: byte ranges ``s, e`` of all repeated strings of ``length`` bytes, per document that has any."""
    often = find_anchors(docs, length, gram, text_col, True, piece).groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    rows = c.stored(find_anchors(docs, length, gram, text_col, False, piece).join(often, "h", "left_semi"), "anchors")
    each = rows.groupBy("h", "c").agg(F.sum("n").alias("n"), F.min(F.struct(*c.KEY, "at", "windows")).alias("f"))
    each = c.stored(each.select("h", "c", "n", "f.*"), "contexts")
    # written, so that the join below shuffles both sides and adaptive execution can split an anchor with very many contexts
    kinds = c.stored(each.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "kinds")
    found = c.stored(compare(_contexts(docs, each.join(kinds, "h"), length, text_col), length, group), "suffixes")
    shared = found.where("digest is not null").groupBy("h", "digest").agg(F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    late = found.where("digest is not null and last is null").join(shared, ["h", "digest"]).select("h", "c", "first", F.col("first").alias("last"))
    part = found.where("digest is null").select("h", "c", "first", "last").unionByName(late)
    part = part.groupBy("h", "c").agg(F.collect_set(F.struct("first", "last")).alias("runs"))              # at most the windows of one anchor
    known = each.where("n > 1").select("h", "c", F.lit(None).cast(part.schema["runs"].dataType).alias("runs")).unionByName(
        part.join(each.where("n > 1").select("h", "c"), ["h", "c"], "left_anti"))
    back = rows.join(known, ["h", "c"]).select(*c.KEY, "at", "windows", "more", F.explode(F.coalesce(
        "runs", F.array(F.struct(F.lit(0).alias("first"), (F.col("windows") - 1).alias("last"))))).alias("r"))
    spans = back.select(*c.KEY, F.struct((F.col("at") + F.col("r.first")).alias("s"), (F.col("at") + F.col("r.last") + length).alias("e")).alias("x"), "more")
    return spans.groupBy(*c.KEY).agg(F.collect_list("x").alias("ranges"), F.collect_list("more").alias("more"))     # bounded by the text


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, text_col: str = "text",
                   keep_text: bool = False, piece: int = wd.SLICE_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document, and with ``keep_text`` the bytes that are left (``kept``)
    and the removed ranges (``removed``)."""
    ranges = repeated_windows(docs, length, gram, group, text_col, piece)
    rows = _texts(docs, text_col).join(ranges, list(c.KEY), "left").select("doc_id", "__text", "ranges", "more")
    more = ", kept binary, removed array<struct<s:long,e:long>>" if keep_text else ""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()] + ([pa.binary(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))] if keep_text else [])
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + (["kept", "removed"] if keep_text else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans, extra in zip(batch.column("__text").cast(pa.large_binary()), batch.column("ranges"), batch.column("more")):
                b = text.as_py()
                if not spans.is_valid:
                    out.append((len(b), 0, 0, hashlib.sha256(b).hexdigest(), b, []))
                    continue
                x = spans.values
                s, e = x.field("s").to_numpy(), x.field("e").to_numpy()
                if len(extra.values):
                    pairs = np.frombuffer(b"".join(extra.as_py()), np.int64).reshape(-1, 2)
                    s, e = np.concatenate([s, pairs[:, 0]]), np.concatenate([e, pairs[:, 1]])
                s, e = _merged(s, e)
                left = b"".join(b[i:j] for i, j in zip(np.append(0, e), np.append(s, len(b))))
                out.append((len(b), int((e - s).sum()), len(s), hashlib.sha256(left).hexdigest(), left, [{"s": i, "e": j} for i, j in zip(s.tolist(), e.tolist())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")] + [pa.array([o[k] for o in out], kinds[k]) for k in range(len(kinds))], ["doc_id", *names])

    return rows.mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string{more}")


def op1_suffix_dedup(spark, sf_dir):
    """Repeated strings of 200 bytes removed from all documents."""
    return remove_repeats(c.read(spark, sf_dir, "documents"))


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
