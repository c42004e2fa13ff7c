"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of word shingles. Equal sets form a class. MinHash bands give buckets of classes; buckets with the same
members are searched once. Pairs inside a bucket compare their MinHash values a few at a time and are dropped as soon as the
posterior probability that their Jaccard similarity reaches the threshold falls below a tolerance. Classes connected by remaining pairs
meet, once per component, and every remaining pair is verified on whole shingle sets.

Pairs exist only inside a task. Buckets and components of any size are cut into blocks of bounded size, and a task sees
two blocks; it returns a spanning forest of what it found, or a number of links per class, so output stays linear in
the members and a block pair's work is bounded. Nothing is capped: all block pairs are compared.

Band misses: with 30 bands of 4 rows a pair at exactly 0.8 shares no band with probability 1.4e-7. The tolerance adds
about as much as its value per comparison step for pairs at the threshold.

Defined cases: words are lower-cased runs of visible characters; a text of fewer than ``n`` words is one shingle; null
texts and texts without words form one class without links; repeated rows are copies and share a class; ids may be null or repeat (see ``near_duplicates``); an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from . import words as wd
from .components import components

BANDS, ROWS = 30, 4
HASHES = BANDS * ROWS
STEP = 8                # MinHash values compared at a time
TOLERANCE = 1e-6
THRESHOLD = 0.8
SHINGLE = 5
SIGNATURE_BLOCK = 512   # members of a bucket block
SET_BLOCK = 256         # members of a component block
_RNG = np.random.default_rng(6)
MULTIPLY = _RNG.integers(1, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
FLIP = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def posterior(matches: int, compared: int, threshold: float) -> float:
    """P(similarity >= threshold) after ``matches`` of ``compared`` equal values, from a uniform prior.

    The posterior is a beta distribution; its upper tail is a binomial sum.
    """
    n = compared + 1
    return sum(comb(n, k) * threshold ** k * (1 - threshold) ** (n - k) for k in range(matches + 1))


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For each step, the smallest number of matches that keeps a pair."""
    return [next((m for m in range(n + 1) if posterior(m, n, threshold) >= tolerance), n + 1)
            for n in range(STEP, HASHES + 1, STEP)]


def doc_sets(column, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every text, in order."""
    for w in wd.words(column):
        doc, h = wd.shingles(w, n)
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        doc, h = doc[new], h[new]
        edge = np.searchsorted(doc, np.arange(len(w.offsets)))
        for i in range(len(w.offsets) - 1):
            yield h[edge[i]:edge[i + 1]]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """uint32 MinHash values of non-empty sets, one row per set."""
    edge = np.cumsum([0] + [len(s) for s in sets])
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat((x ^ FLIP[k]) * MULTIPLY[k], edge[:-1])
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """int64 keys, one column per band."""
    keys = np.zeros((len(sig), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        keys = wd.scramble(keys + sig[:, r::ROWS])
    return keys.view(np.int64)


def _runs(column, n: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Sets of the documents of a batch, about a million shingles at a time."""
    first, held, total = 0, [], 0
    for s in doc_sets(column, n):
        held.append(s)
        total += len(s)
        if total > 1 << 18:
            yield first, held
            first, held, total = first + len(held), [], 0
    if held:
        yield first, held


def sketch(docs: DataFrame, n: int = SHINGLE, text_col: str = "text") -> DataFrame:
    """``KEY, doc_id, set1, set2, sig, bands``: set digest, 16-bit MinHash values and band keys; no text."""
    rows = docs.select(*c.row_key("doc_id", text_col), F.col("doc_id").cast("long"), c.text_of(text_col).alias("__text"))
    names = [*c.KEY, "doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets in _runs(batch.column("__text"), n):
                some = [s for s in sets if len(s)]
                size = np.array([len(s) for s in sets])
                one, two = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                sig = np.zeros((len(sets), HASHES), np.uint16)
                keys = np.zeros((len(sets), BANDS), np.int64)
                if some:
                    flat, edge = np.concatenate(some), np.cumsum([0] + [len(s) for s in some])[:-1]
                    one[size > 0] = np.add.reduceat(wd.scramble(flat), edge)
                    two[size > 0] = np.add.reduceat(wd.scramble(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)), edge)
                    full = signatures(some)
                    sig[size > 0] = ((full * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.uint16)
                    keys[size > 0] = band_keys(full)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum((size > 0) * BANDS)]).astype(np.int32), keys[size > 0].reshape(-1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(x).slice(first, len(sets)) for x in names]
                    + [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                       pa.array([r.tobytes() for r in sig], pa.binary()), lists],
                    [*names, "set1", "set2", "sig", "bands"])

    return rows.mapInArrow(run, f"{c.KEY[0]} long, {c.KEY[1]} long, doc_id long, set1 long, set2 long, sig binary, bands array<long>")


def classes(sketches: DataFrame) -> DataFrame:
    """One row per different set: ``cid`` (a long), its first member's ``KEY`` and ``first_id`` (null only where no member has an id), signature, bands, ``n_copies``."""
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), *c.KEY)
    agg = sketches.groupBy("set1", "set2").agg(
        F.min(first).alias("f"), F.min_by(F.struct("sig", "bands", F.col("doc_id").alias("first_id")), first).alias("v"), F.count(F.lit(1)).alias("n_copies"))
    return agg.select("set1", "set2", F.xxhash64("set1", "set2").alias("cid"), *[f"f.{k}" for k in c.KEY], "v.*", "n_copies")


def in_blocks(rows: DataFrame, group: str, size: str, block: int) -> DataFrame:
    """Rows once per pair of blocks they take part in: ``<group>, lo, hi, at`` with ``at`` the row's own block.

    A group of ``size`` rows has ``ceil(size / block)`` blocks; every pair of blocks, and each block with itself, is a task.
    """
    k = F.ceil(F.col(size) / F.lit(block)).cast("int")
    rows = rows.withColumn("at", F.pmod(F.xxhash64("cid", F.lit(7)), k).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), k - 1)))
    rows = rows.withColumn("lo", F.least("at", "other")).withColumn("hi", F.greatest("at", "other")).drop("other", size)
    n = c.tasks(rows.sparkSession)
    return rows.repartition(n, group, "lo", "hi").sortWithinPartitions(group, "lo", "hi")


def _groups(batches: Iterator[pa.RecordBatch], group: str) -> Iterator[dict]:
    """Consecutive rows of equal (group, lo, hi), as columns."""
    held: list[pa.RecordBatch] = []

    def columns(parts):
        t = pa.Table.from_batches(parts)
        return {x: t.column(x) for x in t.column_names}
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(x).to_numpy() for x in (group, "lo", "hi")], 1)
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        if held and last is not None and tuple(key[0]) != last:
            yield columns(held)
            held = []
        edges = [0, *cuts.tolist(), batch.num_rows]
        for i in range(len(edges) - 1):
            held.append(batch.slice(edges[i], edges[i + 1] - edges[i]))
            if i < len(edges) - 2:
                yield columns(held)
                held = []
        last = tuple(key[-1])
    if held:
        yield columns(held)


def kept_pairs(sig: np.ndarray, at: np.ndarray, lo: int, hi: int, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, one from either block, that survive all steps."""
    if lo == hi:
        i, j = np.triu_indices(len(sig), 1)
    else:
        a, b = np.flatnonzero(at == lo), np.flatnonzero(at == hi)
        i, j = np.repeat(a, len(b)), np.tile(b, len(a))
    matches = np.zeros(len(i), np.int32)
    for step, need in enumerate(least):
        if not len(i):
            break
        part = sig[:, step * STEP:(step + 1) * STEP]
        matches = matches + (part[i] == part[j]).sum(axis=1, dtype=np.int32)
        keep = matches >= need
        if not keep.all():
            i, j, matches = i[keep], j[keep], matches[keep]
    return i, j


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest row connected to each row by the pairs; labels sink until nothing moves."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _signature_matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


def candidates(known: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """Edges ``a, b`` (class ids) that connect the classes of every pair that pruning leaves."""
    least = least_matches(threshold, tolerance)
    rows = known.select("cid", F.explode("bands").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("cid").cast("decimal(38,0)")).alias("who"))
    sizes = sizes.where("n > 1").groupBy("n", "who").agg(F.min("bucket").alias("bucket"))      # equal member lists once
    member = rows.join(sizes.select("bucket", "n"), "bucket").join(known.select("cid", "sig"), "cid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, "bucket"):
            sig, cid = _signature_matrix(g["sig"]), g["cid"].to_numpy()
            i, j = kept_pairs(sig, g["at"].to_numpy(), g["lo"][0].as_py(), g["hi"][0].as_py(), least)
            label = forest(i, j, len(cid))
            moved = label != np.arange(len(cid))
            if moved.any():
                yield pa.RecordBatch.from_arrays([pa.array(cid[moved]), pa.array(cid[label[moved]])], ["a", "b"])

    return in_blocks(member, "bucket", "n", SIGNATURE_BLOCK).mapInArrow(run, "a long, b long")


def common_counts(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs of sets."""
    if len(i) <= 2 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)], np.int64)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    value, col = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, len(value), 4096):
        s, e = np.searchsorted(col, [first, first + 4096])
        m = np.zeros((len(sets), 4096), np.float32)
        m[row[s:e], col[s:e] - first] = 1
        out += m @ m.T
    return out[i, j].astype(np.int64)


def verify(docs: DataFrame, known: DataFrame, member: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD,
           tolerance: float = TOLERANCE) -> DataFrame:
    """``kind, a, b`` from exact checks inside components: kind 0 has ``b`` links of class ``a`` within one pair of blocks,
    kind 1 connects two linked classes."""
    least = least_matches(threshold, tolerance)
    size = member.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    wanted = known.select("cid", *c.KEY, "sig").join(member.join(size, "component"), F.col("cid") == F.col("node")).drop("node")
    texts = docs.select(*c.row_key(), c.text_of().alias("__text"))
    rows = texts.join(wanted, list(c.KEY)).select("component", "n", "cid", "sig", "__text")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets in _runs(batch.column("__text"), n):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(x).slice(first, len(sets)) for x in ("component", "n", "cid", "sig")]
                    + [pa.array([s.tobytes() for s in sets], pa.binary())], ["component", "n", "cid", "sig", "items"])

    rows = rows.mapInArrow(sets_of, "component long, n long, cid long, sig binary, items binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, "component"):
            cid, sig = g["cid"].to_numpy(), _signature_matrix(g["sig"])
            order = np.argsort(cid, kind="stable")
            order = order[np.concatenate([[True], np.diff(cid[order]) != 0])]      # repeated rows of one text
            cid, sig, at = cid[order], sig[order], g["at"].to_numpy()[order]
            items = g["items"].take(pa.array(order))
            sets = [np.frombuffer(b, np.uint64) for b in items.to_pylist()]
            i, j = kept_pairs(sig, at, g["lo"][0].as_py(), g["hi"][0].as_py(), least)
            if not len(i):
                continue
            size = np.array([len(s) for s in sets])
            both = common_counts(sets, i, j)
            linked = both >= threshold * (size[i] + size[j] - both) - 1e-9
            i, j = i[linked], j[linked]
            links = np.bincount(np.concatenate([i, j]), minlength=len(cid))
            some = np.flatnonzero(links)
            label = forest(i, j, len(cid))
            moved = np.flatnonzero(label != np.arange(len(cid)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([0, 1], [len(some), len(moved)]).astype(np.int32)),
                 pa.array(np.concatenate([cid[some], cid[moved]])),
                 pa.array(np.concatenate([links[some], cid[label[moved]]]).astype(np.int64))], ["kind", "a", "b"])

    return in_blocks(rows, "component", "n", SET_BLOCK).mapInArrow(run, "kind int, a long, b long")


def near_duplicates(docs: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """``KEY, doc_id, class_id, n_copies, n_links, group_id, is_first, class_key, group_key``, one row per document.

    ``class_id`` is the smallest doc_id with the same shingle set, ``n_links`` the number of other classes at or above the
    threshold, ``group_id`` the smallest doc_id connected by links; both are null where no member has an id. ``class_key`` and ``group_key``
    are hashes of shingle sets and stay apart where ids are null or repeat. ``is_first`` marks one text key of each group.
    """
    sketches = c.stored(sketch(docs, n), "sketches")
    known = c.stored(classes(sketches), "classes")
    member = components(candidates(known, threshold, tolerance))
    found = c.stored(verify(docs, known, member, n, threshold, tolerance), "links")
    links = found.where("kind = 0").groupBy(F.col("a").alias("cid")).agg(F.sum("b").alias("n_links"))
    group = components(found.where("kind = 1").select("a", "b"), "gid")
    per = (known.select("set1", "set2", "cid", *c.KEY, "first_id", "n_copies").join(links, "cid", "left")
           .join(group, F.col("cid") == F.col("node"), "left").drop("node")
           .withColumn("gid", F.coalesce("gid", "cid")))
    first = per.groupBy(F.col("gid").alias("g")).agg(F.min(F.struct(F.col("first_id").isNull().alias("unnamed"), *c.KEY, "first_id")).alias("f"))
    per = per.join(first, F.col("gid") == F.col("g")).select(
        "set1", "set2", F.col("first_id").alias("class_id"), "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.col("f.first_id").alias("group_id"), *[F.col(f"f.{k}").alias(f"__first{k}") for k in c.KEY], F.col("cid").alias("class_key"), F.col("gid").alias("group_key"))
    return sketches.select(*c.KEY, "doc_id", "set1", "set2").join(per, ["set1", "set2"]).select(
        *c.KEY, "doc_id", "class_id", "n_copies", "n_links", "group_id",
        ((F.col(c.KEY[0]) == F.col(f"__first{c.KEY[0]}")) & (F.col(c.KEY[1]) == F.col(f"__first{c.KEY[1]}"))).alias("is_first"), "class_key", "group_key")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each group; the columns stay."""
    first = near_duplicates(docs, **options).where("is_first").select(*c.KEY).distinct()
    return docs.select("*", *c.row_key()).join(first, list(c.KEY), "left_semi").dropDuplicates(list(c.KEY)).drop(*c.KEY)


def op6_jaccard_join(spark, sf_dir):
    """Near copies of all documents: class, links and group of each."""
    return near_duplicates(c.read(spark, sf_dir, "documents")).select(
        "doc_id", "class_id", "n_copies", "n_links", "group_id", "class_key", "group_key")


QUERIES = {"op6_jaccard_join": op6_jaccard_join}
