"""Vector codes by equal-average search.

Vectors are cut into ``PARTS`` equal consecutive parts of integers, ``floor(SCALE * x)``. Each part position has a codebook of up to ``ENTRIES``
entries, which starts as that part of the vectors with the smallest ids and is moved ``ROUNDS`` times: every part goes to its nearest entry
(squared distance, ties to the lower index), and every entry becomes the floor of the mean of its parts; unused entries stay.

*Equal-average search.* The entries of a codebook are sorted by the sum of their components. For a part, entries are visited outward from its own sum, the nearer
sum first. By the Cauchy-Schwarz inequality the squared distance is at least the squared gap between the sums over the dimension, so the search of a part ends when
that strictly exceeds its best distance; equal distances are still visited, so ties stay exact.

A round is one map over the vectors: a task adds up its parts per entry and returns at most ``PARTS * ENTRIES`` rows, which are added up in Spark. Only codebooks,
``ENTRIES`` times the dimension, pass through the driver; a round that is lost with an executor is computed again from the table.

Defined cases: a vector that is null or holds null or non-finite components is dropped; so is one of another length than that of the first kept row by
(id, vector), and all are if that length is 0 or no multiple of ``PARTS``; repeated ids are rows of their own, of which the first by vector start codebooks; null ids come last;
fewer than ``ENTRIES`` vectors give as many entries; an empty table gives an empty result. Components of any size are computed exactly (beyond 2^26 with
integers of any length); errors and their sums stop at the largest long. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
EXACT = 1 << 26         # smaller components are held in 64 bits, and so are sums over a block
LARGEST = (1 << 63) - 1
BLOCK = 4096


def usable(df: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """Rows whose vector holds finite components only."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(v.isNotNull() & ~F.coalesce(bad, F.lit(True)))


def integers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """``floor(scale * x)`` as 64-bit integers where they are small, else as Python integers."""
    y = np.floor(x.astype(np.float64) * scale)
    if y.size == 0 or np.abs(y).max() < EXACT:
        return y.astype(np.int64)
    big = np.frompyfunc(lambda t: math.floor(t * scale) if math.isfinite(t * scale) else int(t) * scale, 1, 1)
    return np.asarray(big(x.astype(np.float64)), object)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the entry of ``book`` nearest to each row of ``x``, ties to the lower index."""
    n, dim = x.shape
    if x.dtype != book.dtype or x.dtype != object and 2 * dim * max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)) >= 1 << 31:
        x, book = x.astype(object), book.astype(object)      # squared gaps would leave 64 bits
    sums = book.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    ranked, mine = sums[order], x.sum(axis=1)
    right = np.searchsorted(ranked, mine)
    left = right - 1
    best = np.full(n, -1, x.dtype)
    which = np.full(n, len(book), np.int64)
    live = np.arange(n)
    while len(live):
        lo, hi, s = left[live], right[live], mine[live]
        has_lo, has_hi = lo >= 0, hi < len(book)
        gap_lo, gap_hi = s - ranked[np.maximum(lo, 0)], ranked[np.minimum(hi, len(book) - 1)] - s
        down = has_lo & (~has_hi | (gap_lo <= gap_hi).astype(bool))
        gap = np.where(down, gap_lo, gap_hi)
        so_far = best[live]
        go = (has_lo | has_hi) & ((so_far < 0) | (gap * gap <= dim * so_far)).astype(bool)
        live, down, lo, hi = live[go], down[go], lo[go], hi[go]
        e = order[np.where(down, lo, hi)]
        left[live], right[live] = np.where(down, lo - 1, lo), np.where(down, hi, hi + 1)
        diff = x[live] - book[e]
        d = (diff * diff).sum(axis=1)
        b, w = best[live], which[live]
        better = ((b < 0) | (d < b) | ((d == b) & (e < w))).astype(bool)
        best[live[better]], which[live[better]] = d[better], e[better]
    return which, best


def _blocks(batch: pa.RecordBatch, vector_col: str, dim: int, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of the batch, integer vectors) of all vectors of length ``dim``, a bounded number at a time."""
    column = batch.column(vector_col)
    fits = np.flatnonzero(pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == dim)
    for i in range(0, len(fits), BLOCK):
        rows = fits[i:i + BLOCK]
        flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        yield rows, integers(flat.reshape(len(rows), dim), scale)


def _dtype(v: np.ndarray) -> np.ndarray:
    return v.astype(np.int64) if v.dtype == object and max((abs(t) for t in v.flat), default=0) < EXACT else v



SUMS = "p int, e int, n long, sums array<string>"        # sums of any size


def _count(total: dict, key: tuple[int, int], n: int, sums: list[int]) -> None:
    held = total.get(key)
    total[key] = (n, sums) if held is None else (held[0] + n, [a + b for a, b in zip(held[1], sums)])


def _sums(total: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in total], pa.int32()), pa.array([k[1] for k in total], pa.int32()), pa.array([v[0] for v in total.values()], pa.int64()),
         pa.array([[str(t) for t in v[1]] for v in total.values()], pa.list_(pa.string()))], ["p", "e", "n", "sums"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the tasks' rows of each entry; a partition holds some of at most ``parts * entries`` entries."""
    total: dict[tuple[int, int], tuple] = {}
    for batch in batches:
        for r in batch.to_pylist():
            _count(total, (r["p"], r["e"]), r["n"], [int(t) for t in r["sums"]])
    yield _sums(total)


def train(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
          id_col: str = "vec_id", vector_col: str = "embedding") -> list[np.ndarray]:
    """One codebook per part position; empty where no vector can be cut."""
    kept = usable(df.select(id_col, vector_col), vector_col)
    order = [F.col(id_col).asc_nulls_last(), F.col(vector_col)]
    one = kept.orderBy(*order).limit(1).collect()
    dim = len(one[0][1]) if one else 0
    if not dim or dim % parts:
        return []
    start = kept.where(F.size(vector_col) == dim).orderBy(*order).limit(entries).collect()
    first = integers(np.array([r[1] for r in start], np.float64), scale)
    books = [_dtype(b) for b in np.split(first, parts, axis=1)]
    for _ in range(rounds):
        def run(batches: Iterator[pa.RecordBatch], books=books) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[int, int], list] = {}
            for batch in batches:
                for _, x in _blocks(batch, vector_col, dim, scale):
                    for p, part in enumerate(np.split(x, parts, axis=1)):
                        which, _ = nearest(part, books[p])
                        for e in np.unique(which).tolist():
                            mine = part[which == e]
                            _count(total, (p, e), len(mine), mine.sum(axis=0).tolist())
            yield _sums(total)

        means = (kept.select(vector_col).mapInArrow(run, SUMS).repartition(min(c.tasks(df.sparkSession), parts * entries), "p", "e")
                 .mapInArrow(_add, SUMS).collect())      # at most parts * entries rows
        moved = [b.astype(object) for b in books]
        for r in means:
            moved[r["p"]][r["e"]] = [int(t) // r["n"] for t in r["sums"]]
        books = [_dtype(b) for b in moved]
    return books


def codebook_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(t)) for b in books for t in b.flat).encode()).hexdigest()


def encode(df: DataFrame, books: list[np.ndarray], scale: int = SCALE, vector_col: str = "embedding",
           names: tuple[str, str] = ("code", "error")) -> DataFrame:
    """The usable rows of ``df`` without the vector, with code and squared error under ``names``."""
    parts, dim = len(books), sum(b.shape[1] for b in books)
    digits = max(2, len(f"{max((len(b) for b in books), default=1) - 1:x}"))
    others = [x for x in df.columns if x != vector_col and x not in names]
    kept = usable(df.select(vector_col, *others), vector_col)
    shape = kept.select(*others).withColumns({names[0]: F.lit(""), names[1]: F.lit(0).cast("long")}).schema
    if not books:
        return df.sparkSession.createDataFrame([], shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _blocks(batch, vector_col, dim, scale):
                found = [nearest(part, b) for part, b in zip(np.split(x, parts, axis=1), books)]
                index = np.stack([f[0] for f in found], 1).tolist()
                error = [min(LARGEST, sum(int(t) for t in row)) for row in zip(*[f[1] for f in found])]
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(x).take(take) for x in others]
                    + [pa.array(["".join(f"{i:0{digits}x}" for i in row) for row in index]), pa.array(error, pa.int64())], [*others, *names])

    return kept.mapInArrow(run, shape)


def compress(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
             id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every usable row."""
    books = train(df, parts, entries, rounds, scale, id_col, vector_col)
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    rows = c.stored(encode(rows, books, scale, "vector"), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    per = c.stored(rows.groupBy(F.col("label").alias("of")).agg(total.alias("label_error")), "label_errors")
    return (rows.join(per, F.col("label").eqNullSafe(F.col("of")))
            .select("vec_id", "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256")))


def op12_vector_codes(spark, sf_dir):
    """All embeddings as four codes of one byte."""
    return compress(c.read(spark, sf_dir, "embeddings"))


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same by comparing every part with every entry."""
    nearest = """
a{r} as (select r, p, arg_min(e, d * 1024 + e) as e, min(d) as d
         from (select v.r, v.p, b.e, list_sum(list_transform(list_zip(v.x, b.y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from part v join b{r} b on b.p = v.p)
         group by r, p)"""
    move = """
m{r} as (select p, e, list(y order by i) as y
         from (select p, e, i, (s - (s % n + n) % n) // n as y
               from (select v.p, a.e, i, sum(x[i])::bigint as s, count(*) as n from a{r} a join part v on v.r = a.r and v.p = a.p, unnest(range(1, len(v.x) + 1)) t(i)
                     group by v.p, a.e, i))
         group by p, e),
b{s} as (select b.p, b.e, coalesce(m.y, b.y) as y from b{r} b left join m{r} m on m.p = b.p and m.e = b.e)"""
    steps = []
    for r in range(rounds):
        steps += [nearest.format(r=r), move.format(r=r, s=r + 1)]
    steps.append(nearest.format(r=rounds))
    return f"""
with k as (select vec_id, label, row_number() over (order by vec_id, embedding) as r,
                  list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as x
           from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
part as (select r, p, list_slice(x, p * (len(x) // {parts}) + 1, (p + 1) * (len(x) // {parts})) as x from k, range({parts}) t(p)),
b0 as (select p, r - 1 as e, x as y from part where r <= {entries}),{",".join(steps)},
books as (select sha256(string_agg(y, ',' order by p, e, i)) as digest from (select p, e, i, y[i] as y from b{rounds} b, unnest(range(1, len(b.y) + 1)) t(i))),
o as (select r, string_agg(format('{{:02x}}', e), '' order by p) as code, sum(d)::bigint as error from a{rounds} group by r)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, digest as codebooks_sha256
from k join o on o.r = k.r cross join books
"""


QUERIES = {"op12_vector_codes": op12_vector_codes}
ORACLE = {"op12_vector_codes": sql()}
