"""Resampling of documents towards a target distribution.

Features are runs of 1 to ``ORDER`` consecutive words; a feature's bucket is the CRC-32 of its bytes, words joined by one space, modulo ``BUCKETS``. All documents and all
target texts are counted by bucket; a bucket's gain is the log ratio of its smoothed shares in the target and in the documents, a document's weight the sum over
its features. With Gumbel noise from a digest of the id, the documents of highest score are a draw without replacement in proportion to the importance weights.

*Dictionary.* The different words of about a quarter of a megabyte of text, each between two spaces, go into an Aho-Corasick automaton with their CRC and length as payload. One scan emits the
payload of every word in order, delimiters being shared by neighbours. The CRC of a run is composed from the payloads of its words: appending a word of ``n`` bytes
multiplies by x^(8 n) modulo the CRC polynomial. So a word is hashed once per such piece, whose automaton stays small enough for a processor's cache, and runs are never built as strings.

The corpus is scanned twice, for counts and for scores; only bucket counts (``BUCKETS`` numbers per order-independent table) pass through the driver. Ranks come from a range
partition by score, whose parts are numbered on their own and shifted by the number of rows in the parts before.

Defined cases: null and empty texts hold no words, weigh 0 and are never drawn; a null id takes the noise of the empty id and comes last among ties, rows of equal id and
score go by a hash of the text; repeated rows are rows of their own; without target texts all gains come from smoothing; an empty table gives an empty result. Words
of more than ``LONG`` bytes stay out of the automaton, whose size they would set, and bring their payload themselves. Texts are taken whole, a piece at a time. Other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as c
from . import words as wd

ORDER, BUCKETS, SEED, PERCENT, LEAST_WORDS = 1, 10_000, 2024, 10, 20
POLYNOMIAL = 0xEDB88320                 # CRC-32, lowest bit first
LONG = 1024
PIECE = 1 << 18
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


# ---- CRC arithmetic

def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of two polynomials modulo the CRC polynomial; the highest bit of a number is its constant term."""
    a, b = a.astype(np.uint32), b.astype(np.uint32)
    out = np.zeros(np.broadcast(a, b).shape, np.uint32)
    for bit in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(bit) & np.uint32(1), b, np.uint32(0))
        b = b >> np.uint32(1) ^ np.where(b & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return out


def byte_shift(n: np.ndarray) -> np.ndarray:
    """x^(8 n) for every number of bytes ``n``."""
    different, which = np.unique(n, return_inverse=True)
    out, square = np.full(len(different), 1 << 31, np.uint32), np.array([1 << 23], np.uint32)
    for bit in range(int(different.max(initial=0)).bit_length()):
        out = np.where(different >> bit & 1, times(out, square), out)
        square = times(square, square)
    return out[which]


def appended(crc: np.ndarray, tail_crc: np.ndarray, tail_bytes: np.ndarray) -> np.ndarray:
    """CRC of two strings put together."""
    return times(crc, byte_shift(tail_bytes)) ^ tail_crc


# ---- scanning

def payloads(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the last byte, CRC, bytes) of each word of ``text``, which holds word bytes and spaces and begins and ends with a space."""
    found_long = [(m.end() - 1, m.group()) for m in re.finditer(rb"[^ ]{%d,}" % (LONG + 1), text)]
    for end, word in found_long:
        text = text[:end + 1 - len(word)] + b" " * len(word) + text[end + 1:]
    dictionary = sorted(set(text.split()))
    crc = np.array([zlib.crc32(w) for w in dictionary], np.uint32)
    size = np.array([len(w) for w in dictionary], np.int64)
    place = which = np.zeros(0, np.int64)
    if dictionary:
        automaton = ahocorasick.Automaton()
        for k, w in enumerate(dictionary):
            automaton.add_word(f" {w.decode('latin-1')} ", k)       # one character per byte
        automaton.make_automaton()
        pairs = np.fromiter(chain.from_iterable(automaton.iter(text.decode("latin-1"))), np.int64).reshape(-1, 2)      # no tuples are held
        place, which = pairs[:, 0] - 1, pairs[:, 1]
    crc, size = crc[which], size[which]
    if found_long:
        place = np.concatenate([place, [e for e, _ in found_long]])
        by = np.argsort(place, kind="stable")
        place = place[by]
        crc = np.concatenate([crc, np.array([zlib.crc32(w) for _, w in found_long], np.uint32)])[by]
        size = np.concatenate([size, [len(w) for _, w in found_long]])[by]
    return place, crc, size


def scan(column, order: int, buckets: int, piece: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, words per row, row of each feature, its bucket) of consecutive texts, rows counted from ``first row``."""
    for first, data, offsets in wd.slices(column, piece):
        raw = data.tobytes().translate(WORD_BYTES)
        text = b" " + b" ".join(raw[i:j] for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())) + b" "
        begins = offsets[:-1] + np.arange(len(offsets) - 1) + 1
        parts, at = [], 0
        while at < len(text) - 1:
            end = text.find(b" ", min(at + piece, len(text) - 1))     # a piece ends at a space, which also begins the next
            place, crc, size = payloads(text[at:end + 1])
            parts.append((place + at, crc, size))
            at = end
        place, crc, size = (np.concatenate([p[k] for p in parts]) for k in range(3))
        row = np.searchsorted(begins, place, side="right") - 1
        rows, found, run = [row], [crc % np.uint32(buckets)], crc
        space = np.array([zlib.crc32(b" ")], np.uint32)
        for n in range(1, order):
            run = appended(appended(run[:-1], space, np.ones(1, np.int64)), crc[n:], size[n:])
            whole = row[:len(run)] == row[n:]
            rows.append(row[:len(run)][whole])
            found.append(run[whole] % np.uint32(buckets))
        yield first, len(offsets) - 1, np.bincount(row, minlength=len(offsets) - 1), np.concatenate(rows), np.concatenate(found).astype(np.int64)


# ---- counts, gains, scores

def count_buckets(df: DataFrame, order: int = ORDER, buckets: int = BUCKETS, text_col: str = "text") -> np.ndarray:
    """Features of all texts per bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for *_, found in scan(batch.column(0), order, buckets):
                total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    rows = df.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():        # at most ``buckets`` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    b = float(len(source))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + b) / ((s + 1) * (t.sum() + b)))).astype(np.int64)


def noise(seed: int, id_col: str = "doc_id") -> Column:
    """Thousandths of standard Gumbel noise from a digest of seed and id, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def score(docs: DataFrame, gain: np.ndarray, order: int = ORDER, seed: int = SEED, text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` and ``tid``, a hash of the text, of every document."""
    buckets = len(gain)
    names = ["doc_id", "tid", "n_words", "n_features", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows, n_words, row, found in scan(batch.column("text"), order, buckets):
                weight = np.zeros(rows, np.int64)
                np.add.at(weight, row, gain[found])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, rows), batch.column(1).slice(first, rows), pa.array(n_words.astype(np.int64)),
                     pa.array(np.bincount(row, minlength=rows).astype(np.int64)), pa.array(weight)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(c.text_of(text_col)).alias("tid"), F.col(text_col).alias("text"))
    rows = rows.mapInArrow(run, ", ".join(f"{x} long" for x in names))
    return rows.withColumn("score", F.col("weight") + noise(seed))


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Rows of ``score`` with ``rank`` for the given share of the documents with enough words, highest scores first."""
    spark = scored.sparkSession
    scored = c.stored(scored, "scores")
    fit = F.col("n_words") >= least_words
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("tid")]
    parts = c.stored(scored.where(fit).repartitionByRange(c.tasks(spark), *order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))        # one row per range
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"),
                         F.sum("n").over(Window.partitionBy()).alias("all"))
    place = F.col("base") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    drawn = F.col("place") <= F.floor(F.col("all") * percent / 100)
    ranked = parts.join(sizes, "part").withColumn("place", place).withColumn("rank", F.when(drawn, F.col("place")).cast("long"))
    rest = scored.where(~fit).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*rest.columns).unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT,
             least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document; documents with a rank are the draw."""
    gain = gains(count_buckets(docs, order, buckets), count_buckets(target, order, buckets))
    return draw(score(docs, gain, order, seed), percent, least_words).select("doc_id", "n_features", "weight", "score", "rank")


def op13_importance(spark, sf_dir):
    """A tenth of the documents drawn towards the benchmark's words."""
    return resample(c.read(spark, sf_dir, "documents"), c.read(spark, sf_dir, "benchmark"))


SQL = rf"""
with crc as (select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c % 2 = 1 then xor(c // 2, {POLYNOMIAL}) else c // 2 end, i)) as t),
d as (select row_number() over () as r, doc_id, text,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
      from documents),
q as (select unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w
      from benchmark),
dw as (select r, unnest(w) as w from d),
v as (select w, hex(w) as x from (select w from dw union select w from q)),
b as (select w, xor(list_reduce(list_transform(range(len(x) // 2), lambda j: ('0x' || substr(x, 2 * j + 1, 2))::bigint),
                                lambda c, y: xor(c // 256, t[xor(c % 256, y) + 1]), 4294967295), 4294967295) % {BUCKETS} as bucket
      from v cross join crc),
s as (select bucket, count(*) as s from dw join b using (w) group by bucket),
t as (select bucket, count(*) as t from q join b using (w) group by bucket),
g as (select k.bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select count(*) from dw) + {BUCKETS})::double
                                       / ((coalesce(s, 0) + 1)::double * ((select count(*) from q) + {BUCKETS})::double)))::bigint as gain
      from (select distinct bucket from b) k left join s using (bucket) left join t using (bucket)),
f as (select r, count(*) as n, sum(gain)::bigint as weight from dw join b using (w) join g using (bucket) group by r),
o as (select d.r, doc_id, coalesce(n, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight, hash(coalesce(text, '')) as tid,
             ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as h
      from d left join f on f.r = d.r),
p as (select *, weight + floor(-1000.0::double * ln(-ln((h + 0.5::double) / 4294967296.0::double)))::bigint as score from o),
z as (select *, row_number() over (partition by n_features >= {LEAST_WORDS} order by score desc, doc_id nulls last, tid) as place,
             count(*) over (partition by n_features >= {LEAST_WORDS}) as many from p)
select doc_id, n_features, weight, score,
       case when n_features >= {LEAST_WORDS} and place <= many * {PERCENT} // 100 then place::bigint end as rank
from z
"""

QUERIES = {"op13_importance": op13_importance}
ORACLE = {"op13_importance": SQL}
