"""Document fingerprints: a Merkle tree over sections and paragraphs.

A text is cut into pieces of up to ``PIECE`` words that end with a sentence or line, white space included, so that the pieces
add up to the text. Pieces are the leaves; the pieces of a line make a paragraph; paragraphs run into a section that ends
with a paragraph whose hash says so, so that an insertion moves no later border. Every node hashes its children; the
root tests equality, and differing branches lead to the edits.

Only DataFrame functions are used. Every value that an inner function needs is bound once (``let``), because
functions over arrays do not share repeated work.

Defined cases: a null text is empty, and an empty text has a root and no branches; two empty texts are alike (1.0), an empty one and another
are not (0.0); in the order of documents, repeated numbers follow the hash of their text and null numbers come last; a lone document is its own next;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

PIECE = 8
#: Up to eight words of one line, ending early with a sentence; leading white space is a piece of its own.
PIECES = r"(?:\S*[^\s.!?][^\S\n]+){0,%d}\S+\s*|\s+" % (PIECE - 1)
SECTION = 4             # paragraphs to a section, on average
BUCKET_ROWS = 2_000     # documents that are put in order together, on average
INTERVALS = 256         # quantiles of the ids, between which ranges are equal steps


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _cuts(n: Column, last) -> Column:
    """Positions (from 1) at which a run ends."""
    return F.when(n > 0, F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | last(i))).otherwise(F.array().cast("array<int>"))


def _run(values: Column, ends: Column, make) -> Column:
    """``make`` of each run of values that ends at ``ends``."""
    def one(end, k):
        before = F.when(k == 0, F.lit(0)).otherwise(F.get(ends, k - 1))
        return make(F.slice(values, before + 1, end - before))
    return F.transform(ends, one)


def _hex(x: Column, digits: int) -> Column:
    return F.lower(F.lpad(F.hex(x if digits == 16 else F.shiftrightunsigned(x, 32)), digits, "0"))


def tree(text: Column) -> Column:
    """A struct of ``root, sections, paragraphs, leaves`` and ``fingerprint``, the whole tree as a string.

    The string reads ``root;section=paragraph:leaf leaf,paragraph:...;section=...``, with the leading half of each leaf's hash.
    """
    def shown(paras: Column, leaves: Column, ends: Column, cuts: Column, sections: Column) -> Column:
        lines = F.zip_with(paras, _run(leaves, ends, lambda x: F.array_join(F.transform(x, lambda h: _hex(h, 8)), " ")),
                           lambda p, s: F.concat(_hex(p, 16), F.lit(":"), s))
        return let(lines, lambda rows: F.array_join(
            F.zip_with(sections, _run(rows, cuts, lambda x: F.array_join(x, ",")), lambda s, r: F.concat(_hex(s, 16), F.lit("="), r)), ";"))

    def top(leaves: Column, ends: Column, paras: Column, cuts: Column, sections: Column) -> Column:
        root = F.substring(F.sha2(F.array_join(F.transform(sections, lambda s: _hex(s, 16)), ""), 256), 1, 32)
        return let(root, lambda r: F.struct(
            r.alias("root"), sections.alias("sections"), paras.alias("paragraphs"), leaves.alias("leaves"),
            F.concat(r, F.lit(";"), shown(paras, leaves, ends, cuts, sections)).alias("fingerprint")))

    def from_paragraphs(leaves: Column, ends: Column, paras: Column) -> Column:
        return let(_cuts(F.size(paras), lambda i: F.pmod(F.get(paras, i - 1), F.lit(SECTION)) == 0), lambda cuts:
                   let(_run(paras, cuts, lambda x: F.xxhash64(x)), lambda sections: top(leaves, ends, paras, cuts, sections)))

    def from_pieces(pieces: Column) -> Column:
        return let(F.transform(pieces, lambda p: F.xxhash64(p)), lambda leaves:
                   let(_cuts(F.size(pieces), lambda i: F.contains(F.get(pieces, i - 1), F.lit("\n"))), lambda ends:
                       let(_run(leaves, ends, lambda x: F.xxhash64(x)), lambda paras: from_paragraphs(leaves, ends, paras))))

    return let(F.regexp_extract_all(text, F.lit(PIECES), F.lit(0)), from_pieces)


def leaves(text: Column) -> Column:
    """Only the leaves of ``tree``."""
    return F.transform(F.regexp_extract_all(text, F.lit(PIECES), F.lit(0)), lambda p: F.xxhash64(p))


def likeness(a: Column, b: Column) -> Column:
    """Shared part of two sets of leaves: twice the common ones over the sum of both."""
    return let(F.array_distinct(a), lambda x: let(F.array_distinct(b), lambda y: F.when(
        F.size(x) + F.size(y) > 0, 2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))).otherwise(F.lit(1.0))))


def edited_paragraphs(a: Column, b: Column) -> Column:
    """Positions (from 0) of the paragraphs of tree ``b`` that tree ``a`` does not have; empty where the roots agree."""
    return F.when(a["root"] == b["root"], F.array().cast("array<int>")).otherwise(
        let(a["paragraphs"], lambda old: F.filter(
            F.transform(b["paragraphs"], lambda p, i: F.when(~F.array_contains(old, p), i)), lambda i: i.isNotNull())))


def fingerprints(docs: DataFrame, text_col: str = "text", out: str = "tree") -> DataFrame:
    """``docs`` with the tree of every text; a projection."""
    return docs.withColumn(out, tree(c.text_of(text_col)))


def id_ranges(docs: DataFrame, rows_per_bucket: int = BUCKET_ROWS) -> Column:
    """Range of each row by (id, ``h``), ascending, null ids first: ranges of about ``rows_per_bucket`` rows whatever ids there are.

    Quantiles of the ids cut them into intervals of equally many rows, and equal steps cut the intervals. An id that fills whole intervals of its own is
    cut by the hash of the text, and so are null ids.
    """
    shares = [k / INTERVALS for k in range(INTERVALS + 1)]
    r = docs.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("known"), F.percentile_approx("doc_id", shares).alias("q")).first()
    parts_of = lambda rows: max(1, -(-int(rows) // rows_per_bucket))
    each, times = r["known"] / INTERVALS, Counter(r["q"] or [])
    cuts = sorted(set(times) | {q + 1 for q, m in times.items() if m > 1 and q < (1 << 63) - 1})
    last = cuts[1:] + [None]
    single = [False] + [b is not None and b - a == 1 for a, b in zip(cuts, last)]
    parts = [1] + [parts_of(each * max(1, times[a])) if b is not None else 1 for a, b in zip(cuts, last)]
    low, span = [0.0] + [float(a) for a in cuts], [1.0] + [float(b) - float(a) if b is not None else 1.0 for a, b in zip(cuts, last)]
    at = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<long>"), lambda q: q <= F.col("doc_id")))     # intervals before

    def of(values, kind):
        return F.element_at(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), at + 1)
    by_hash = F.col("h").cast("double") / F.lit(2.0 ** 64) + 0.5
    share = F.when(of(single, "boolean"), by_hash).otherwise((F.col("doc_id").cast("double") - of(low, "double")) / of(span, "double"))
    many, alone = of(parts, "long"), parts_of(r["n"] - r["known"])

    def step(x, k):
        return F.greatest(F.lit(0), F.least(F.floor(x * k), F.lit(k) - 1)).cast("long")
    known = (at + 1).cast("long") * F.lit(1 << 32) + step(share, many)
    return F.when(F.col("doc_id").isNull(), step(by_hash, alone)).otherwise(known)


def with_next(docs: DataFrame, rows_per_bucket: int = BUCKET_ROWS) -> DataFrame:
    """``doc_id, text, next_text``: every document and the next one in descending order, the first after the last.

    Rows are cut into ranges (``id_ranges``). Each range is a window of its own; its last row sees the first
    of the next range, which is added to it as one more row. Texts are shuffled once, and once more only where the ranges are too many to
    be sent to every task.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), c.text_of().alias("text"), F.xxhash64(c.text_of()).alias("h"))
    rows = docs.select("doc_id", "text", id_ranges(docs, rows_per_bucket).alias("bucket"), "h", F.lit(False).alias("extra"))
    place = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")).alias("i"), F.col("h"))
    heads = rows.groupBy("bucket").agg(F.max(place).alias("head"))
    order = Window.orderBy(F.col("bucket").desc())                     # one row per bucket
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select(F.col("bucket").alias("into"), F.coalesce(F.lead("head").over(order), F.first("head").over(whole)).alias("head"))
    heads = c.stored(heads, "heads")           # of known size, so that Spark sends it to the texts if it is small
    added = rows.join(heads, (F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")) == F.col("head.i")) & (F.col("h") == F.col("head.h")))
    added = added.groupBy("into").agg(F.first("text").alias("text")).select(       # repeated rows are one head
        F.lit(None).cast("long").alias("doc_id"), "text", F.col("into").alias("bucket"), F.lit(None).cast("long").alias("h"), F.lit(True).alias("extra"))
    both = rows.unionByName(added)
    inside = Window.partitionBy("bucket").orderBy(F.col("extra"), F.col("doc_id").desc_nulls_last(), F.col("h").desc_nulls_last())
    return both.withColumn("next_text", F.lead("text").over(inside)).where(~F.col("extra")).select("doc_id", "text", "next_text")


def op2_fingerprints(spark, sf_dir):
    """Fingerprints of all documents and of their edited texts."""
    rows = with_next(c.read(spark, sf_dir, "documents")).withColumn("n_chars", F.length("text").cast("long"))
    moved = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - moved),
                                              F.substring("next_text", F.lit(1), moved)))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), tree(F.col("text")).alias("a"),
                       tree(F.col("edited")).alias("b"), leaves(F.col("next_text")).alias("next"))
    return rows.select("doc_id", "n_chars", "edited_sha256", F.col("a.fingerprint").alias("fingerprint"),
                       F.col("b.fingerprint").alias("edited_fingerprint"),
                       likeness(F.col("a.leaves"), F.col("b.leaves")).alias("near_edited"),
                       likeness(F.col("a.leaves"), F.col("next")).alias("near_next"))


QUERIES = {"op2_fingerprints": op2_fingerprints}
