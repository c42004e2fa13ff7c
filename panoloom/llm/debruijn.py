"""Removal of repeated word runs by compaction of a De Bruijn graph.

Every word that a window of ``LENGTH`` consecutive words covers whose word sequence also starts anywhere else in the corpus is removed.

*Edges.* The runs of ``LENGTH`` words are edges between their first and last ``LENGTH - 1`` words. Among the ``GRAM``-word runs inside a window the
leftmost of smallest hash is its anchor; equal windows have equal anchors, so an anchor that occurs once in the corpus ends here. Neighbouring
windows of one anchor form a context, a path of edges whose ends follow from the text alone. Where an anchor has one context only, the context is taken as one
edge, with its number of copies; where contexts of an anchor differ, each different context is cut into single windows, which are counted.

*Compaction.* Among repeated edges, a node with one edge in and one edge out joins the two. Edges that follow one another in the document that stands for
them are joined first, along that document; the pieces are joined by doubling pointers to their predecessors, so the number of joins is logarithmic in the
pieces of a path. Pieces on a ring, which has no first edge, stay as they are.

*Verification.* Every place of an edge returns to its document with its path and its offset there. Edges of one path on one diagonal
(place minus offset) that touch make one span; a copy that leaves its path and comes back makes several.

A task holds about a megabyte of text (a longer single text whole) or one row per edge or span of a document. Anchors, contexts and windows are combined before they are
shuffled, and joins with occurrences read written tables, so that adaptive execution can split a hot context.

Defined cases: null texts are empty; documents with fewer than ``LENGTH`` words lose nothing; a repeated row repeats its text; an empty table gives an
empty result; other columns are ignored. Windows (by their two nodes of 64 bits) and contexts are told apart by 128-bit digests of their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c
from . import words as wd
from .dedup import POSITION, sliding_min

LENGTH, GRAM = 35, 8
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
FACTOR = np.uint64(0xA24BAED4963EE407)
EDGE, PATH = ["e1", "e2"], ["p1", "p2"]


def _words(column) -> Iterator[wd.Words]:
    return wd.words(column, table=~SPACE, lower=False)


def run_hash(h: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each of ``first`` on."""
    out = np.zeros(len(first), np.uint64)
    for j in range(n):
        out = out * FACTOR + h[first + j]
    return wd.scramble(out)


def contexts(w: wd.Words, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of windows, anchor hash) of the contexts of a slice."""
    n = len(w.hash) - length + 1
    p = np.flatnonzero(w.doc[:n] == w.doc[length - 1:]) if n > 0 else np.zeros(0, np.int64)
    if not len(p):
        return p, p, p.astype(np.uint64)
    g = run_hash(w.hash, np.arange(len(w.hash) - gram + 1), gram)
    v = (g & ~POSITION) | np.arange(len(g), dtype=np.uint64)
    a = (sliding_min(v, length - gram + 1) & POSITION).astype(np.int64)[p]
    run = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))      # an anchor never belongs to two documents
    return p[run], np.diff(np.append(run, len(p))), g[a[run]]


def single_spaced(w: wd.Words) -> tuple[bytes, np.ndarray]:
    """All words of a slice, a space after each, and where each begins."""
    size = w.end - w.start + 1
    begin = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(w.start - begin[:-1], size) + np.arange(begin[-1])
    out = np.append(w.data, np.uint8(0x20))[at]
    out[begin[1:] - 1] = 0x20
    return out.tobytes(), begin


def digests(text: bytes, begin: np.ndarray, first: np.ndarray, n: np.ndarray | int, size: int) -> np.ndarray:
    """Digests of ``n`` words from ``first`` on, as ``size`` columns of 64-bit integers."""
    view = memoryview(text)
    raw = b"".join(hashlib.blake2b(view[s:e], digest_size=8 * size).digest()
                   for s, e in zip(begin[first].tolist(), begin[first + n].tolist()))
    return np.frombuffer(raw, np.int64).reshape(-1, size)


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(*c.row_key("doc_id", text_col), F.col("doc_id").cast("long"), c.text_of(text_col).alias("__text"))


def count_anchors(docs: DataFrame, length: int, gram: int, text_col: str) -> DataFrame:
    """``a, n``: anchors, counted per slice of texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in _words(batch.column("__text")):
                a, n = np.unique(contexts(w, length, gram)[2], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(n)], ["a", "n"])

    return docs.select(c.text_of(text_col).alias("__text")).mapInArrow(run, "a long, n long")


def find_contexts(docs: DataFrame, length: int, gram: int, text_col: str) -> DataFrame:
    """One row per context: anchor ``a``, digest ``e1, e2``, document, first word ``at`` and number of windows ``k``."""
    names = ["a", *EDGE, *c.KEY, "at", "k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in _words(batch.column("__text")):
                first, k, a = contexts(w, length, gram)
                if not len(first):
                    continue
                d = digests(*single_spaced(w), first, k + length - 1, 2)
                doc = w.doc[first]
                rows = pa.array(w.first + doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (a.view(np.int64), d[:, 0], d[:, 1])] + [batch.column(x).take(rows) for x in c.KEY]
                    + [pa.array(first - w.per_doc()[doc]), pa.array(k)], names)

    return _texts(docs, text_col).mapInArrow(run, ", ".join(f"{x} long" for x in names))


def trace(docs: DataFrame, wanted: DataFrame, length: int, text_col: str) -> DataFrame:
    """Nodes ``u, v`` of the wanted contexts: of each window of those to cut (``e1, e2`` null, ``off`` its number), of the ends of the others.

    Two neighbouring nodes hold all words of the window between them, so ``u, v`` also is the window's 128-bit digest.
    """
    lists = wanted.groupBy(*c.KEY).agg(F.collect_list(F.struct("at", "k", "n", "cut", *EDGE)).alias("want"))     # bounded by the text
    rows = _texts(docs, text_col).join(lists, list(c.KEY)).select(*c.KEY, "__text", "want")
    names = [*EDGE, "u", "v", *c.KEY, "at", "off", "k", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lens = batch.column("want").value_lengths().to_numpy()
            edge, flat = np.concatenate([[0], np.cumsum(lens)]), batch.column("want").flatten()
            for w in _words(batch.column("__text")):
                docs_here = len(w.offsets) - 1
                want = flat.slice(edge[w.first], edge[w.first + docs_here] - edge[w.first])
                at, k, n, cut = (want.field(x).to_numpy(zero_copy_only=False) for x in ("at", "k", "n", "cut"))
                row = np.repeat(np.arange(docs_here), lens[w.first:w.first + docs_here])
                many, step = np.where(cut, k, 1), np.where(cut, 1, k)              # edges of a context and their length
                node = np.repeat(np.arange(len(k)), many + 1)                     # one node more than edges
                turn = np.arange(len(node)) - np.repeat(np.cumsum(many + 1) - many - 1, many + 1)
                first = w.per_doc()[row[node]] + at[node] + turn * step[node]
                d = digests(*single_spaced(w), first, length - 1, 1)[:, 0]
                begins = np.flatnonzero(turn < many[node])
                of, off = node[begins], turn[begins]
                which, rows = pa.array(np.where(cut, -1, np.arange(len(k)))[of]), pa.array(w.first + row[of])
                which = pc.if_else(pc.less(which, 0), None, which)
                yield pa.RecordBatch.from_arrays(
                    [want.field(x).take(which) for x in EDGE] + [pa.array(d[begins]), pa.array(d[begins + 1])] + [batch.column(x).take(rows) for x in c.KEY]
                    + [pa.array(x) for x in (at[of] + off, off, step[of], n[of])], names)

    return rows.mapInArrow(run, ", ".join(f"{x} long" for x in names))


def compact(edges: DataFrame) -> DataFrame:
    """``e1, e2, p1, p2, poff`` of every edge: its path, named by the path's first edge, and its offset there in windows.

    ``edges`` has one row per edge: ``e1, e2``, nodes ``u, v``, length ``k`` and a document place (``KEY``, ``at``) that stands for it.
    """
    one = F.count(F.lit(1)).alias("ways")
    out = edges.groupBy(F.col("u").alias("node")).agg(one, F.min(F.struct(*EDGE)).alias("e")).where("ways = 1").select("node", "e.*")
    into = edges.groupBy(F.col("v").alias("node")).agg(one, F.min(F.struct(*EDGE)).alias("q")).where("ways = 1")
    links = out.join(into, "node").select(*EDGE, F.col("q.e1").alias("q1"), F.col("q.e2").alias("q2")).where("e1 <> q1 or e2 <> q2")
    along = Window.partitionBy(*c.KEY).orderBy("at")
    follows = ((F.lag("e1").over(along) == F.col("q1")) & (F.lag("e2").over(along) == F.col("q2"))
               & (F.lag(F.col("at") + F.col("k")).over(along) == F.col("at")))
    rows = edges.join(links, EDGE, "left").withColumn("head", ~F.coalesce(follows, F.lit(False)))
    rows = rows.withColumn("h", F.last(F.when(F.col("head"), F.struct(*EDGE, "at")), ignorenulls=True).over(along))
    rows = c.stored(rows.select(*EDGE, "k", "head", "q1", "q2", F.col("h.e1").alias("h1"), F.col("h.e2").alias("h2"),
                                (F.col("at") - F.col("h.at")).alias("off")), "pieces")
    heads = rows.where("head and q1 is not null").select("h1", "h2", "q1", "q2")
    tails = rows.select(F.col("e1").alias("q1"), F.col("e2").alias("q2"), F.col("h1").alias("p1"), F.col("h2").alias("p2"),
                        (F.col("off") + F.col("k")).alias("d"))      # the predecessor ends its piece: it has one successor
    up = c.stored(heads.join(tails, ["q1", "q2"]).select("h1", "h2", *PATH, "d"), "up")
    found = up.limit(0)
    while True:
        over = up.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("p1").alias("n1"), F.col("p2").alias("n2"), F.col("d").alias("more"))
        step = c.stored(up.join(over, PATH, "left"), "up")
        settled = step.where("more is null").select("h1", "h2", *PATH, "d")
        if settled.isEmpty():
            break                                # nothing is left, or only rings
        found = found.unionByName(settled)
        up = step.where("more is not null").select("h1", "h2", F.col("n1").alias("p1"), F.col("n2").alias("p2"), (F.col("d") + F.col("more")).alias("d"))
    return (rows.join(found, ["h1", "h2"], "left")
            .select(*EDGE, F.coalesce("p1", "h1").alias("p1"), F.coalesce("p2", "h2").alias("p2"),
                    (F.coalesce("d", F.lit(0)) + F.col("off")).alias("poff")))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, text_col: str = "text") -> DataFrame:
    """``KEY, p1, p2, poff, spans``: verified spans (first word, end) of each path in each document; ``poff`` is where the first begins on the path."""
    often = c.stored(count_anchors(docs, length, gram, text_col).groupBy("a").agg(F.sum("n").alias("n")).where("n > 1").select("a"), "often")
    rows = c.stored(find_contexts(docs, length, gram, text_col).join(often, "a", "left_semi"), "contexts")
    each = rows.groupBy("a", *EDGE, "k").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*c.KEY, "at")).alias("f"))
    each = c.stored(each.select("a", *EDGE, "k", "n", "f.*"), "kinds")
    mixed = c.stored(each.groupBy("a").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("a", F.lit(True).alias("cut")), "mixed")
    each = each.join(mixed, "a", "left").withColumn("cut", F.coalesce("cut", F.lit(False))).where("cut or n > 1")
    traced = c.stored(trace(docs, each, length, text_col), "traced")
    cut = traced.where("e1 is null")
    shape = [*EDGE, "u", "v", "k", *c.KEY, "at"]
    twice = cut.groupBy("u", "v").agg(F.sum("n").alias("n"), F.min(F.struct(*c.KEY, "at")).alias("f")).where("n > 1")
    twice = twice.select(F.col("u").alias("e1"), F.col("v").alias("e2"), "u", "v", F.lit(1).cast("long").alias("k"), "f.*")
    edges = c.stored(traced.where("e1 is not null").select(*shape).distinct().unionByName(twice.select(*shape)), "edges")
    paths = c.stored(compact(edges), "paths")

    # where contexts hold edges: a whole one from its first window on, a cut one by runs of windows on one path
    inner = cut.select(F.col("u").alias("e1"), F.col("v").alias("e2"), *c.KEY, (F.col("at") - F.col("off")).alias("at"), "off").join(paths, EDGE)
    near = Window.partitionBy(*c.KEY, "at").orderBy("off")
    ahead = F.col("off") - F.lag("off").over(near)                        # 0 where rows repeat
    same = (ahead <= 1) & (F.col("poff") - F.lag("poff").over(near) == ahead) & (F.lag("p1").over(near) == F.col("p1")) & (F.lag("p2").over(near) == F.col("p2"))
    inner = inner.withColumn("new", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn("run", F.sum("new").over(near))
    inner = inner.groupBy(*c.KEY, "at", "run").agg(F.min("off").alias("off"), (F.max("off") - F.min("off") + 1).alias("many"),
                                                   F.min(F.struct(*PATH, "poff")).alias("p"))
    inner = inner.join(each.where("cut").select(*EDGE, *c.KEY, "at"), [*c.KEY, "at"]).select(*EDGE, "off", "many", "p.*")
    whole = each.where("not cut").select(*EDGE, F.lit(0).cast("long").alias("off"), F.col("k").alias("many")).join(paths, EDGE)
    held = c.stored(inner.unionByName(whole), "held")
    places = rows.join(held, EDGE).select(*c.KEY, *PATH, (F.col("at") + F.col("off")).alias("s"), "many", "poff")
    found = places.groupBy(*c.KEY, *PATH, (F.col("s") - F.col("poff")).alias("diagonal")).agg(
        F.min("s").alias("s"), F.max(F.col("s") + F.col("many")).alias("e"), F.min("poff").alias("poff"), F.collect_set(F.struct("s", "many")).alias("parts"))
    total = F.aggregate("parts", F.lit(0).cast("long"), lambda acc, x: acc + x["many"])
    touch = F.array(F.struct("s", (F.col("e") + length - 1).alias("e")))
    apart = F.transform("parts", lambda x: F.struct(x["s"].alias("s"), (x["s"] + x["many"] + length - 1).alias("e")))
    return found.select(*c.KEY, *PATH, "poff", F.when(total == F.col("e") - F.col("s"), touch).otherwise(apart).alias("spans"))


def passages(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, text_col: str = "text") -> DataFrame:
    """``p1, p2, n_documents, n_spans, longest``: the repeated paths, with how many different documents and spans hold them and the words of the longest."""
    spans = repeated_spans(docs, length, gram, text_col)
    return spans.groupBy(*PATH).agg(
        F.count_distinct(*c.KEY).alias("n_documents"), F.sum(F.size("spans")).alias("n_spans"),
        F.max(F.array_max(F.transform("spans", lambda x: x["e"] - x["s"]))).alias("longest"))


def merged(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint ranges that cover the same."""
    by = np.argsort(s, kind="stable")
    s, reach = s[by], np.maximum.accumulate(e[by])
    new = np.flatnonzero(np.concatenate([[True], s[1:] > reach[:-1]]))
    return s[new], reach[np.append(new[1:], len(s)) - 1]


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every document, and with ``keep_text`` the words that are left (``kept``)
    and the removed ranges of words (``removed``)."""
    ranges = repeated_spans(docs, length, gram, text_col).groupBy(*c.KEY).agg(F.flatten(F.collect_list("spans")).alias("ranges"))   # bounded by the text
    rows = _texts(docs, text_col).join(ranges, list(c.KEY), "left").select("doc_id", "__text", "ranges")
    span = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
    kinds = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string()} | (
        {"kept": pa.binary(), "removed": span} if keep_text else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("__text").cast(pa.large_binary()), batch.column("ranges")):
                words = text.as_py().split()           # bytes split at the six white-space characters
                s = e = np.zeros(0, np.int64)
                if spans.is_valid:
                    s, e = merged(spans.values.field("s").to_numpy(), spans.values.field("e").to_numpy())
                left = b" ".join(x for i, j in zip([0, *e.tolist()], [*s.tolist(), len(words)]) for x in words[i:j])
                out.append((len(words), int((e - s).sum()), hashlib.sha256(left).hexdigest(), left, [{"s": i, "e": j} for i, j in zip(s.tolist(), e.tolist())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")] + [pa.array([o[k] for o in out], t) for k, t in enumerate(kinds.values())],
                                             ["doc_id", *kinds])

    more = ", kept binary, removed array<struct<s:long,e:long>>" if keep_text else ""
    return rows.mapInArrow(run, f"doc_id long, n_words long, n_removed long, kept_sha256 string{more}")


def op11_debruijn_dedup(spark, sf_dir):
    """Repeated runs of 35 words removed from all documents."""
    return remove_repeats(c.read(spark, sf_dir, "documents"))


SQL = rf"""
with d as (select doc_id, row_number() over () as r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select r, unnest(range(1, len(w) - {LENGTH - 2})) as i, w from d where len(w) >= {LENGTH}),
h as (select r, i, sha256(array_to_string(list_slice(w, i, i + {LENGTH - 1}), ' ')) as h from win),
twice as (select r, i, count(*) over (partition by h) > 1 as again from h),
each as (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from d),
gone as (select e.r, e.i, e.word, coalesce(max(t.again::int) over (partition by e.r order by e.i rows between {LENGTH - 1} preceding and current row), 0) as gone
         from each e left join twice t on t.r = e.r and t.i = e.i),
kept as (select r, count(*) as n_words, sum(gone) as n_removed, string_agg(word, ' ' order by i) filter (where gone = 0) as kept from gone group by r)
select d.doc_id, cast(coalesce(n_words, 0) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed,
       sha256(coalesce(kept, '')) as kept_sha256
from d left join kept k on k.r = d.r
"""

QUERIES = {"op11_debruijn_dedup": op11_debruijn_dedup}
ORACLE = {"op11_debruijn_dedup": SQL}
