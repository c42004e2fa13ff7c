"""Secret scans with corpus-wide ownership frequency.

Three base patterns are scanned over whole texts. Longer unbroken tokens that mix letters and digits are candidates as
well. A digest of every candidate value is counted over the corpus: in how many repositories and for how many owners
does it occur? A value of many owners, or of many repositories of one owner, is a widely copied example; a value that stays with few looks live. Live
tokens outside the base spans become spans of kind ``token``.

Candidates are pre-aggregated by (value, owner, repository) before owners are counted, so no value's occurrences meet in
one task. Texts are read once; only candidates are shuffled.

Defined cases: null texts are empty; repeated rows have one key and equal results, and count as one repository; null
owners count as one owner; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

KINDS = ("assign", "access", "hex", "token")
#: Fixed patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")        # runs of the class, 20 characters or more with the prefix
HEX = re.compile(r"[0-9a-f]{24,}")
#: A candidate of the added kind: an unbroken token of 20 characters or more.
TOKEN = re.compile(r"[A-Za-z0-9_+/=-]{20,}")
LEAST_VALUE = 6
#: Owners, and repositories of whatever owners, from which on a value counts as a copied example.
COPIED, COPIED_REPOSITORIES = 3, 20

SCANNED = "kind int, start int, end int, value binary"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) of the base kinds, code points, leftmost without overlap per kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def token_spans(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Tokens of upper or lower letters and digits that touch none of the base spans; one pass over both in order."""
    out, at, reach = [], 0, 0
    spans = sorted((s, e) for _, s, e, _ in taken)
    for m in TOKEN.finditer(text):
        t = m[0]
        while at < len(spans) and spans[at][0] < m.end():
            reach, at = max(reach, spans[at][1]), at + 1
        if reach <= m.start() and any(ch.isdigit() for ch in t) and any(ch.isalpha() for ch in t):
            out.append((3, m.start(), m.end(), t))
    return out


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e, *_ in sorted(spans, key=lambda x: (x[1], x[0], x[2])))


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for text in pdf.pop("__text"):
            base = base_spans(text)
            found = base + token_spans(text, base)
            rows.append((*(sum(k == n for k, *_ in base) for n in range(3)),
                         hashlib.sha256(_joined(base).encode()).hexdigest(),
                         [(k, s, e, hashlib.sha256(v.encode()).digest()[:16]) for k, s, e, v in sorted(found, key=lambda x: (x[1], x[0]))]))
        more = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "found"], index=pdf.index)
        yield pd.concat([pdf, more], axis=1)


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: key, id, owner, repository, base counts and digest, and its candidates; no text."""
    rows = docs.select(*c.row_key("doc_id", text_col), F.col("doc_id"), F.col(owner).cast("string").alias("__owner"),
                       F.col(repository).cast("string").alias("__repo"), c.text_of(text_col).alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text")
    return rows.mapInPandas(_scan, f"{kept}, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<{SCANNED.replace(' int', ':int').replace(' binary', ':binary')}>>")


def ownership(scanned: DataFrame, copied: int = COPIED, repositories: int = COPIED_REPOSITORIES) -> DataFrame:
    """``value, n_owners, n_repositories, n_seen, live`` of every candidate value of the corpus."""
    each = scanned.select("__owner", "__repo", F.explode("found.value").alias("value"))
    each = each.groupBy("value", "__owner", "__repo").agg(F.count(F.lit(1)).alias("n"))
    each = each.groupBy("value", "__owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    return each.groupBy("value").agg(
        F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repositories"), F.sum("n").alias("n_seen")
    ).withColumn("live", (F.col("n_owners") < copied) & (F.col("n_repositories") < repositories))


def find_secrets(docs: DataFrame, owner: str = "source", repository: str = "doc_id", copied: int = COPIED,
                 repositories: int = COPIED_REPOSITORIES) -> DataFrame:
    """One row per document: ``KEY``, doc_id, base counts and digest, ``spans`` and per-class counts.

    ``found`` lists kind, start, end, value digest, live and the value's owners and repositories; ``token`` candidates
    are kept only where live, base spans always.
    """
    scanned = c.stored(scan(docs, owner, repository), "secrets")
    known = ownership(scanned, copied, repositories).withColumnRenamed("value", "__value")
    hits = scanned.select(*c.KEY, F.explode("found").alias("f")).select(*c.KEY, "f.*").distinct()
    hits = (hits.join(known, F.col("value") == F.col("__value"))
            .where((F.col("kind") < 3) | F.col("live"))
            .select(*c.KEY, F.struct("start", "kind", "end", "live", "n_owners", "n_repositories", "value").alias("s")))
    hits = hits.groupBy(*c.KEY).agg(F.sort_array(F.collect_list("s")).alias("__hits"))     # bounded by the text
    out = scanned.drop("found", "__owner", "__repo").join(hits, list(c.KEY), "left")
    empty = F.coalesce("__hits", F.array().cast(hits.schema["__hits"].dataType))
    name = F.array(*[F.lit(k) for k in KINDS])
    text = F.transform("__hits", lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"], x["end"]))
    return out.select(
        *c.KEY, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256",
        F.coalesce(F.array_join(text, ","), F.lit("")).alias("spans"),
        F.coalesce(F.size(F.filter("__hits", lambda x: x["live"])), F.lit(0)).cast("long").alias("n_live"),
        F.coalesce(F.size(F.filter("__hits", lambda x: ~x["live"])), F.lit(0)).cast("long").alias("n_copied"),
        empty.alias("found"))


def redact(docs: DataFrame, mask: str = "<secret>", **options) -> DataFrame:
    """``docs`` with every span of ``find_secrets`` replaced by ``mask`` and ``n_chars``, if there, counted again; all rows and columns stay.

    Base spans are masked whether live or copied: an example that looks like a secret teaches the same as one.
    Only documents that have spans leave the scan for the join; the others pass unchanged.
    """
    found = find_secrets(docs, **options).where("spans <> ''").select(*c.KEY, F.col("found").alias("__f")).dropDuplicates(list(c.KEY))
    rows = docs.select("*", *c.row_key()).join(found, list(c.KEY), "left")
    kept = "concat(acc.text, substring(text, acc.at + 1, x.start - acc.at))"
    masked = F.expr(f"""aggregate(__f, named_struct('text', '', 'at', 0),
        (acc, x) -> if(x.end <= acc.at, acc, named_struct('text', if(x.start < acc.at, acc.text, concat({kept}, '{mask}')), 'at', x.end)),
        acc -> concat(acc.text, substring(text, acc.at + 1)))""")
    rows = rows.withColumn("__masked", masked)
    new = {"text": F.col("__masked")} | ({"n_chars": F.length("__masked").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return rows.select(*[F.when(F.col("__f").isNull(), F.col(f)).otherwise(new[f]).alias(f) if f in new else F.col(f) for f in docs.columns])


def op3_secrets(spark, sf_dir):
    """Secrets of all documents; a document is a repository, its source the owner."""
    return find_secrets(c.read(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_copied")


QUERIES = {"op3_secrets": op3_secrets}
