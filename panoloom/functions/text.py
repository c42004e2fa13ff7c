"""Names, titles, durations and numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panoloom.settings import (CAPTURE_PREFIX, NAME_FORBIDDEN, NAME_TAIL, PDF_SUFFIX,
                               STANDALONE_NUMBER, TITLE_DROP, TITLE_MAX)

_ENDS = r"^[\x00-\x20]+|[\x00-\x20]+$"


def strip_blank(text: Column) -> Column:
    """Trim blanks and control characters from both ends."""
    return F.regexp_replace(text, _ENDS, "")


def safe_title(text: Column) -> Column:
    return F.substring(strip_blank(F.regexp_replace(text, TITLE_DROP, "")), 1, TITLE_MAX)


def safe_filename(name: Column) -> Column:
    """``STRUCT<name, changed, ok>``; ``name`` ends in ``.pdf`` and is NULL when nothing is left."""
    base = F.regexp_replace(name, PDF_SUFFIX, "")
    clean = strip_blank(F.regexp_replace(F.regexp_replace(base, NAME_FORBIDDEN, "_"), NAME_TAIL, ""))
    ok = clean != ""
    return F.struct(F.when(ok, F.concat(clean, F.lit(".pdf"))).alias("name"),
                    (clean != base).alias("changed"), ok.alias("ok"))


def duration_text(ms: Column) -> Column:
    total = F.greatest(F.lit(0), ms)
    sec = F.floor(total / 1000)
    h, m, s = F.floor(sec / 3600), F.floor(sec % 3600 / 60), sec % 60
    return (F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s))
            .otherwise(F.format_string("%02d:%02d", m, s)))


def highest_number(text: Column) -> Column:
    """Highest standalone integer 1..9999, else -1."""
    found = F.regexp_extract_all(text, F.lit(STANDALONE_NUMBER), F.lit(1))
    return F.coalesce(F.array_max(F.transform(found, lambda n: n.cast("int"))), F.lit(-1))


def route_line(line: Column) -> Column:
    """``STRUCT<route, payload>``: capture lines lose their prefix, all others are log lines."""
    hit = F.startswith(line, F.lit(CAPTURE_PREFIX))
    return F.struct(F.when(hit, "capture").otherwise("log").alias("route"),
                    F.when(hit, F.substr(line, F.lit(len(CAPTURE_PREFIX) + 1))).otherwise(line).alias("payload"))
