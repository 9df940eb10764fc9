"""Line dedup by site-relative frequency.

A line is boilerplate of a host if the pages of the host that contain it are more than a given share of all
pages of the host (and at least ``min_pages``). Boilerplate lines are dropped from the host's pages; the rest
of a page stays as it is, line breaks included.

A page has L lines on average, so a host has at most L / ratio boilerplate lines, however many pages it has.
They are kept as one array of line hashes per host and joined to the pages by host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .words import SPACES, same

MAX_RATIO, MIN_PAGES = 0.1, 5
_PPM = 1_000_000


def _line_key(line: Column) -> Column:
    """Lines are compared without surrounding white space."""
    return F.xxhash64(F.btrim(line, F.lit(SPACES)))


def _blank(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES)) == ""


def boilerplate_lines(
    pages: DataFrame, host: str, text: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """``host, lines``: hashes of the lines on more than ``max_ratio`` of the host's pages."""
    site = F.col(host).alias("__host")
    keys = F.array_distinct(
        F.transform(F.filter(F.split(text, "\n"), lambda s: ~_blank(s)), lambda s: _line_key(s))
    )
    counts = pages.select(site, F.explode(keys).alias("line")).groupBy("__host", "line").agg(F.count("*").alias("n"))
    counts = counts.filter(F.col("n") >= min_pages)
    totals = pages.groupBy(site).agg(F.count("*").alias("total")).withColumnRenamed("__host", "__of")
    many = F.col("n") * _PPM > F.col("total") * round(max_ratio * _PPM)
    found = counts.join(totals, same(F.col("__host"), F.col("__of"))).filter(many)
    return found.groupBy("__host").agg(F.collect_set("line").alias("__lines"))


def drop_boilerplate(
    pages: DataFrame,
    host: str = "source",
    text: str = "text",
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """``pages`` with boilerplate lines removed from ``text``, and the struct ``__cut`` of ``n_lines, n_dropped``.

    A NULL host is a host of its own. A NULL text stays NULL and has no lines; blank lines are never dropped.
    A line that a page repeats counts once for the page and is dropped everywhere in it. Repeated rows are
    pages of their own. A page that loses all lines stays, with an empty text. Other columns pass through; names
    that begin with ``__`` are reserved. An empty table gives an empty result.
    """
    found = materialize(boilerplate_lines(pages, host, text, max_ratio, min_pages), "boilerplate")
    joined = pages.join(found, same(F.col(host), F.col("__host")), "left")
    split = F.split(text, "\n")
    # the array is read only where the host has boilerplate at all
    kept = F.when(
        F.col("__lines").isNotNull(),
        F.filter(split, lambda s: _blank(s) | ~F.array_contains("__lines", _line_key(s))),
    ).otherwise(split)
    out = joined.withColumn("__kept", kept)
    none, n_lines = F.col(text).isNull(), F.size(split)
    cut = F.struct(
        F.when(none, 0).otherwise(n_lines).cast("bigint").alias("n_lines"),
        F.when(none, 0).otherwise(n_lines - F.size("__kept")).cast("bigint").alias("n_dropped"),
    )
    cleaned = [F.array_join("__kept", "\n").alias(c) if c == text else F.col(c) for c in pages.columns]
    return out.select(*cleaned, cut.alias("__cut"))
