"""Lines that a site repeats.

Pages are grouped by host. For every line the pages of the host that contain it are divided by all pages of the host, and
lines above the ratio are boilerplate: they are taken out of every page of that host. Exact copies of a page count as one
page, on both sides of the ratio, else a page that was copied a thousand times would be emptied; copies are the business of
the near-duplicate stage.

Lines are compared without blanks at their ends; empty lines are never boilerplate and stay. A null host is a host of its
own. A null text stays null, with no lines. Repeated rows get the same result each. Extra columns are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.llm import common

MAX_RATIO = 0.02
#: A line on fewer pages than this is no boilerplate, however small the host.
MIN_PAGES = 5
BLANKS = " \t\r"


def _line(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def _key(c: Column) -> Column:
    return F.struct(F.xxhash64(c).alias("h"), F.crc32(c).alias("c"))


def boilerplate_lines(pages: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line, n) of `pages` (host, page, lines: array of line keys): lines above the ratio, and their pages."""
    one = pages.select("host", "page").distinct()
    totals = one.groupBy("host").agg(F.count("*").alias("_pages"))
    lines = pages.select("host", "page", F.explode("lines").alias("line")).distinct()
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    return counts.join(totals, "host").where(F.col("n") > max_ratio * F.col("_pages")).select("host", "line", "n")


def drop_boilerplate(
    docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """All columns, the text without its boilerplate lines, and n_lines and n_dropped (long).

    Texts are shuffled once, in the last join; before it only hashes of lines move.
    """
    h = F.xxhash64(F.col(host).isNull(), F.col(host))
    k1, k2 = common.text_key(F.col(host), F.col(text))
    keyed = docs.withColumns({"_k1": k1, "_k2": k2})
    split = F.split(F.col(text), "\n", -1)
    keys = F.array_distinct(F.transform(F.filter(F.transform(split, _line), lambda x: x != ""), _key))
    pages = common.written(docs.where(F.col(text).isNotNull()).select(h.alias("host"), F.struct(k1.alias("k1"), k2.alias("k2")).alias("page"), keys.alias("lines")), "host-lines")
    frequent = common.written(boilerplate_lines(pages, max_ratio, min_pages).select(F.struct("host", "line").alias("at"), "n"), "boilerplate")
    slim = common.written(pages.select("page", F.explode("lines").alias("line"), "host").select(F.struct("host", "line").alias("at"), "page").distinct(), "page-lines")
    found = common.hot_join(slim, frequent, "at")
    drops = found.groupBy("page").agg(F.collect_set("at.line").alias("_drop")).select(F.col("page.k1").alias("_k1"), F.col("page.k2").alias("_k2"), "_drop")
    out = keyed.join(drops, ["_k1", "_k2"], "left")
    kept = F.when(F.col("_drop").isNull(), split).otherwise(F.filter(split, lambda x: ~F.array_contains("_drop", _key(_line(x)))))
    total = F.coalesce(F.size(split), F.lit(0)).cast("long")
    out = out.withColumns({"_kept": kept}).withColumns({
        "n_lines": F.when(F.col(text).isNull(), 0).otherwise(total).cast("long"),
        "n_dropped": F.when(F.col(text).isNull(), 0).otherwise(total - F.size("_kept")).cast("long"),
        text: F.array_join("_kept", "\n"),
    })
    return out.select(*docs.columns, *[c for c in ("n_lines", "n_dropped") if c not in docs.columns])
