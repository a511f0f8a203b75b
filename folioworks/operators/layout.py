"""Geometry over words: rows, spans, neighbours, skew. Distances are relative to text height.

Words have file, page, word_id, line_id, text, x0, y0, x1, y1, conf. Pages have file, page, width, height, role.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioworks.functions import text as t
from folioworks.functions.geometry import Box, box, v_overlap
from folioworks.session import spread_by

PAGE = ["file", "page"]


def with_geometry(words: DataFrame) -> DataFrame:
    return (
        words.withColumn("cx", (F.col("x0") + F.col("x1")) / 2).withColumn("cy", (F.col("y0") + F.col("y1")) / 2)
        .withColumn("h", F.col("y1") - F.col("y0")).withColumn("key", t.alnum_key(F.col("text")))
    )


def page_stats(words: DataFrame) -> DataFrame:
    """Median height of the words with a height, 20 when a page has none."""
    h = F.col("y1") - F.col("y0")
    return words.groupBy(*PAGE).agg(F.coalesce(F.median(F.when(h > 0, h)), F.lit(20.0)).alias("text_h"))


def confidence_stats(words: DataFrame, by: list[str]) -> DataFrame:
    return words.groupBy(*by).agg(
        F.count("*").alias("words"), F.round(F.avg("conf"), 4).alias("mean_confidence"), F.count_if(F.col("conf") < 0.8).alias("low_confidence")
    )


def page_text(lines: DataFrame) -> DataFrame:
    """Line texts joined by newlines, in line order."""
    return lines.groupBy(*PAGE).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_id", "text"))), lambda s: s["text"]), "\n").alias("text")
    )


# ---- rows ------------------------------------------------------------------------------------
def _grown(words: Column) -> Column:
    """Row numbers of a tangled band's words, by centre height: each joins the first row whose growing box it overlaps enough."""

    def add(acc: Column, x: Column) -> Column:
        def fits(r: Column) -> Column:
            high, own = r["y1"] - r["y0"], x["y1"] - x["y0"]
            shared = F.greatest(F.lit(0.0), F.least(r["y1"], x["y1"]) - F.greatest(r["y0"], x["y0"])) / F.greatest(F.lit(1.0), F.least(high, own))
            return (shared >= 0.5) & (F.abs(r["y0"] + r["y1"] - x["y0"] - x["y1"]) / 2 < F.greatest(high, own))

        def put(hit: Column) -> Column:
            wider = lambda r: F.when(r["n"] == hit, F.struct(F.least(r["y0"], x["y0"]).alias("y0"), F.greatest(r["y1"], x["y1"]).alias("y1"), r["n"].alias("n"))).otherwise(r)
            opened = F.array(F.struct(x["y0"].alias("y0"), x["y1"].alias("y1"), F.size(acc["rows"]).alias("n")))
            rows = F.when(hit.isNotNull(), F.transform(acc["rows"], wider)).otherwise(F.concat(acc["rows"], opened))
            return F.struct(rows.alias("rows"), F.concat(acc["picked"], F.array(F.coalesce(hit, F.size(acc["rows"])))).alias("picked"))

        # the row that is met is looked for once a word
        return F.get(F.transform(F.array(F.get(F.filter(acc["rows"], fits), F.lit(0))["n"]), put), F.lit(0))

    start = F.struct(F.array().cast("array<struct<y0:double,y1:double,n:int>>").alias("rows"), F.array().cast("array<int>").alias("picked"))
    return F.aggregate(words, start, add, lambda acc: acc["picked"])


def visual_rows(words: DataFrame, mode: str = "exact") -> DataFrame:
    """Words with row_id (top to bottom) and pos (left to right, from 1).

    Bands of words that share no vertical extent with other bands are separated first with windows; words of
    different bands can never share a row. A band whose words all cross one core strip is one row; only tangled bands
    are grown word by word, in the JVM. `mode="islands"` takes every band as a row.
    Words are dealt by page over all tasks once, whatever their size in the shuffle, and every step goes on from there: nothing
    is joined, for a join by word would deal all words anew, and the steps behind it again.
    """
    w = with_geometry(spread_by(words, *PAGE))
    cols = w.columns
    above = Window.partitionBy(*PAGE).orderBy("y0", "y1", "word_id").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*PAGE).orderBy("y0", "y1", "word_id").rowsBetween(Window.unboundedPreceding, 0)
    w = w.withColumn("_new", F.when(F.col("y0") >= F.max("y1").over(above), 1).otherwise(0)).withColumn("_band", F.sum("_new").over(upto))
    if mode == "islands":
        rows = w.withColumn("_sub", F.lit(0))
    else:
        one = F.struct("cy", "word_id", F.col("y0").cast("double").alias("y0"), F.col("y1").cast("double").alias("y1"), F.struct(*[c for c in cols if c not in PAGE]).alias("row"))
        simple = (F.min("y1") - F.max("y0") > 0.5 * F.max("h")) & (F.min("h") >= 1)
        bands = w.groupBy(*PAGE, "_band").agg(F.collect_list(one).alias("_w"), F.coalesce(simple, F.lit(True)).alias("_one"))
        bands = bands.withColumn("_w", F.when(F.col("_one"), F.col("_w")).otherwise(F.array_sort("_w")))
        bands = bands.withColumn("_r", F.when(F.col("_one"), F.array_repeat(F.lit(0), F.size("_w"))).otherwise(_grown(F.col("_w"))))
        flat = bands.select(*PAGE, "_band", "_r", F.posexplode("_w").alias("_i", "_x"))
        rows = flat.select(*PAGE, "_band", F.get("_r", F.col("_i")).alias("_sub"), "_x.row.*").select(*cols, "_band", "_sub")
    row = Window.partitionBy(*PAGE, "_band", "_sub")
    rows = rows.withColumn("_ry", F.avg("cy").over(row))
    order = Window.partitionBy(*PAGE).orderBy("_ry", "_band", "_sub")
    inside = row.orderBy("x0", "cy", "word_id")
    out = rows.withColumn("row_id", F.dense_rank().over(order)).withColumn("pos", F.row_number().over(inside))
    return out.select(*cols, "row_id", "pos")


def card_rows(lines: DataFrame) -> DataFrame:
    """Printed rows of a card (row_id from 0): a line joins the first of the last four rows whose tallest line it overlaps.

    Bands of lines without a common height with other bands are told apart first, for lines of different bands never share
    a row. A band whose lines all overlap and centre closely enough is one row; others are folded line by line in the JVM,
    with the last four rows as the state.
    """
    cols = lines.columns
    l = spread_by(lines, *PAGE).withColumns({"_top": F.least("y0", "y1").cast("double"), "_end": F.greatest("y0", "y1").cast("double"), "_cy": (F.col("y0") + F.col("y1")) / 2})
    order = Window.partitionBy(*PAGE).orderBy("_top", "_end", "line_id")
    new = F.when(F.col("_top") >= F.max("_end").over(order.rowsBetween(Window.unboundedPreceding, -1)), 1).otherwise(0)
    l = l.withColumn("_new", new).withColumn("_band", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    one = F.struct(F.col("_cy").alias("cy"), "line_id", F.col("y0").cast("double").alias("y0"), F.col("y1").cast("double").alias("y1"), F.struct(*[c for c in cols if c not in PAGE]).alias("row"))
    high = (F.col("y1") - F.col("y0")).cast("double")
    # whichever of its lines stands for the row, every other one fits it
    alike = (F.min(high) >= 1) & (F.min("y1").cast("double") - F.max("y0").cast("double") >= 0.55 * F.max(high)) & (F.max("_cy") - F.min("_cy") < 0.6 * F.min(high))
    bands = l.groupBy(*PAGE, "_band").agg(F.array_sort(F.collect_list(one)).alias("_l"), alike.alias("_one"))

    def tall(x: Column) -> Column:
        return F.greatest(F.lit(1.0), x["y1"] - x["y0"])

    def add(acc: Column, x: Column) -> Column:
        def fits(r: Column) -> Column:
            shared = F.least(r["y1"], x["y1"]) - F.greatest(r["y0"], x["y0"])
            apart = F.abs((r["y0"] + r["y1"]) / 2 - x["cy"])
            return (shared >= 0.55 * F.least(tall(r), tall(x))) & (apart < 0.6 * F.greatest(tall(r), tall(x)))

        def grown(r: Column, hit: Column) -> Column:
            taller = (r["n"] == hit) & (tall(x) > tall(r))
            return F.struct(F.when(taller, x["y0"]).otherwise(r["y0"]).alias("y0"), F.when(taller, x["y1"]).otherwise(r["y1"]).alias("y1"), r["n"].alias("n"))

        def put(hit: Column) -> Column:
            opened = F.array(F.struct(x["y0"].alias("y0"), x["y1"].alias("y1"), acc["n"].alias("n")))
            kept = F.when(F.size(acc["last"]) < 4, acc["last"]).otherwise(F.slice(acc["last"], 2, 3))
            last = F.when(hit.isNotNull(), F.transform(acc["last"], lambda r: grown(r, hit))).otherwise(F.concat(kept, opened))
            picked = F.concat(acc["rows"], F.array(F.coalesce(hit, acc["n"])))
            return F.struct(last.alias("last"), (acc["n"] + F.when(hit.isNull(), 1).otherwise(0)).alias("n"), picked.alias("rows"))

        # the row that is met is looked for once a line
        return F.get(F.transform(F.array(F.get(F.filter(acc["last"], fits), F.lit(0))["n"]), put), F.lit(0))

    start = F.struct(
        F.array().cast("array<struct<y0:double,y1:double,n:int>>").alias("last"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("rows")
    )
    folded = F.when((F.size("_l") == 1) | F.col("_one"), F.array_repeat(F.lit(0), F.size("_l"))).otherwise(F.aggregate("_l", start, add, lambda acc: acc["rows"]))
    flat = bands.withColumn("_r", folded).select("*", F.posexplode("_l").alias("_i", "_x"))
    flat = flat.select(*PAGE, "_band", F.get("_r", F.col("_i")).alias("_sub"), "_x.row.*")
    by_row = Window.partitionBy(*PAGE).orderBy("_band", "_sub")
    return flat.withColumn("row_id", F.dense_rank().over(by_row) - 1).select(*cols, "row_id")


def gap_islands(df: DataFrame, group: list[str], order: list, start: Column, stop: Column, limit: Column | float, name: str = "island") -> DataFrame:
    """Runs of consecutive items whose gap stays within a limit."""
    w = Window.partitionBy(*group).orderBy(*order)
    gap = start - F.lag(stop).over(w)
    return df.withColumn("_b", F.when(gap > limit, 1).otherwise(0)).withColumn(name, F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_b")


# ---- spans -----------------------------------------------------------------------------------
def following(words: DataFrame, group: list[str], order: list[str], max_len: int, what: Column) -> Column:
    """Array of this item and the next ones, up to max_len, inside the group."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(0, max_len - 1)
    return F.collect_list(what).over(w)


def spans(words: DataFrame, group: list[str], order: list[str], max_len: int) -> DataFrame:
    """Every contiguous run of 1..max_len words inside a group: start word, length, joined text."""
    item = F.struct("word_id", "text")
    ahead = words.withColumn("_next", following(words, group, order, max_len, item))
    out = ahead.select(*group, F.col("word_id").alias("start_word"), F.explode(F.sequence(F.lit(1), F.size("_next"))).alias("n_words"), "_next")
    part = F.slice("_next", 1, F.col("n_words"))
    return out.select(
        *group, "start_word", "n_words", F.transform(part, lambda s: s["word_id"]).alias("word_ids"),
        F.array_join(F.transform(part, lambda s: s["text"]), " ").alias("text"),
    )


def line_pairs(lines: DataFrame, stop_at_pages: bool = False) -> DataFrame:
    """Each line with the next one of the document; a pair may cross a page border unless told not to."""
    keys = PAGE if stop_at_pages else ["file"]
    w = Window.partitionBy(*keys).orderBy("page", "line_id")
    pairs = lines.withColumn("next", F.lead("text").over(w)).withColumn("_to", F.lead("page").over(w)).where("next is not null")
    return pairs.select("file", "page", "line_id", F.concat_ws(" ", "text", "next").alias("text"), (F.col("_to") != F.col("page")).alias("crosses"))


def overlap_windows(tokens: DataFrame, key: str, n: str, body: int, stride: int) -> DataFrame:
    """Windows of `body` tokens, each starting `stride` tokens before the last one ended."""
    if not 0 <= stride < body:
        raise ValueError("the stride must be smaller than the window")
    step = body - stride
    count = F.when(F.col(n) <= body, 1).otherwise(F.ceil((F.col(n) - body) / step) + 1)
    out = tokens.select(key, n, F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("window"))
    start = F.col("window") * step
    return out.select(key, "window", start.alias("start"), F.least(start + body, F.col(n)).alias("stop"))


# ---- neighbours ------------------------------------------------------------------------------
def line_slopes(words: DataFrame, pages: DataFrame, min_words: int = 3, min_share: float = 0.15) -> DataFrame:
    """Least-squares slope of each line wide enough to tell."""
    g = with_geometry(words)
    lines = g.groupBy(*PAGE, "line_id").agg(
        F.count("*").alias("n"), F.regr_slope("cy", "cx").alias("slope"), (F.max("cx") - F.min("cx")).alias("wide")
    )
    return lines.join(pages.select(*PAGE, "width"), PAGE).where((F.col("n") >= min_words) & (F.col("wide") > 0) & (F.col("wide") >= F.col("width") * min_share) & F.col("slope").isNotNull())


def page_skew(words: DataFrame, pages: DataFrame) -> DataFrame:
    """Upper median of the line slopes, clamped to 0.1; 0 with fewer than three lines."""
    per_page = line_slopes(words, pages).groupBy(*PAGE).agg(F.array_sort(F.collect_list("slope")).alias("s"))
    mid = F.get("s", F.floor(F.size("s") / 2).cast("int"))
    known = per_page.select(*PAGE, F.when(F.size("s") < 3, 0.0).otherwise(F.greatest(F.lit(-0.1), F.least(F.lit(0.1), mid))).alias("skew"))
    return pages.select(*PAGE).join(known, PAGE, "left").select(*PAGE, F.coalesce("skew", F.lit(0.0)).alias("skew"))


def words_right_of(anchors: DataFrame, words: DataFrame, stats: DataFrame, max_gap: float, exclude: str = "word_ids") -> DataFrame:
    """Words to the right of each anchor on its row, up to the first gap wider than max_gap text heights.

    Anchors carry anchor_id, a box with the prefix a_, and the ids of their own words.
    """
    a = anchors.join(stats, PAGE).select(*PAGE, "anchor_id", "text_h", F.col(exclude).alias("_own"), *[F.col(f"a_{k}") for k in ("x0", "y0", "x1", "y1")])
    near = (
        (F.col("x0") >= F.col("a_x1") - F.col("text_h") * 0.3)
        & (v_overlap(box("a_"), box()) >= 0.45)
        & ~F.array_contains("_own", F.col("word_id"))
    )
    c = a.join(words, PAGE).where(near)
    w = Window.partitionBy(*PAGE, "anchor_id").orderBy("x0", "cy", "word_id")
    gap = F.col("x0") - F.coalesce(F.lag("x1").over(w), F.col("a_x1"))
    broken = F.sum(F.when(gap > max_gap * F.col("text_h"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return c.withColumn("_broken", broken).where("_broken = 0").drop("_broken", "_own")


def nearest(left: DataFrame, right: DataFrame, on: list[str], left_id: str, condition: Column, distance: list[Column], take: list[str]) -> DataFrame:
    """For each left item the right item that meets the condition at the smallest distance (total order)."""
    both = left.join(right, on).where(condition)
    best = F.min_by(F.struct(*take), F.struct(*[d.alias(f"d{i}") for i, d in enumerate(distance)]))
    return both.groupBy(*on, left_id).agg(best.alias("_b")).select(*on, left_id, "_b.*")


def same_row(a_y: Column, a_h: Column, b_y: Column, b_h: Column, tolerance: float = 0.6) -> Column:
    return F.abs(a_y - b_y) <= tolerance * F.greatest(a_h, b_h)


def jitter_boxes(words: DataFrame, seed: int, jitter: float = 0.004, scale: float = 0.03, size: int = 1000, copy: int = 0) -> DataFrame:
    """Boxes (0..size) moved a little per word and scaled per page; the draw depends on seed and ids only."""

    def unit(*ids: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(copy), *ids), F.lit(1_000_003)) / 1_000_003.0 * 2 - 1

    k = 1 + scale * unit(F.col("file"), F.col("page"))
    move = lambda c: F.greatest(F.lit(0), F.least(F.lit(size), F.bround(F.col(c) * k + jitter * size * unit(F.col("file"), F.col("page"), F.col("word_id"), F.lit(c))).cast("int")))
    out = words.select("*", *[move(c).alias(f"j{c}") for c in ("x0", "y0", "x1", "y1")])
    return out.withColumn("jx1", F.greatest("jx0", "jx1")).withColumn("jy1", F.greatest("jy0", "jy1"))


def page_box(prefix: str) -> Box:
    return box(prefix)
