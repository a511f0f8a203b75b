"""Printed documents derived from the order tables by Spark, so layout work grows with the tables.

Every customer gets a certificate whose subject rows are the customer's orders. A page prints at most about
25 orders: orders are dealt to pages by hash, so a customer with very many orders gets very many pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioworks import vocab
from folioworks.functions.text import spell_digits
from folioworks.session import Part, of_part, spread_by, table

_SUBJECTS = ["ENGLISH", "SANSKRIT", "MATHEMATICS", "PHYSICS", "CHEMISTRY", "BOTANY", "ZOOLOGY", "ECONOMICS", "COMMERCE", "CIVICS", "HISTORY", "GEOGRAPHY"]
_PER_PAGE = 25
#: So many orders are printed, read and done with before the next ones are begun, where reading leaves much on disk.
PART_ORDERS = 450_000
_TOP, _STEP, _CHAR, _HIGH = 440, 40, 10, 20


def letters(n: Column) -> Column:
    """A number as letters, A for 0."""
    return F.translate((n + 100000).cast("string"), "0123456789", "ABCDEFGHIJ")


def _pick(values: list[str], k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values)).cast("int") + 1)


def certificate_parts(spark: SparkSession, root: str, orders: int | None = None) -> int:
    """How many parts the customers are dealt to, for about `PART_ORDERS` orders a part, or so many."""
    return max(1, -(-table(spark, root, "orders").count() // (orders or PART_ORDERS)))


def certificate_orders(spark: SparkSession, root: str, part: Part | None = None) -> DataFrame:
    """Subject rows: file, page, place on the page, name and both papers' marks.

    An order is a few bytes and becomes many printed words, so pages are dealt over all tasks before they are printed, and
    joins by customer are not broadcast by a guess from the files' sizes.
    """
    o = table(spark, root, "orders").select("o_orderkey", "o_custkey").where(of_part(F.col("o_custkey"), part))
    n = o.groupBy("o_custkey").agg(F.ceil(F.count("*") / _PER_PAGE).alias("_pages"))
    o = o.join(n.hint("merge"), "o_custkey").withColumn("page", (F.pmod(F.xxhash64("o_orderkey"), F.col("_pages")) + 1).cast("int"))
    o = spread_by(o.withColumn("file", file_name(F.col("o_custkey"))), "file", "page")
    place = F.row_number().over(Window.partitionBy("file", "page").orderBy("o_orderkey"))
    k = F.col("o_orderkey")
    return o.select(
        "file", F.col("o_custkey").alias("custkey"), "page", place.alias("place"), "o_orderkey",
        F.concat(_pick(_SUBJECTS, k), F.lit(" "), letters(k)).alias("subject_name"),
        ((k * 7) % 101).cast("int").alias("first"), ((k * 13 + 5) % 101).cast("int").alias("second"),
    )


def file_name(custkey: Column) -> Column:
    return F.concat(F.lit("certificate_"), custkey.cast("string"), F.lit(".pdf"))


def is_ledger(custkey: Column) -> Column:
    """Every 17th customer is printed as something that is no certificate."""
    return custkey % 17 == 5


def certificate_truth(spark: SparkSession, root: str, part: Part | None = None) -> DataFrame:
    """What each certificate says, straight from the tables."""
    rows = certificate_orders(spark, root, part)
    totals = rows.groupBy("custkey").agg(
        F.sum(F.col("first") + F.col("second")).cast("int").alias("total_marks"), F.count("*").cast("int").alias("n_rows")
    )
    k = F.col("c_custkey")
    c = table(spark, root, "customer").where(of_part(k, part))
    return c.join(totals.hint("merge"), k == F.col("custkey")).select(
        file_name(k).alias("file"), k.alias("custkey"), is_ledger(k).alias("ledger"),
        F.concat("c_mktsegment", F.lit(" "), letters(k)).alias("student_name"),
        F.concat(F.lit("RAM "), letters(k * 3)).alias("father_name"),
        F.concat(F.lit("SITA "), letters(k * 7)).alias("mother_name"),
        F.concat(F.lpad(((k + 90) % 35 % 25).cast("string"), 2, "0"), F.lpad((k % 100000000).cast("string"), 8, "0")).alias("hall_ticket_number"),
        (F.lit(1990) + k % 35).cast("int").alias("year_of_pass"), _pick(vocab.MONTHS, k).alias("month_of_pass"),
        _pick(vocab.MEDIA, k).alias("medium"), _pick(vocab.RESULTS, k).alias("result"), "total_marks", "n_rows",
        F.when(k % 3 == 0, "TELANGANA STATE BOARD OF INTERMEDIATE EDUCATION")
        .when(k % 3 == 1, "BOARD OF INTERMEDIATE EDUCATION, ANDHRA PRADESH")
        .otherwise("BOARD OF INTERMEDIATE EDUCATION, A.P.").alias("board_line"),
    )


def _line(text: Column, x: int, y: Column, slot: int) -> Column:
    return F.struct(F.lit(slot).alias("slot"), text.alias("text"), F.lit(x).alias("x"), y.cast("int").alias("y"))


def certificate_lines(spark: SparkSession, root: str, part: Part | None = None) -> DataFrame:
    """Positioned lines (file, page, line_id, text, box, conf), tilted a little for two customers in three."""
    t = certificate_truth(spark, root, part)
    k = F.col("custkey")
    label = F.when(k % 10 == 3, "This is to certlfy that").otherwise("This is to certify that")
    say = lambda a, b: F.concat(a if isinstance(a, Column) else F.lit(a), F.lit(" "), b.cast("string"))
    y = F.lit
    head = [
        _line(F.when(F.col("ledger"), "QUARTERLY LEDGER SUMMARY").otherwise(F.col("board_line")), 300, y(20), 1),
        _line(F.when(F.col("ledger"), "PREPARED FOR THE OFFICE").otherwise("PASS CERTIFICATE CUM MEMORANDUM OF MARKS"), 300, y(60), 2),
        _line(say(label, F.col("student_name")), 60, y(100), 3),
        _line(say("Father's Name", F.col("father_name")), 60, y(140), 4),
        _line(say("Mother's Name", F.col("mother_name")), 60, y(180), 5),
        _line(say("Registered No", F.col("hall_ticket_number")), 60, y(220), 6),
        _line(say("Examination held in", F.concat_ws(" ", "month_of_pass", "year_of_pass")), 60, y(260), 7),
        _line(say("and passed in", F.col("result")), 60, y(300), 8),
        _line(say("Medium of Instruction", F.col("medium")), 60, y(340), 9),
    ]
    first = t.select("file", "custkey", F.lit(1).alias("page"), F.explode(F.array(*head)).alias("l"))
    rows = certificate_orders(spark, root, part)
    m1 = F.concat(F.when(F.col("o_orderkey") % 2 == 0, F.lpad(F.col("first").cast("string"), 3, "0")).otherwise(F.col("first").cast("string")), F.when(F.col("o_orderkey") % 5 == 0, "*").otherwise(""))
    at = F.lit(_TOP) + F.col("place") * _STEP
    base = 100 + F.col("place") * 10
    cells = F.array(*[
        F.struct((base + i).cast("int").alias("slot"), text.alias("text"), F.lit(x).alias("x"), at.cast("int").alias("y"))
        for i, (text, x) in enumerate([
            (F.col("subject_name"), 60), (F.lit("100"), 480), (m1, 600), (F.lit("100"), 780), (F.col("second").cast("string"), 900)
        ])
    ])
    body = rows.select("file", "custkey", "page", F.explode(cells).alias("l"))
    n = rows.groupBy("file", "custkey", "page").agg(F.max("place").alias("n"))
    header = [_line(F.lit("Subject"), 60, y(400), 20), _line(F.lit("I Year"), 520, y(400), 21), _line(F.lit("II Year"), 820, y(400), 22)]
    heads = n.select("file", "custkey", "page", F.explode(F.array(*header)).alias("l"))
    end = F.lit(_TOP) + (F.col("n") + 2) * _STEP
    foot = [_line(say("Total Marks", F.col("total_marks")), 60, end, 90000), _line(say("In Words", spell_digits(F.col("total_marks"))), 60, end + _STEP, 90001)]
    # the total stands on the first page that carries rows, which is page 1 when there is one page
    last = n.groupBy("file", "custkey").agg(F.min_by("n", "page").alias("n"), F.min("page").alias("page")).join(t.select("file", "total_marks").hint("merge"), "file")
    feet = last.select("file", "custkey", "page", F.explode(F.array(*foot)).alias("l"))
    all_ = first.unionByName(body).unionByName(heads).unionByName(feet)
    tilt = (F.col("custkey") % 3) * 0.004
    wide = F.length("l.text") * _CHAR
    top = (F.col("l.y") + F.round(tilt * (F.col("l.x") + wide / 2))).cast("int")
    return all_.select(
        "file", "page", F.col("l.slot").alias("line_id"), F.col("l.text").alias("text"), F.col("l.x").alias("x0"), top.alias("y0"),
        (F.col("l.x") + wide).cast("int").alias("x1"), (top + _HIGH).cast("int").alias("y1"),
        (F.lit(0.80) + ((F.col("custkey") * 31 + F.col("l.slot") * 7) % 20) / 100).alias("conf"),
    )


def lines_to_words(lines: DataFrame, *keep: str) -> DataFrame:
    """Words of positioned lines: every character is equally wide; a word's id is line id x 1000 + place. `keep` names further columns."""
    parts = F.split("text", " ")
    w = lines.select("*", F.posexplode(parts).alias("i", "w"), parts.alias("_p")).where("w <> ''")
    before = F.when(F.col("i") == 0, 0).otherwise(F.length(F.array_join(F.slice("_p", F.lit(1), F.col("i")), " ")) + 1)
    step = (F.col("x1") - F.col("x0")) / F.length("text")
    left = (F.col("x0") + F.floor(before * step)).cast("int")
    return w.select(
        "file", "page", (F.col("line_id") * 1000 + F.col("i")).cast("int").alias("word_id"), "line_id", F.col("w").alias("text"),
        left.alias("x0"), "y0", (left + F.floor(F.length("w") * step) - 2).cast("int").alias("x1"), "y1", "conf", *keep,
    )


_WIDE, _BELOW = 1100, 60


def certificate_pages(lines: DataFrame) -> DataFrame:
    return lines.groupBy("file", "page").agg(F.lit(_WIDE).alias("width"), (F.max("y1") + _BELOW).cast("int").alias("height")).withColumn("role", F.lit("certificate"))


def with_page_size(lines: DataFrame) -> DataFrame:
    """Lines with the width and height of their page, as `certificate_pages` has them: printed once, and not joined with themselves."""
    page = Window.partitionBy("file", "page")
    return spread_by(lines, "file", "page").withColumns({"width": F.lit(_WIDE), "height": (F.max("y1").over(page) + _BELOW).cast("int")})


def document_lines(spark: SparkSession, root: str, per_page: int = 40) -> DataFrame:
    """The lines of every whole text, dealt to pages of `per_page` lines."""
    d = table(spark, root, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    return d.select(
        F.col("doc_id").cast("string").alias("file"), (F.floor(F.col("i") / per_page) + 1).cast("int").alias("page"), F.col("i").alias("line_id"), "text", "doc_id"
    )
