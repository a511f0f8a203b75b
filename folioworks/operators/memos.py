"""School memos: pages are levelled by a vote on their tilt, then read row by row.

Lines have file, page, line_id, text, x0, y0, x1, y1, conf. Header fields are the text after a label on its printed
row; subject rows and checks are in `identity`. A document is a few pages, so its votes and rows stay small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioworks import vocab
from folioworks.functions import dates
from folioworks.functions import text as t
from folioworks.operators import identity, layout
from folioworks.session import cut_lineage

#: Slopes that are voted on: every 0.002 up to 0.06 on either side.
STEPS = 30


def _measured(lines: DataFrame) -> DataFrame:
    h = F.greatest(F.lit(1.0), (F.col("y1") - F.col("y0")).cast("double"))
    return lines.where(F.trim("text") != "").withColumn("h", h).withColumn("cy", (F.col("y0") + F.col("y1")) / 2)


def page_tilt(lines: DataFrame) -> DataFrame:
    """The slope of each document, by vote: (file, tilt).

    Every grade or number votes for each slope that would put it on the row of a subject area to its left; the slope
    with most votes wins, the flattest and then the rising one on ties. It must beat level (tilt 0) and there must be
    three areas and six cells. A page's areas and cells meet in its row; an area and a cell give a short run of slopes by
    a division, and only these are tried. Votes are counted by (file, slope), and nothing is shuffled after the pages.
    """
    c = F.col
    l = _measured(lines).withColumn("u", F.upper("text"))
    area = c("u").rlike("|".join(rf"^\W*{pat}\b" for _, _, pat in vocab.MEMO_AREAS))
    cell = F.btrim("u", F.lit(" .:*")).rlike(r"^(A1|A2|B1|B2|C1|C2|D1|D2|D|\d{1,3})\*?$")
    l = l.select("file", "page", "line_id", "x0", "x1", "cy", "h", area.alias("area"), cell.alias("cell"))
    one = F.struct(c("x0"), c("x1"), c("cy"), c("h"))
    spot = F.struct(c("line_id"), c("x0"), c("cy"), ((c("x0") + c("x1")) / 2).alias("cx"))
    pages = l.groupBy("file", "page").agg(
        F.count_if("area").alias("a"), F.count_if("cell").alias("b"), F.collect_list(F.when(c("area"), one)).alias("areas"), F.collect_list(F.when(c("cell"), spot)).alias("cells")
    )
    of = Window.partitionBy("file")
    pages = pages.withColumn("enough", (F.sum("a").over(of) >= 3) & (F.sum("b").over(of) >= 6))
    met = pages.where("enough").select("file", "page", "areas", F.explode("cells").alias("q")).select("file", "page", "q", F.explode("areas").alias("a")).where(c("q.x0") > c("a.x1"))
    dx, dy, reach = c("q.cx") - c("a.x0"), c("q.cy") - c("a.cy"), 0.3 * c("a.h")
    # a slope k in thousandths times 2 is near enough between (dy - reach) and (dy + reach) over dx; one more on either side is left to the exact test
    ends = [F.when(dx == 0, F.lit(far)).otherwise(pick((dy - reach) / dx, (dy + reach) / dx) * 500.0 + one_more) for far, pick, one_more in ((-STEPS, F.least, -1.0), (STEPS, F.greatest, 1.0))]
    met = met.withColumns({"low": F.greatest(F.floor(ends[0]), F.lit(-STEPS)).cast("int"), "high": F.least(F.ceil(ends[1]), F.lit(STEPS)).cast("int")}).where("low <= high")
    tried = met.select("file", "page", c("q.line_id").alias("line_id"), dx.alias("dx"), c("q.cy").alias("cy"), c("a.cy").alias("a_cy"), c("a.h").alias("a_h"), F.explode(F.sequence("low", "high")).alias("step"))
    fits = F.abs(c("cy") - (c("step") * 2 / F.lit(1000.0)) * c("dx") - c("a_cy")) < 0.3 * c("a_h")
    # a cell votes once for a slope, however many areas it meets by it: its slopes are bits of one number
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), c("step") + STEPS)
    cast = tried.where(fits).groupBy("file", "page", "line_id").agg(F.bit_or(bit).alias("bits"))
    every = F.explode(F.array(*[F.lit(k) for k in range(-STEPS, STEPS + 1)])).alias("step")
    votes = cast.select("file", "bits", every).where(F.call_function("shiftright", c("bits"), c("step") + STEPS).bitwiseAND(F.lit(1).cast("long")) == 1)
    tally = votes.groupBy("file", "step").agg(F.count("*").alias("n"))
    best = tally.groupBy("file").agg(F.max(F.struct("n", -F.abs("step"), "step")).alias("b"), F.coalesce(F.max(F.when(c("step") == 0, c("n"))), F.lit(0)).alias("level"))
    won = best.where(c("b.n") > c("level")).select("file", (c("b.step") * 2 / F.lit(1000.0)).alias("tilt"))
    return pages.groupBy("file").agg(F.lit(0).alias("_")).join(won.hint("merge"), "file", "left").select("file", F.coalesce("tilt", F.lit(0.0)).alias("tilt"))


def level(lines: DataFrame, tilts: DataFrame) -> DataFrame:
    """Lines moved up or down so that a page printed on a slope reads like a level one."""
    d = F.col("tilt") * ((F.col("x0") + F.col("x1")) / 2)
    out = lines.join(tilts.hint("merge"), "file")
    return out.withColumns({"y0": F.col("y0") - d, "y1": F.col("y1") - d}).select(*lines.columns)


def memo_rows(lines: DataFrame) -> DataFrame:
    """Printed rows in reading order: (file, page, row_no, text, conf, cy, h, parts); `parts` are the row's lines from left to right."""
    l = layout.card_rows(_measured(lines))
    part = F.struct("x0", "cy", "line_id", "text", "x1", "h", "conf")
    r = l.groupBy("file", "page", "row_id").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.min("conf").alias("conf"), F.avg("cy").alias("cy"), F.min("h").alias("h"))
    text = F.array_join(F.transform("parts", lambda p: F.trim(p["text"])), " ")
    return r.select("file", "page", F.struct("page", "row_id").alias("row_no"), text.alias("text"), "conf", "cy", "h", "parts")


def _sureness(value: Column, parts: Column, row_conf: Column) -> Column:
    """Confidence of the lines that hold a value, else of the row."""
    nv = t.alnum_key(value)

    def holds(p: Column) -> Column:
        k = t.alnum_key(p["text"])
        return (k != "") & (nv.contains(k) | k.contains(nv))

    own = F.array_min(F.transform(F.filter(parts, holds), lambda p: p["conf"]))
    return F.round(F.coalesce(own, row_conf), 4)


def _read(key: str, v: Column, today: str) -> Column:
    """A field's value in the text behind its label; '' if it is none."""
    if key == "roll_number":
        return F.regexp_extract(F.when(v.rlike(r"\d{4}"), t.repair_digits(v, card=True)).otherwise(v), r"\b(\d{6,12})\b", 1)
    if key == "date_of_birth":
        return F.coalesce(dates.parse_date(v, today).cast("string"), F.lit(""))
    if key == "school":
        return t.tidy_name(v)
    if key == "medium":
        return F.regexp_extract(v, r"^(\S*)", 1)
    name = t.tidy_name(F.get(F.split(v, r"(?i)\s{2,}|\bBEARING\b|\bS\s*/\s*O\b"), F.lit(0)))
    return F.when(t.name_like(name), name).otherwise("")


def _read_alone(key: str, v: Column, today: str) -> Column:
    """A field's value in a line that stands apart from its label."""
    if key == "roll_number":
        return F.regexp_extract(v, r"^(\d{6,12})$", 1)
    if key == "date_of_birth":
        return _read(key, v, today)
    if key == "medium":
        return F.when(F.upper(v).rlike("^[A-Z]+$"), v).otherwise("")
    return F.when(F.length(v) > 8, t.tidy_name(v)).otherwise("")


_NEAR = {"date_of_birth": 2.2, "school": 1.0, "medium": 1.0, "roll_number": 1.0}
_PUNCTUATION = " :;.,-("


def header_fields(rows: DataFrame, today: str) -> DataFrame:
    """Header values of memos: (file, field, value, confidence).

    The first row with the label and a readable value counts. Date, school, medium and roll number may stand apart
    from their label: then the line nearest in height to its right is taken. A parent whose label cannot be read is the first
    name of two words between the rows above and below it. `rows` come from memo_rows.
    """
    c = F.col
    place = ["row_no", "page", "cy", "h", "conf", "parts"]
    labelled = []
    for key, label in vocab.MEMO_LABELS.items():
        after = F.btrim(F.regexp_replace("text", f"(?i)^.*?(?:{label})", ""), F.lit(_PUNCTUATION))
        first = F.coalesce(F.get(F.filter("parts", lambda p: p["text"].rlike(f"(?i){label}")), F.lit(0)), F.get("parts", F.lit(0)))  # noqa: B023
        labelled.append(F.when(c("text").rlike(f"(?i){label}"), F.struct(F.lit(key).alias("field"), _read(key, after, today).alias("value"), first.alias("label"))))
    # a pattern in the JVM's compiled code leaves few rows to the reading below
    some = c("text").rlike("(?i)" + "|".join(f"(?:{label})" for label in vocab.MEMO_LABELS.values()))
    hits = rows.where(some).withColumn("_l", F.explode(F.filter(F.array(*labelled), lambda s: s.isNotNull()))).select("file", *place, "_l.*")
    direct = hits.where("value <> ''").select("file", "field", "row_no", F.lit(0.0).alias("far"), F.lit(0.0).alias("left"), "value", "page", "cy", "h", "conf", "parts")
    lost = hits.where((c("value") == "") & c("field").isin(list(_NEAR))).groupBy("file", "page").agg(F.collect_list(F.struct("field", "row_no", "label")).alias("_lost"))
    reach = reduce(lambda a, kv: F.when(c("field") == kv[0], kv[1]).otherwise(a), _NEAR.items(), F.lit(1.0))
    far = F.abs(c("p.cy") - c("label.cy"))
    # a page is one row for this: its lines are joined once with the few labels that lost their value
    pages = rows.select("file", "page", "parts").join(lost.hint("merge"), ["file", "page"])
    near = pages.select("file", "page", "parts", F.explode("_lost").alias("_q")).select("file", "page", "_q.*", F.explode("parts").alias("p"))
    near = near.where((c("p.x0") > c("label.x1") - 5) & (far < reach * c("label.h")))
    bare = F.btrim("p.text", F.lit(_PUNCTUATION))
    alone = reduce(lambda a, key: F.when(c("field") == key, _read_alone(key, bare, today)).otherwise(a), _NEAR, F.lit(""))
    near = near.select("file", "field", "row_no", far.alias("far"), c("p.x0").cast("double").alias("left"), alone.alias("value"), "page", c("p.cy").alias("cy"), c("p.h").alias("h"), c("p.conf").alias("conf"), F.array("p").alias("parts")).where("value <> ''")
    found = direct.unionByName(near).withColumn("weaker", F.lit(0))

    u = F.upper("text")
    months = "|".join(vocab.MONTHS)
    held = rf"HELD\s*IN\s*((?:{months})(?:\s*/\s*(?:{months}))?)\W*((?:19|20)\d{{2}})"
    child_of = F.regexp_extract(u, r"\b[SD]\s*/\s*O\s+([A-Z][A-Z .]+?)(?:\s+BEARING\b|$)", 1)
    others = F.array(
        F.struct(F.lit("father_name").alias("field"), F.when(t.name_like(child_of), t.tidy_name(child_of)).otherwise("").alias("value")),
        F.struct(F.lit("exam").alias("field"), F.when(u.rlike(held), F.concat_ws(" ", F.regexp_replace(F.regexp_extract(u, held, 1), r"\s+", ""), F.regexp_extract(u, held, 2))).otherwise("").alias("value")),
        F.struct(F.lit("medium").alias("field"), F.regexp_extract(u, r"\b(?:AND|WITH)\s+([A-Z]+)\s+AS\s+(?:THE\s+)?MEDIUM", 1).alias("value")),
        F.struct(F.lit("appearance").alias("field"), F.regexp_extract(u, r"\b(REGULAR|PRIVATE)\b", 1).alias("value")),
        F.struct(F.lit("compartmental").alias("field"), F.regexp_extract(u, "(COMPARTMENTAL)", 1).alias("value")),
    )
    said = u.rlike(r"\b[SD]\s*/\s*O\s|HELD\s*IN|\b(?:AND|WITH)\s|REGULAR|PRIVATE|COMPARTMENTAL")
    loose = rows.where(said).withColumn("_o", F.explode(F.filter(others, lambda s: s["value"] != ""))).select(
        "file", "_o.field", "row_no", F.lit(0.0).alias("far"), F.lit(0.0).alias("left"), "_o.value", "page", "cy", "h", "conf", "parts", F.lit(1).alias("weaker")
    )
    order = F.struct("weaker", "row_no", "far", "left")
    got = found.unionByName(loose).groupBy("file", "field").agg(F.min_by(F.struct("value", "page", "cy", "h", "conf", "parts"), order).alias("b")).select("file", "field", "b.*")
    got = cut_lineage(got)
    for key, above, below in (("father_name", "student_name", "mother_name"), ("mother_name", "father_name", "roll_number")):
        got = cut_lineage(got.unionByName(_unlabelled_parent(got, rows, key, above, below)))
    return got.select("file", "field", "value", _sureness(c("value"), c("parts"), c("conf")).alias("confidence"))


def _unlabelled_parent(got: DataFrame, rows: DataFrame, key: str, above: str, below: str) -> DataFrame:
    """The first row between two known rows that reads as a name, for documents without the field."""
    c = F.col
    p = got.where(c("field") == above).select("file", "page", c("cy").alias("p_cy"), c("h").alias("p_h"))
    n = got.where(c("field") == below).select("file", "page", c("cy").alias("n_cy"), c("h").alias("n_h"))
    open_ = p.join(got.where(c("field") == key).select("file"), "file", "left_anti").join(n, ["file", "page"], "left")
    value = t.tidy_name(F.regexp_replace("text", r"(?i)^.*?\bNAME\b\W*", ""))
    between = (c("cy") > c("p_cy") + 0.5 * c("p_h")) & (c("n_cy").isNull() | (c("cy") < c("n_cy") - 0.5 * c("n_h"))) & (c("cy") - c("p_cy") < 4 * c("p_h"))
    fits = rows.join(open_, ["file", "page"]).where(between).withColumn("value", value).where(t.name_like(c("value"), 2) & (F.upper("value") == c("value")))
    first = fits.groupBy("file").agg(F.min_by(F.struct("value", "page", "cy", "h", "conf", "parts"), "row_no").alias("b"))
    return first.select("file", F.lit(key).alias("field"), "b.*")


def printed_results(rows: DataFrame) -> DataFrame:
    """Results a memo prints under its subjects: (file, cgpa, total, points_total), null where there is none."""
    def number(label: str, pattern: str, name: str, kind: str) -> DataFrame:
        return identity.number_on_row(rows, label, pattern).select("file", F.col("value").cast(kind).alias(name))

    two = r"\b(\d{2,3})\b"
    out = rows.select("file").distinct()
    for part in (
        number(r"\bC?GPA\b\W*(?:\(CGPA\))?", r"(?<![\d.])(\d{1,2}\.\d)(?![\d.])", "cgpa", "double"), number(r"GRAND\s*TOTAL", two, "grand", "int"),
        number(r"^\W*TOTAL\b", two, "plain", "int"), number(r"GRADE\s*POINTS?\s*TOTAL", r"\b(\d{1,2})\b", "points_total", "int"),
    ):
        out = out.join(part, "file", "left")
    return out.select("file", "cgpa", F.coalesce("grand", "plain").alias("total"), "points_total")


def field_flags(fields: DataFrame, sure: float = 0.8) -> DataFrame:
    """Header fields to look at: unsure readings, and roll numbers of an unusual length."""
    c = F.col
    named = c("field").isin(["student_name", "father_name", "mother_name", "roll_number", "date_of_birth", "school"])
    reason = F.when(named & (c("confidence") < sure), "low confidence").when((c("field") == "roll_number") & ~c("value").rlike(r"^\d{7,10}$"), "unusual length")
    return fields.withColumn("reason", reason).where("reason is not null").select("file", "field", "reason")


def read_memos(lines: DataFrame, today: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Header fields, subjects and flags of memos, read from lines that may be tilted."""
    flat = cut_lineage(level(lines, page_tilt(lines)))
    rows = cut_lineage(memo_rows(flat))
    fields = cut_lineage(header_fields(rows, today))
    subjects = cut_lineage(identity.memo_subjects(flat))
    flags = identity.check_memos(subjects, printed_results(rows)).unionByName(field_flags(fields))
    return fields, subjects, flags
