"""School memos printed from the customers, on level and tilted pages, read back and checked.

Two memos in three carry grades, the others marks; each of eight kinds (`m`) of a layout has one thing wrong or missing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks import vocab
from folioworks.functions.text import spell_digits
from folioworks.operators import identity, memos, review
from folioworks.plans.identity import _HOLDER, TODAY, _lines, holders
from folioworks.plans.registry import query
from folioworks.session import cut_lineage

#: Area as printed, language behind it, grade, points, marks; the last one is missing on some memos.
_SUBJECTS = [
    ("L1", "FIRST LANGUAGE : (", "TELUGU", "A1", 10, 95), ("L3", "THIRD LANGUAGE", "ENGLISH", "A2", 9, 88), ("MA", "MATHEMATICS", None, "A1", 10, 99),
    ("SC", "SCIENCE", None, "B1", 8, 91), ("SS", "SOCIAL STUDIES", None, "A1", 10, 93), ("L2", "SECOND LANGUAGE : (", "HINDI", "A2", 9, 90),
]
_TILTS = [0.0, 0.02, -0.02, 0.05, -0.05]
_GRADED, _KIND = "k % 3 <> 2", "k % 8"


def printed_memos(spark: SparkSession, root: str) -> DataFrame:
    """Lines of every memo. Kinds with grades: 1 a wrong point, 2 a point unread, 3 words that differ, 4 a row short, 5 a wrong
    average, 6 none, 7 a wrong sum of points. With marks: 1 a wrong total, 2 marks unread, 3 words that differ, 4 a row short,
    5 no total. One father's label in four cannot be read, one date in four stands below its row, one roll number in four has O for 0,
    one name in nine is unsure."""
    h = holders(spark, root).withColumns({"g": F.expr(_GRADED), "m": F.expr(_KIND)})
    g, m, k = F.col("g"), F.col("m"), F.col("k")
    text = lambda s: F.lit(s)
    none = F.lit("~")
    roll = F.concat(F.lit("20"), F.lpad(k.cast("string"), 8, "0"))
    shown_roll = F.when(k % 4 == 3, F.concat(F.translate(F.substring(roll, 1, 3), "0", "O"), F.substring(roll, 4, 7))).otherwise(roll)
    born = F.concat(F.lit(":"), F.date_format("born", "dd/MM/yyyy"))
    items: list[tuple[Column, int, int]] = [
        (text("Board of Secondary Education"), 300, 20), (text("TELANGANA STATE, INDIA"), 420, 80), (text("SECONDARY SCHOOL CERTIFICATE"), 350, 140), (text("REGULAR PC/22/00000"), 400, 200),
        (text("CERTIFIED THAT"), 100, 260), (F.concat(F.lit(": RAVI "), "surname"), 300, 260),
        (F.when(k % 4 == 1, none).otherwise("FATHER'S NAME"), 100, 320), (F.concat(F.lit(": SURESH "), "surname"), 300, 320),
        (text("MOTHER'S NAME"), 100, 380), (F.concat(F.lit(": LATHA "), "surname"), 300, 380), (text("ROLL NO."), 100, 440), (F.concat(F.lit(":"), shown_roll), 300, 440),
        (text("DATE OF BIRTH"), 100, 500), (F.when(k % 4 == 2, none).otherwise(born), 300, 500), (F.when(k % 4 == 2, born).otherwise(none), 300, 535),
        (text("SCHOOL"), 100, 580), (F.concat(F.lit(": TEST HIGH SCHOOL, "), "given"), 300, 580), (text("MEDIUM"), 100, 640), (text(":ENGLISH"), 300, 640),
        (text("Has Declared Passed SSC EXAMINATION held in MARCH-2021"), 100, 700),
    ]
    points, marks = F.lit(0), F.lit(0)
    for i, (code, area, language, grade, point, mark) in enumerate(_SUBJECTS):
        y = 800 + 60 * i
        unread = (m == 2) & F.lit(code == "SC")
        gone = (m == 4) & F.lit(code == "L2")
        p = F.when((m == 1) & F.lit(code == "MA"), 7).otherwise(point)
        two = F.lpad(p.cast("string"), 2, "0")
        figures = F.when(g, two).otherwise(str(mark))
        # the words of social studies say 9 where the figures say 10, or 95 for 93
        words = F.when((m == 3) & F.lit(code == "SS"), F.when(g, "09").otherwise("95")).otherwise(figures)
        line = [(text(area), 100), (text(language) if language else none, 350), (F.when(g, grade).otherwise("~"), 580), (F.when(unread, none).otherwise(figures), 700), (F.when(unread, none).otherwise(spell_digits(words)), 820)]
        items += [(F.when(gone, none).otherwise(c), x, y) for c, x in line]
        points = points + F.when(gone | unread, 0).otherwise(p)
        marks = marks + F.when(gone | unread, 0).otherwise(mark)
    shown = F.when(m == 4, F.lit(9.3)).otherwise(F.round(points / 6 + 1e-9, 1)) - F.when(m == 5, 0.5).otherwise(0.0)
    items += [
        (F.when(g & (m != 6), "Cumulative Grade Point Average (CGPA) :").otherwise("~"), 100, 1200), (F.when(g & (m != 6), F.format_number(shown, 1)).otherwise("~"), 880, 1200),
        (F.when(g, "GRADE POINTS TOTAL").otherwise("~"), 100, 1260), (F.when(g, (points + F.when(m == 7, 1).otherwise(0)).cast("string")).otherwise("~"), 700, 1260),
        (F.when(~g & (m != 5), "GRAND TOTAL").otherwise("~"), 100, 1260), (F.when(~g & (m != 5), (marks + F.when(m == 1, 1).otherwise(0)).cast("string")).otherwise("~"), 600, 1260),
    ]
    n = F.regexp_extract("file", r"(\d+)", 1).cast("long")
    tilt = reduce(lambda a, i: F.when(n % 5 == i, _TILTS[i]).otherwise(a), range(1, 5), F.lit(0.0))
    lines = _lines(h, items).where("text <> '~'").withColumn("_d", F.round(tilt * ((F.col("x0") + F.col("x1")) / 2)).cast("int"))
    moved = lines.withColumns({"y0": F.col("y0") + F.col("_d"), "y1": F.col("y1") + F.col("_d")}).drop("_d")
    return cut_lineage(moved.withColumn("conf", F.when(F.col("text").startswith(": RAVI") & (n % 9 == 4), 0.5).otherwise(F.col("conf"))))


def _levelled(spark: SparkSession, root: str) -> DataFrame:
    lines = printed_memos(spark, root)
    return cut_lineage(memos.level(lines, memos.page_tilt(lines)))


_AREA_ROWS = ", ".join(f"({i}, '{code}', {len(area)}, '{grade}', {point}, {mark})" for i, (code, area, _, grade, point, mark) in enumerate(_SUBJECTS))
_PRINTED = f"""{_HOLDER}, d AS (SELECT *, {_GRADED} AS g, {_KIND} AS m, CASE k % 5 WHEN 1 THEN 2e-2 WHEN 2 THEN -2e-2 WHEN 3 THEN 5e-2 WHEN 4 THEN -5e-2 ELSE 0e0 END AS printed_tilt FROM h),
    a(i, area, n, grade, point, mark) AS (VALUES {_AREA_ROWS}),
    s AS (SELECT d.*, a.*, CASE WHEN m = 1 AND area = 'MA' THEN 7 ELSE point END AS p, m = 2 AND area = 'SC' AS unread FROM d, a WHERE NOT (m = 4 AND area = 'L2')),
    r AS (SELECT file, sum(p) FILTER (NOT unread) AS points, sum(mark) FILTER (NOT unread) AS marks FROM s GROUP BY file)"""

# every cell against every area and every slope
_TILT_SQL = f"""WITH {_PRINTED},
    b(x0, y0, x1, role) AS (VALUES (100, 0, 0, 'area'), (580, 0, 600, 'grade'), (700, 0, 720, 'figures'), (700, 1260, 720, 'points'), (600, 1260, 630, 'total')),
    l AS (SELECT file, role, b.x0, CASE WHEN role = 'area' THEN 100 + 10 * n ELSE b.x1 END AS x1, 800 + 60 * i AS top, printed_tilt FROM s, b WHERE role = 'area' OR (role = 'grade' AND g) OR (role = 'figures' AND NOT unread)
      UNION ALL SELECT file, role, b.x0, b.x1, b.y0, printed_tilt FROM d, b WHERE (role = 'points' AND g) OR (role = 'total' AND NOT g AND m <> 5)),
    c AS (SELECT *, row_number() OVER () AS id, (x0 + x1) / 2 AS cx, top + 15 + round(printed_tilt * ((x0 + x1) / 2)) AS cy FROM l),
    v AS (SELECT DISTINCT e.file, e.id, t.step FROM c e JOIN c q ON e.file = q.file AND e.role <> 'area' AND q.role = 'area' AND e.x0 > q.x1, (SELECT unnest(range(-30, 31)) AS step) t
      WHERE abs(e.cy - (t.step * 2 / 1000) * (e.cx - q.x0) - q.cy) < 3e-1 * 30),
    n AS (SELECT file, step, count(*) AS votes FROM v GROUP BY 1, 2),
    o AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY votes DESC, abs(step), step DESC) AS place, max(CASE WHEN step = 0 THEN votes ELSE 0 END) OVER (PARTITION BY file) AS level FROM n)
    SELECT d.file, coalesce(o.step * 2 / 1000, 0e0) AS tilt FROM d LEFT JOIN o ON d.file = o.file AND place = 1 AND votes > level"""


@query("memo_tilt", _TILT_SQL)
def memo_tilt(spark: SparkSession, root: str) -> DataFrame:
    """Tilt of every memo by vote, against all cells, areas and slopes."""
    return memos.page_tilt(printed_memos(spark, root))


@query(
    "memo_fields",
    f"""WITH {_HOLDER}, v AS (SELECT file, k, unnest([{{'f': 'student_name', 'v': 'RAVI ' || surname}}, {{'f': 'father_name', 'v': 'SURESH ' || surname}}, {{'f': 'mother_name', 'v': 'LATHA ' || surname}}, {{'f': 'roll_number', 'v': '20' || lpad(CAST(k AS VARCHAR), 8, '0')}},
      {{'f': 'date_of_birth', 'v': strftime(born, '%Y-%m-%d')}}, {{'f': 'school', 'v': 'TEST HIGH SCHOOL, ' || given}}, {{'f': 'medium', 'v': 'ENGLISH'}}, {{'f': 'exam', 'v': 'MARCH 2021'}}, {{'f': 'appearance', 'v': 'REGULAR'}}]) AS x FROM h)
    SELECT file, x.f AS field, x.v AS value, CASE WHEN x.f = 'student_name' AND k % 9 = 4 THEN 5e-1 ELSE 95e-2 END AS confidence FROM v""",
)
def memo_fields(spark: SparkSession, root: str) -> DataFrame:
    """Header fields of memos with missing labels, values off their row, misread digits and tilted pages."""
    return memos.header_fields(cut_lineage(memos.memo_rows(_levelled(spark, root))), TODAY)


@query(
    "memo_subjects",
    f"""WITH {_PRINTED} SELECT file, area, CASE area WHEN 'L1' THEN 'TELUGU' WHEN 'L2' THEN 'HINDI' WHEN 'L3' THEN 'ENGLISH' WHEN 'MA' THEN 'MATHEMATICS' WHEN 'SC' THEN 'SCIENCE' ELSE 'SOCIAL STUDIES' END AS subject,
    CASE WHEN g THEN grade END AS grade, CASE WHEN g AND NOT unread THEN p END AS grade_point, CASE WHEN NOT g AND NOT unread THEN mark END AS marks,
    CASE WHEN unread THEN '' WHEN m = 3 AND area = 'SS' THEN CASE WHEN g THEN '09' ELSE '95' END WHEN g THEN lpad(CAST(p AS VARCHAR), 2, '0') ELSE CAST(mark AS VARCHAR) END AS words FROM s""",
)
def memo_subjects(spark: SparkSession, root: str) -> DataFrame:
    """Subject rows of tilted memos: grade, points or marks, and the number in words."""
    return identity.memo_subjects(_levelled(spark, root)).select("file", "area", "subject", "grade", "grade_point", "marks", "words")


_MEMO_FLAGS = f"""{_PRINTED}, f AS (
    SELECT file, 'subjects.MA' AS field, 'grade A1 should carry 10 points' AS reason FROM d WHERE g AND m = 1
    UNION ALL SELECT file, 'subjects.SC', CASE WHEN g THEN 'grade or grade point not read' ELSE 'marks not read' END FROM d WHERE m = 2
    UNION ALL SELECT file, 'subjects.SS', 'figures and words differ' FROM d WHERE m = 3
    UNION ALL SELECT file, 'subjects', 'fewer than six subject rows were read' FROM d WHERE m = 4
    UNION ALL SELECT file, 'cgpa', 'average of the grade points differs' FROM d WHERE g AND m = 5
    UNION ALL SELECT file, 'cgpa', 'CGPA not found' FROM d WHERE g AND m = 6
    UNION ALL SELECT file, 'cgpa', 'grade points do not add up to their total' FROM d WHERE g AND m = 7
    UNION ALL SELECT file, 'total_marks', 'subjects do not add up to the total' FROM d WHERE NOT g AND m = 1
    UNION ALL SELECT file, 'total_marks', 'grand total not found' FROM d WHERE NOT g AND m = 5
    UNION ALL SELECT file, 'student_name', 'low confidence' FROM d WHERE k % 9 = 4)"""


@query("memo_flags", f"WITH {_MEMO_FLAGS} SELECT file, field, reason FROM f")
def memo_flags(spark: SparkSession, root: str) -> DataFrame:
    """Every rule of the school memo at work, on level and tilted pages."""
    return memos.read_memos(printed_memos(spark, root), TODAY)[2]


@query(
    "memo_results",
    f"""WITH {_PRINTED} SELECT d.file, CASE WHEN g AND m <> 6 THEN CASE WHEN m = 4 THEN 93e-1 ELSE round(points / 6 + 1e-9, 1) END - CASE WHEN m = 5 THEN 5e-1 ELSE 0e0 END END AS cgpa,
    CASE WHEN NOT g AND m <> 5 THEN marks + CASE WHEN m = 1 THEN 1 ELSE 0 END END AS total, CASE WHEN g THEN points + CASE WHEN m = 7 THEN 1 ELSE 0 END END AS points_total FROM d JOIN r ON d.file = r.file""",
)
def memo_results(spark: SparkSession, root: str) -> DataFrame:
    """Average, total and sum of points from the first row that shows their label."""
    return memos.printed_results(memos.memo_rows(_levelled(spark, root)))


@query(
    "memo_routing",
    f"""WITH {_MEMO_FLAGS} SELECT d.file, CASE WHEN bool_or(field IN ({", ".join(f"'{x}'" for x in vocab.MEMO_REQUIRED)})) THEN 'manual_required' WHEN count(field) > 0 THEN 'review_recommended' ELSE 'auto' END AS status
    FROM d LEFT JOIN f ON d.file = f.file GROUP BY d.file""",
)
def memo_routing(spark: SparkSession, root: str) -> DataFrame:
    """Route of every memo by its flags."""
    fields, _, flags = memos.read_memos(printed_memos(spark, root), TODAY)
    return review.route_identity(flags, fields.withColumn("verified", F.lit(False)), vocab.MEMO_REQUIRED)
