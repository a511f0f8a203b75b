"""Rows and tilt of memo pages against plain loops over random lines."""

import random

from pyspark.sql import functions as F

from folioworks.operators import layout, memos

LINES = "file string, page int, line_id int, text string, x0 double, y0 double, x1 double, y1 double, conf double"


def plain_rows(lines):
    """row per (page, line_id): grown one line at a time, against the last four rows of the page."""
    out = {}
    for page in {l[1] for l in lines}:
        rows = []
        for l in sorted((l for l in lines if l[1] == page), key=lambda l: ((l[5] + l[7]) / 2, l[2])):
            y0, y1 = l[5], l[7]
            h = max(1.0, y1 - y0)
            for n in range(max(0, len(rows) - 4), len(rows)):
                a0, a1 = rows[n]
                ah = max(1.0, a1 - a0)
                if min(a1, y1) - max(a0, y0) >= 0.55 * min(ah, h) and abs((a0 + a1) / 2 - (y0 + y1) / 2) < 0.6 * max(ah, h):
                    rows[n] = (y0, y1) if h > ah else (a0, a1)
                    out[page, l[2]] = n
                    break
            else:
                out[page, l[2]] = len(rows)
                rows.append((y0, y1))
    return out


def test_card_rows_equal_a_fold_over_the_page(spark):
    rng = random.Random(5)
    lines = []
    for page in range(12):
        for i in range(60):
            y = rng.randint(0, 700)
            lines.append(("f", page, i, "x", float(rng.randint(0, 900)), float(y), 950.0, float(y + rng.choice([0, 8, 20, 22, 25, 60]))))
    df = spark.createDataFrame([(*l, 0.9) for l in lines], LINES)
    got = {(r.page, r.line_id): r.row_id for r in layout.card_rows(df).collect()}
    assert got == plain_rows(lines)
    assert len(set(got.values())) > 10


def test_a_page_is_dealt_once_for_its_rows(spark):
    df = spark.createDataFrame([("f", 1, 1, "x", 100.0, 300.0, 250.0, 325.0, 0.9)], LINES)
    plan = layout.card_rows(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_card_rows_of_nothing(spark):
    assert layout.card_rows(spark.createDataFrame([], LINES)).count() == 0


def plain_tilt(lines):
    anchors = [l for l in lines if l[3] in ("MATHEMATICS", "SCIENCE", "SOCIAL STUDIES")]
    cells = [l for l in lines if l[3] in ("A1", "09", "95")]
    if len(anchors) < 3 or len(cells) < 6:
        return 0.0

    def votes(k):
        near = lambda c, a: abs((c[5] + c[7]) / 2 - k * ((c[4] + c[6]) / 2 - a[4]) - (a[5] + a[7]) / 2) < 0.3 * max(1.0, a[7] - a[5])
        return sum(any(c[1] == a[1] and c[4] > a[6] and near(c, a) for a in anchors) for c in cells)

    best = max((votes(k / 1000), -abs(k), k) for k in range(-60, 61, 2))
    return best[2] / 1000 if best[0] > votes(0.0) else 0.0


def test_tilt_equals_a_count_of_all_votes(spark):
    rng = random.Random(8)
    lines, by_file = [], {}
    for f in range(40):
        tilt, mine = rng.choice([-0.05, -0.03, 0.0, 0.02, 0.045]), []
        for i in range(rng.choice([2, 5, 7])):
            for x0, x1, text in [(100, 250, rng.choice(["MATHEMATICS", "SCIENCE", "SOCIAL STUDIES"])), (580, 610, "A1"), (700, 730, rng.choice(["09", "95"])), (820, 900, "NINE")]:
                y = 300 + 45 * i + tilt * (x0 + x1) / 2 + rng.randint(-4, 4)
                mine.append((f"f{f}", f % 2, len(mine), text, float(x0), y, float(x1), y + 25))
        by_file[f"f{f}"] = plain_tilt(mine)
        lines += mine
    df = spark.createDataFrame([(*l, 0.9) for l in lines], LINES)
    got = {r.file: r.tilt for r in memos.page_tilt(df).collect()}
    assert got == by_file
    assert len(set(got.values())) > 4 and 0.0 in got.values()


def test_areas_and_cells_meet_in_their_page_and_not_by_a_join(spark):
    df = spark.createDataFrame([("f", 1, 1, "MATHEMATICS", 100.0, 300.0, 250.0, 325.0, 0.9)], LINES)
    plan = memos.page_tilt(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1  # that of the tilts with the files


def test_rows_without_a_label_say_nothing_and_a_date_below_its_label_is_read(spark):
    df = spark.createDataFrame([("f", 1, 1, "MATHEMATICS", 100.0, 300.0, 250.0, 325.0, 0.9)], LINES)
    rows = memos.memo_rows(df).localCheckpoint()
    assert memos.header_fields(rows, "2026-01-01").count() == 0
    some = [("f", 1, 1, "DATE OF BIRTH", 100.0, 300.0, 230.0, 325.0, 0.9), ("f", 1, 2, ": 03/02/1990", 300.0, 335.0, 420.0, 360.0, 0.8)]
    got = memos.header_fields(memos.memo_rows(spark.createDataFrame(some, LINES)), "2026-01-01").collect()
    assert [(r.field, r.value, r.confidence) for r in got] == [("date_of_birth", "1990-02-03", 0.8)]


def test_levelled_pages_read_like_level_ones(spark):
    def page(tilt):
        out = []
        for i, (area, grade, point) in enumerate([("MATHEMATICS", "A1", "10"), ("SCIENCE", "B1", "08"), ("SOCIAL STUDIES", "A2", "09")]):
            for x0, text in [(100, area), (580, grade), (900, point)]:
                y = 300 + 40 * i + round(tilt * x0)
                out.append((f"t{tilt}", 1, len(out), text, float(x0), float(y), x0 + 30.0, y + 25.0, 0.9))
        return out

    df = spark.createDataFrame(page(0.0) + page(0.04) + page(-0.04), LINES)
    texts = {}
    for r in memos.memo_rows(memos.level(df, memos.page_tilt(df))).orderBy("row_no").collect():
        texts.setdefault(r.file, []).append(r.text)
    assert texts["t0.0"] == ["MATHEMATICS A1 10", "SCIENCE B1 08", "SOCIAL STUDIES A2 09"]
    assert texts["t0.0"] == texts["t0.04"] == texts["t-0.04"]
    crooked = {r.text for r in memos.memo_rows(df).where(F.col("file") == "t0.04").collect()}
    assert "MATHEMATICS A1 10" not in crooked


def test_tax_card_by_label_and_by_position(spark):
    from folioworks.operators import identity

    def card(file, rows):
        return [(file, 1, i, text, float(x), float(y), x + 200.0, y + 30.0, 0.9) for i, (text, x, y) in enumerate(rows)]

    lines = card("new", [("INCOME TAX DEPARTMENT", 100, 40), ("GOVT. OF INDIA", 600, 40), ("/ Name", 100, 200), ("RAVI KUMAR TEST", 100, 240), ("/ Father's Name", 100, 300), ("SURESH TEST", 100, 340), ("/ Date of Birth", 100, 400), ("01/02/1990", 100, 440)])
    lines += card("old", [("INCOME TAX DEPARTMENT", 100, 40), ("RAVI KUMAR TEST", 100, 100), ("SURESH TEST", 100, 150), ("0l/O2/1990", 100, 200), ("Permanent Account Number", 100, 250)])
    # a value out of its label's column, or too far below it, is not its value
    lines += card("far", [("/ Name", 100, 200), ("mixed Case Name", 500, 240), ("/ Date of Birth", 100, 300), ("01/02/1990", 100, 700)])
    lines += card("bare", [("12345", 100, 100)])
    df = spark.createDataFrame(lines, LINES)
    got = {(r.file, r.field): (r.value, r.by_position) for r in identity.tax_card_fields(df, "2026-01-01").collect()}
    for file, by_position in (("new", False), ("old", True)):
        assert got[file, "name"] == ("RAVI KUMAR TEST", by_position)
        assert got[file, "father_name"] == ("SURESH TEST", by_position)
        assert got[file, "date_of_birth"] == ("1990-02-01", False)
    assert {k[1]: v[0] for k, v in got.items() if k[0] == "far"} == {"date_of_birth": "1990-02-01"}
    assert not [k for k in got if k[0] == "bare"]
