import random

import pytest
from pyspark.sql import functions as F

from folioworks import vocab
from folioworks.functions import dates, similarity
from folioworks.functions import text as t
from folioworks.functions.checkdigits import verhoeff_digit, verhoeff_ok, weighted_check_digit


def values(spark, rows, col):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.select("i", col(F.col("x")).alias("v")).orderBy("i").select("v").collect()]


def test_integers(spark):
    assert values(spark, ["95", "095", "47*", "76 P", "000"], t.to_int) == [95, 95, 47, 76, 0]
    assert values(spark, ["L90", "7.0", "12-04", "B2", "1234567890", "", "8O", None], t.to_int) == [None] * 8


def test_floats_and_names(spark):
    assert values(spark, ["74.8%", "7.94", "abc"], t.to_float) == [74.8, 7.94, None]
    assert values(spark, ["TESTA RAVI KUMAR", "  :TESTA   SITA ", "Testa Ravi"], t.strip_name) == ["TESTA RAVI KUMAR", "TESTA SITA", "Testa Ravi"]


def test_sessions(spark):
    raw = ["MARCH - 2019 (REG)", "inMARCH-2015", "JUNE 2024", "MARHC 1999", "SEPT 2001", "no date"]
    assert values(spark, raw, t.parse_month) == ["MARCH", "MARCH", "JUNE", "MARCH", "SEPTEMBER", ""]
    assert values(spark, raw, t.parse_year) == [2019, 2015, 2024, 1999, 2001, None]


def test_categories(spark):
    got = values(spark, ["COMPARTMENTAL.", "AGRADE", "COPA 7.00 Y)", "PASED", ""], lambda c: t.categorical_note(c, vocab.RESULTS))
    assert [g["value"] for g in got] == ["COMPARTMENTAL", "A GRADE", "COPA 7.00 Y)", "PASSED", ""]
    assert "kept verbatim" in got[2]["note"] and got[3]["note"].startswith("fuzzy-mapped")


def test_number_words(spark):
    assert values(spark, ["*SEVEN**FIVE***TWO*", "THREE SEVEN FOUR", "GEVEN BVE TMO", ""], t.parse_number_words) == [752, 374, None, None]
    assert values(spark, ["ZERO EIGHT", "NIL"], t.number_words_text) == ["08", ""]


def test_dates(spark):
    got = values(spark, ["DOB: 26/06/2000", "08-05-1998", "O1/O2/2003", "31/02/2001", "none"], lambda c: dates.parse_date(c, "2026-01-01").cast("string"))
    assert got == ["2000-06-26", "1998-05-08", "2003-02-01", None, None]
    assert values(spark, ["1.6/09/2031"], lambda c: dates.parse_strict_date(c).cast("string")) == ["2031-09-16"]


def test_masking(spark):
    assert values(spark, ["2345 6789 0123", "12", None], t.mask_number) == ["XXXX XXXX 0123", "", ""]
    assert values(spark, ["Telangana - 500001", "500 001 x 600002", "12"], t.postal_code) == ["500001", "600002", ""]


def test_check_digits(spark):
    assert values(spark, ["L898902C3", "740812", "120415"], weighted_check_digit) == ["6", "2", "9"]
    first = ["23456789012", "56781234567", "99999999999"]
    digits = values(spark, first, verhoeff_digit)
    good = [a + b for a, b in zip(first, digits)]
    bad = [g[:-1] + str((int(g[-1]) + 1) % 10) for g in good]
    assert values(spark, good, verhoeff_ok) == [True] * 3 and values(spark, bad + ["12"], verhoeff_ok) == [False] * 4


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diag = 0
        for j, y in enumerate(b, 1):
            keep = row[j]
            row[j] = diag + 1 if x == y else max(row[j], row[j - 1])
            diag = keep
    return row[-1]


def test_lcs_against_brute_force():
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("ABCD ") for _ in range(rnd.randint(0, n)))
    a, b = [word(70) for _ in range(600)], [word(90) for _ in range(600)]
    assert similarity.lcs_lengths(a, b).tolist() == [_lcs(x, y) for x, y in zip(a, b)]


@pytest.mark.parametrize("cutoff", [85, 88, 92])
def test_best_window_against_brute_force(cutoff):
    rnd = random.Random(cutoff)
    for _ in range(400):
        p = rnd.choice(["BOARD OF ED", "TOTAL MARKS", "NOTE", "CLASS X", "INTERMEDIATE"])
        q = list(p)
        for _ in range(rnd.randint(0, 3)):
            k = rnd.randrange(len(q))
            q[k : k + 1] = rnd.choice([[rnd.choice("ABX")], [], [q[k], rnd.choice("BOX")]]) or (["A"] if len(q) == 1 else [])
        noise = lambda: "".join(rnd.choice("ABO TM") for _ in range(rnd.randint(0, 8)))
        text = noise() + "".join(q) + noise()
        m, best = len(p), 0.0
        spans = [(max(0, s), min(len(text), s + m)) for s in range(-m + 1, len(text))] if len(text) >= m else [(0, len(text))]
        for s, e in spans:
            best = max(best, 200 * _lcs(p, text[s:e]) / (m + e - s))
        got = similarity.best_window(p, text, cutoff)
        assert (got is not None) == (best >= cutoff)
        if got:
            assert abs(got[0] - best) < 1e-9


def test_token_set(spark):
    df = spark.createDataFrame([("RAVI KUMAR", "KUMAR RAVI T"), ("RAVI KUMAR", "SITA DEVI"), ("", "A")], "a string, b string")
    got = [r[0] for r in df.select(similarity.token_set_ratio(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 100.0 and got[1] < 60 and got[2] == 0.0
