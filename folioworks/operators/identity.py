"""Identity documents: code lines with check digits, national numbers, tax numbers, labelled values.

Lines have file, page, line_id, text, x0, y0, x1, y1, conf. Numbers leave these operators masked where a full
number identifies a person on its own (the national number).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioworks import vocab
from folioworks.functions import dates
from folioworks.functions import text as t
from folioworks.functions.checkdigits import verhoeff_ok, weighted_check_digit
from folioworks.functions.similarity import indel_ratio
from folioworks.operators.assemble import vote
from folioworks.session import cut_lineage

_WIDTH = 44


def _padded(c: Column) -> Column:
    return F.rpad(c, _WIDTH, "<")


def _at(c: Column, start: int, n: int = 1) -> Column:
    return F.substring(c, start + 1, n)


def _passes(body: Column, digit: Column) -> Column:
    return weighted_check_digit(body) == t.repair_digits(digit)


# ---- code lines ------------------------------------------------------------------------------
def code_line_pairs(lines: DataFrame) -> DataFrame:
    """Best first and second code line of each document by score, in whatever order they were read."""
    c = lines.where(F.length(F.replace("text", F.lit(" "), F.lit(""))) >= 30).select("file", t.code_line(F.col("text")).alias("l"))
    fillers = F.length("l") - F.length(F.replace("l", F.lit("<"), F.lit("")))
    first = F.when(
        F.col("l").startswith("P") & F.col("l").contains("<<"),
        fillers + F.when(F.col("l").startswith("P<"), 10).otherwise(0) + F.when(t.repair_letters(F.substring("l", 3, 3)).rlike("^[A-Z]{3}$"), 5).otherwise(0),
    )
    p = _padded(F.col("l"))
    number = _passes(_at(p, 0, 9), _at(p, 9)) | _passes(F.concat(_at(p, 0, 1), t.repair_digits(_at(p, 1, 8))), _at(p, 9))
    birth, expiry = _passes(t.repair_digits(_at(p, 13, 6)), _at(p, 19)), _passes(t.repair_digits(_at(p, 21, 6)), _at(p, 27))
    fill44 = F.length(p) - F.length(F.replace(p, F.lit("<"), F.lit("")))
    second = F.when(
        ~F.col("l").startswith("P<") & t.repair_digits(p).rlike(r"\d{6}"),
        (number.cast("int") + birth.cast("int") + expiry.cast("int")) * 10 + fill44,
    )
    scored = c.withColumn("s1", first).withColumn("s2", second)
    best = lambda s: F.max_by("l", F.when(F.col(s).isNotNull(), F.struct(s, "l")))
    return scored.groupBy("file").agg(best("s1").alias("l1"), best("s2").alias("l2")).where("l1 is not null and l2 is not null").select(
        "file", F.substring(_padded(F.col("l1")), 1, _WIDTH).alias("line1"), F.substring(_padded(F.col("l2")), 1, _WIDTH).alias("line2")
    )


def parse_code_lines(pairs: DataFrame, today: str) -> DataFrame:
    """Fields of the two code lines with their checks. A repair is kept only when the check digit then passes."""
    l1, l2 = F.col("line1"), F.col("line2")
    drop = lambda c: F.replace(c, F.lit("<"), F.lit(""))
    names = _at(l1, 5, 39)
    cut = F.instr(names, "<<")
    surname = F.when(cut > 0, F.expr("substring(substring(line1, 6, 39), 1, instr(substring(line1, 6, 39), '<<') - 1)")).otherwise(names)
    given = F.when(cut > 0, F.expr("substring(substring(line1, 6, 39), instr(substring(line1, 6, 39), '<<') + 2)")).otherwise("")
    raw = _at(l2, 0, 9)
    fix = lambda k: F.concat(t.repair_letters(_at(l2, 0, k)), t.repair_digits(_at(l2, k, 9 - k)))
    x = pairs.select(
        "file", "line1", "line2", drop(_at(l1, 0, 2)).alias("document_code"), drop(t.repair_letters(_at(l1, 2, 3))).alias("issuing_country"),
        F.trim(F.replace(t.repair_letters(surname), F.lit("<"), F.lit(" "))).alias("surname"),
        F.trim(t.repair_letters(F.regexp_replace(given, "<+", " "))).alias("given_names"),
        raw.alias("_raw"), fix(1).alias("_f1"), fix(2).alias("_f2"), _at(l2, 13, 6).alias("_b"), _at(l2, 21, 6).alias("_e"),
    )
    number_digit = _at(l2, 9)
    x = x.withColumn("_nk", F.when(_passes(F.col("_raw"), number_digit), 0).when(_passes(F.col("_f1"), number_digit), 1).when(_passes(F.col("_f2"), number_digit), 2).otherwise(3))
    x = x.withColumn("_n", F.when(F.col("_nk") == 1, F.col("_f1")).when(F.col("_nk") == 2, F.col("_f2")).otherwise(F.col("_raw")))
    for col, digit in (("_b", _at(l2, 19)), ("_e", _at(l2, 27))):
        fixed = t.repair_digits(F.col(col))
        x = x.withColumn(f"{col}k", F.when(_passes(F.col(col), digit), 0).when(_passes(fixed, digit), 1).otherwise(2))
        x = x.withColumn(f"{col}v", F.when(F.col(f"{col}k") == 1, fixed).otherwise(F.col(col)))
    sex = F.translate(_at(l2, 20), "0", "O")
    repaired = F.concat(F.rpad("_n", 9, "<"), t.repair_digits(number_digit), F.col("_bv"), t.repair_digits(_at(l2, 19)), F.col("_ev"), t.repair_digits(_at(l2, 27)), _at(l2, 28, 15))
    as_read = F.concat(_at(l2, 0, 10), _at(l2, 13, 7), _at(l2, 21, 22))
    checks = {
        "passport_number": F.col("_nk") < 3, "date_of_birth": F.col("_bk") < 2, "date_of_expiry": F.col("_ek") < 2,
        "composite": _passes(repaired, _at(l2, 43)) | _passes(as_read, _at(l2, 43)),
    }
    x = x.withColumn("checks", F.create_map(*[v for k, c in checks.items() for v in (F.lit(k), c)]))
    repairs = F.array(F.when(F.col("_nk").isin(1, 2), F.lit("passport_number")), F.when(F.col("_bk") == 1, F.lit("date_of_birth")), F.when(F.col("_ek") == 1, F.lit("date_of_expiry")))
    return x.select(
        "file", "document_code", "issuing_country", "surname", "given_names", drop(F.col("_n")).alias("passport_number"),
        drop(t.repair_letters(_at(l2, 10, 3))).alias("nationality"), dates.code_line_date(F.col("_bv"), False, today).cast("string").alias("date_of_birth"),
        F.when(sex.isin("M", "F"), sex).when(sex.isin("<", "X"), "X").otherwise(sex).alias("sex"),
        dates.code_line_date(F.col("_ev"), True, today).cast("string").alias("date_of_expiry"), drop(_at(l2, 28, 14)).alias("personal_number"),
        (_passes(_at(l2, 28, 14), _at(l2, 42)) | (_at(l2, 42) == "<")).alias("checks_optional"), "checks",
        F.filter(repairs, lambda r: r.isNotNull()).alias("repairs"), (~F.exists(F.map_values("checks"), lambda v: ~v)).alias("valid"),
    )


def check_digit_summary(parsed: DataFrame, by: list[str]) -> DataFrame:
    """Pass, repair and failure counts per source."""
    return parsed.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if("valid").alias("valid"), F.count_if(F.size("repairs") > 0).alias("repaired"),
        *[F.count_if(~F.col("checks")[k]).alias(f"failed_{k}") for k in ("passport_number", "date_of_birth", "date_of_expiry", "composite")],
    )


# ---- national number -------------------------------------------------------------------------
def national_numbers(lines: DataFrame) -> DataFrame:
    """The voted number of each document, masked, with its check: a passing (or masked) reading beats a failing one,
    then the most frequent, then the surest."""
    u = F.upper("text")
    digits = F.regexp_replace(u, "[^0-9X]", "")
    ok = ~u.rlike(r"VID|ENROL|MOBILE|/|PHONE|TEL") & (F.length(F.regexp_replace(u, "[^0-9]", "")) <= 12) & (F.length(digits) >= 12)
    spaced = F.trim(F.regexp_replace(F.when(u.rlike(r"\d{4}"), t.repair_digits(u, card=True)).otherwise(u), "[^0-9X ]", ""))
    pat = r"(?<![0-9X])([0-9X]{4}) ?([0-9X]{4}) ?([0-9]{4})(?![0-9])"
    n = F.concat(*[F.regexp_extract(spaced, pat, k) for k in (1, 2, 3)])
    c = lines.where(ok).select("file", n.alias("number"), "conf").where("number <> '' and not number rlike '^[01]'")
    good = verhoeff_ok(F.col("number")) | F.col("number").startswith("X")
    best = vote(c, ["file"], "number", [good, F.col("votes"), F.col("best_conf")])
    masked = F.col("number").startswith("X")
    return best.select(
        "file", t.mask_number(F.col("number")).alias("masked_number"), "votes", F.col("best_conf").alias("confidence"),
        masked.alias("masked_on_document"), (~masked & verhoeff_ok(F.col("number"))).alias("check_digit_ok"),
    )


def care_of(lines: DataFrame) -> DataFrame:
    """'S/O: <name>,' lines: relation and name of the first that reads as a name."""
    pat = r"(?i)\b([SDWC])\s*[/\\]\s*[O0]\b\s*[:.,]?\s*([^,]*)"
    name = t.tidy_name(F.regexp_extract("text", pat, 2))
    hits = lines.withColumn("care_of", name).withColumn("relation", F.concat(F.upper(F.regexp_extract("text", pat, 1)), F.lit("/O"))).where(F.col("text").rlike(pat) & t.name_like(F.col("care_of")))
    first = F.min_by(F.struct("relation", "care_of"), F.struct("page", "y0", "x0", "line_id"))
    return hits.groupBy("file").agg(first.alias("b")).select("file", "b.relation", "b.care_of")


def card_holder(lines: DataFrame, today: str) -> DataFrame:
    """Birth date, gender and name of a national card: the name stands just above the birth line."""
    h = F.greatest(F.lit(1), F.col("y1") - F.col("y0")).cast("double")
    l = lines.withColumn("h", h).withColumn("cy", (F.col("y0") + F.col("y1")) / 2).withColumn("u", F.upper("text"))
    place = F.struct("page", "y0", "x0", "line_id")
    dob = l.where(F.col("u").rlike("DOB|BIRTH|D\\.O\\.B")).withColumn("d", dates.parse_date(F.col("text"), today).cast("string"))
    dob = dob.withColumn("year", F.regexp_extract("u", r"(?:YOB|YEAR OF BIRTH)\D*((?:19|20)\d{2})", 1)).where("d is not null or year <> ''")
    b = dob.groupBy("file").agg(F.min_by(F.struct(F.coalesce("d", "year").alias("date_of_birth"), F.when(F.col("d").isNotNull(), "date").otherwise("year").alias("kind"), *[F.col(k).alias(f"b_{k}") for k in ("page", "x0", "y0", "y1", "cy", "h")]), place).alias("b")).select("file", "b.*")
    word = F.regexp_extract("u", r"\b(FEMALE|MALE|TRANSGENDER)\b", 1)
    g = l.withColumn("gender", word).where((F.col("gender") != "") & (F.length(F.regexp_replace("u", "[^A-Z]", "")) <= 14)).join(b, "file", "left")
    far = F.struct(F.coalesce(F.col("page") != F.col("b_page"), F.lit(False)), F.coalesce(F.abs(F.col("y0") - F.col("b_y1")), F.lit(0)), F.col("page"), F.col("y0"), F.col("x0"))
    g = g.groupBy("file").agg(F.min_by("gender", far).alias("gender"))
    above = l.join(b, "file").where(
        (F.col("page") == F.col("b_page")) & (F.col("cy") < F.col("b_cy") - 0.4 * F.col("b_h")) & (F.col("b_y0") - F.col("y1") <= 4 * F.col("b_h"))
        & (F.abs(F.col("x0") - F.col("b_x0")) <= 4 * F.col("b_h")) & t.name_like(F.col("text"))
    )
    n = above.groupBy("file").agg(F.max_by(F.struct(t.tidy_name(F.col("text")).alias("name"), F.col("conf").alias("name_conf")), F.struct("y0", "x0")).alias("n")).select("file", "n.*")
    return b.select("file", "date_of_birth", "kind").join(g, "file", "full_outer").join(n, "file", "full_outer")


def address_blocks(lines: DataFrame) -> DataFrame:
    """The block under an 'Address:' line in its column, down to the line with the postal code."""
    h = F.greatest(F.lit(1), F.col("y1") - F.col("y0")).cast("double")
    l = lines.withColumn("h", h)
    place = F.struct("page", "y0", "x0", "line_id")
    a = l.where(F.col("text").rlike(r"(?i)^\W*address\W*$|^address\s*:")).groupBy("file").agg(F.min_by(F.struct("page", "x0", "y0", "y1", "h", F.regexp_replace("text", r"(?i)^\W*address\W*", "").alias("rest")), place).alias("a"))
    b = l.join(a, "file").where((F.col("page") == F.col("a.page")) & (F.col("y0") > F.col("a.y0") + 0.4 * F.col("a.h")) & (F.abs(F.col("x0") - F.col("a.x0")) <= 3 * F.col("a.h")))
    w = Window.partitionBy("file").orderBy("y0", "line_id")
    gap = F.col("y0") - F.coalesce(F.lag("y1").over(w), F.col("a.y1"))
    limit = 1.8 * F.coalesce(F.lag("h").over(w), F.col("a.h"))
    ends = F.col("text").rlike(r"(?i)pin\s*code|\b[1-9]\d{5}\b\.?$")
    stop = (gap > limit) | F.col("text").rlike(r"(?i)^(mobile|phone|signature|vid\b)") | F.regexp_replace("text", "[^0-9]", "").rlike(r"^\d{12}$")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("_stop", F.max(stop.cast("int")).over(run)).withColumn("_past", F.coalesce(F.max(ends.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("_stop = 0 and _past = 0")
    parts = b.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("y0", F.btrim("text", F.lit(" ,")).alias("p")))), lambda s: s["p"]).alias("p"), F.first("a.rest").alias("rest"))
    first = F.concat(F.filter(F.array("rest"), lambda s: s != ""), "p")
    care = F.transform(first, lambda s, i: F.when(i == 0, F.btrim(F.regexp_replace(s, r"(?i)^([SDWC])\s*[/\\]\s*[O0]\b\s*[:.,]?\s*[^,]*,?", ""), F.lit(" ,"))).otherwise(s))
    out = parts.select("file", F.array_join(F.filter(care, lambda s: s != ""), ", ").alias("address"))
    return out.withColumn("pincode", t.postal_code(F.col("address"))).where("pincode <> ''")


# ---- tax number ------------------------------------------------------------------------------
def tax_numbers(lines: DataFrame) -> DataFrame:
    """The voted tax number per document: exact readings, and readings repaired by position on short lines."""
    s = lines.select("file", F.regexp_replace(F.upper("text"), "[^A-Z0-9]", "").alias("s"), "conf").where("length(s) >= 10")
    w = s.select("file", "conf", F.length("s").alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 9), lambda i: F.substr(F.col("s"), i, F.lit(10)))).alias("w"))
    fixed = F.concat(t.repair_letters(F.substring("w", 1, 5), card=True), t.repair_digits(F.substring("w", 6, 4), card=True), t.repair_letters(F.substring("w", 10, 1), card=True))
    exact = F.col("w").rlike(f"^{vocab.TAX_NUMBER}$")
    c = w.withColumn("pan", F.when(exact, F.col("w")).when(fixed.rlike(f"^{vocab.TAX_NUMBER}$") & (F.col("n") <= 12), fixed)).where("pan is not null")
    c = c.withColumn("repaired", ~exact)
    tally = c.groupBy("file", "pan").agg(F.count("*").alias("votes"), F.max("conf").alias("confidence"), F.bool_or("repaired").alias("any_repaired"))
    best = F.max_by(F.struct("pan", "votes", "confidence", "any_repaired"), F.struct("votes", ~F.col("any_repaired"), F.col("pan")))
    b = tally.groupBy("file").agg(best.alias("b")).select("file", "b.*")
    holder = F.try_element_at(t.literal_map(vocab.TAX_HOLDER_TYPES), F.substring("pan", 4, 1))
    return b.withColumn("holder_type", F.coalesce(holder, F.lit("unknown")))


def tax_name_check(numbers: DataFrame, names: DataFrame) -> DataFrame:
    """For individuals the fifth letter should begin one of the name's words; reported with the number masked."""
    x = numbers.join(names, "file", "left")
    initials = F.transform(F.split(F.upper(F.coalesce("name", F.lit(""))), " +"), lambda w: F.substring(w, 1, 1))
    person = (F.substring("pan", 4, 1) == "P") & (F.coalesce("name", F.lit("")) != "")
    ok = F.when(person, F.array_contains(initials, F.substring("pan", 5, 1)))
    return x.select(
        "file", F.concat(F.lit("XXXXXX"), F.right("pan", F.lit(4))).alias("masked_number"), "holder_type", F.col("any_repaired").alias("repaired"), ok.alias("initial_matches"),
        F.coalesce(ok & ~F.col("any_repaired"), F.lit(False)).alias("verified"),
    )


def tax_card_label(text: Column) -> Column:
    """Which label of a tax card a line is, null for none: the text behind the last slash, compared by letters."""
    letters = F.trim(F.regexp_replace(F.upper(F.regexp_replace(F.regexp_replace(text, "^.*/", ""), "[^A-Za-z' ]", " ")), r"\s+", " "))

    def near(x: Column, phrase: str) -> Column:
        # no text is nearer by its common letters than by its Levenshtein distance, which is quick to tell
        most = F.floor(0.15 * (F.length(x) + len(phrase)) + 1e-9)
        return (x == phrase) | ((F.length(x) >= 4) & (F.levenshtein(x, F.lit(phrase)) <= most) & (similar_letters(x, phrase) >= 85))

    # the letters are made once, as the item of an array, and read by every comparison
    first = F.transform(F.array(letters), lambda x: F.coalesce(*[F.when(near(x, phrase), key) for key, phrase in vocab.TAX_CARD_LABELS]))
    return first[0]


def similar_letters(text: Column, phrase: str) -> Column:
    """Similarity (0 to 100) of a text and a fixed phrase by their longest common subsequence."""
    total = F.length(text) + len(phrase)
    return 200.0 * common_letters(text, phrase) / total


def tax_card_fields(lines: DataFrame, today: str) -> DataFrame:
    """Name, father's name and birth date of tax cards: (file, field, value, confidence, by_position).

    A value stands under its label, in its column and at most 2.2 heights below. Older cards have no labels: the first lines
    in capitals under the heading that read as names are taken in order, and the first date anywhere.
    """
    c = F.col
    l = lines.where(F.trim("text") != "").withColumns({
        "h": F.greatest(F.lit(1.0), (c("y1") - c("y0")).cast("double")), "cy": (c("y0") + c("y1")) / 2, "label": tax_card_label(c("text")),
        "born": dates.parse_date(c("text"), today).cast("string"), "named": t.name_like(c("text")),
    })
    l = cut_lineage(l.withColumn("place", F.struct("page", "y0", "x0", "line_id")))
    names = l.where(c("named") & c("label").isNull())
    values = names.select("file", "page", "line_id", "place", "x0", "y0", "cy", "conf", "text", F.lit(False).alias("dated")).unionByName(
        l.where("born is not null").select("file", "page", "line_id", "place", "x0", "y0", "cy", "conf", c("born").alias("text"), F.lit(True).alias("dated"))
    )
    a = l.where("label is not null").select("file", "page", "label", c("place").alias("at"), c("line_id").alias("own"), c("x0").alias("a_x0"), c("y1").alias("a_y1"), c("cy").alias("a_cy"), c("h").alias("a_h"))
    under = a.join(values, ["file", "page"]).where(
        (c("dated") == (c("label") == "date_of_birth")) & (c("line_id") != c("own")) & (c("cy") > c("a_cy") + 0.4 * c("a_h")) & (c("y0") <= c("a_y1") + 2.2 * c("a_h")) & (F.abs(c("x0") - c("a_x0")) <= 3 * c("a_h"))
    )
    # the first label with a value counts, and its highest value
    top = under.groupBy("file", "label").agg(F.min_by(F.struct("text", "conf", "line_id"), F.struct("at", "y0", "place")).alias("v"))
    got = cut_lineage(top.select("file", c("label").alias("field"), "v.*", F.lit(False).alias("by_position")))

    heading = l.where(F.upper("text").rlike(r"INCOME\s*TAX|GOVT")).groupBy("file").agg(F.max("y1").alias("below"))
    given = got.groupBy("file").agg(F.count_if(c("field").isin("name", "father_name")).alias("n"))
    loose = names.where(F.upper("text") == c("text")).join(given, "file", "left").where(F.coalesce("n", F.lit(0)) < 2)
    loose = loose.join(heading, "file", "left").where(c("y0") > F.coalesce("below", F.lit(0))).join(got.select("file", "line_id"), ["file", "line_id"], "left_anti")
    loose = loose.withColumn("nth", F.row_number().over(Window.partitionBy("file").orderBy("place"))).where("nth <= 2")
    loose = loose.select("file", F.when(c("nth") == 1, "name").otherwise("father_name").alias("field"), "text", "conf")
    dated = l.where("born is not null").groupBy("file").agg(F.min_by(F.struct(c("born").alias("text"), "conf"), "place").alias("v")).select("file", F.lit("date_of_birth").alias("field"), "v.*")
    # a lone date is its field however the card is laid out; only names are read by position
    spare = loose.withColumn("by_position", F.lit(True)).unionByName(dated.withColumn("by_position", F.lit(False))).join(got.select("file", "field"), ["file", "field"], "left_anti")
    out = got.drop("line_id").unionByName(spare)
    value = F.when(c("field") == "date_of_birth", c("text")).otherwise(F.upper(t.tidy_name(c("text"))))
    return out.select("file", "field", value.alias("value"), c("conf").alias("confidence"), "by_position")


# ---- labelled values -------------------------------------------------------------------------
def _label_scores(lines: DataFrame, labels: list[tuple[str, str]], cutoff: float) -> DataFrame:
    """Best label of each line over the fixed label list: compared whole and after the last slash."""
    from folioworks.functions.similarity import span_matches

    targets = sorted({(k, v) for k, p in labels for v in (_key(p), _key(p).replace("RN", "M"))})
    texts = F.array_distinct(F.array(t.alnum_key(F.regexp_replace("text", "^.*/", "")), t.alnum_key(F.col("text")), t.alnum_key(F.regexp_replace("text", "^[^/]*/", ""))))
    x = lines.select("*", F.explode(texts).alias("_t")).where("_t <> ''")
    hits = x.withColumn("_h", span_matches([v for _, v in targets], [70.0] * len(targets), [1] * len(targets))(F.array("_t")))
    name = t.literal_map({i: k for i, (k, _) in enumerate(targets)})
    flat = hits.select("file", "page", "line_id", F.explode("_h").alias("h")).select(
        "file", "page", "line_id", F.try_element_at(name, F.col("h.target_id")).alias("label"), F.col("h.score").alias("score")
    )
    best = flat.groupBy("file", "page", "line_id").agg(F.max_by(F.struct("label", "score"), F.struct("score", "label")).alias("b"))
    # a label cut short still counts when it begins one label only
    short = x.where(F.length("_t") >= 7)
    heads = [F.when(F.lit(v).startswith(F.col("_t")) & (F.length("_t") < len(v)), F.lit(k)) for k, v in targets]
    cut = short.groupBy("file", "page", "line_id").agg(F.array_distinct(F.flatten(F.collect_list(F.filter(F.array(*heads), lambda k: k.isNotNull())))).alias("_p")).where("size(_p) = 1").select("file", "page", "line_id", F.col("_p")[0].alias("cut"))
    out = lines.join(best, ["file", "page", "line_id"], "left").join(cut, ["file", "page", "line_id"], "left")
    sure = F.col("b.score") >= cutoff
    return out.select(
        *lines.columns, F.when(sure, F.col("b.label")).otherwise(F.col("cut")).alias("label"), F.coalesce("b.score", F.lit(0.0)).alias("label_score")
    )


def _key(s: str) -> str:
    return "".join(ch for ch in s.upper() if ch.isascii() and ch.isalnum())


def _in_column() -> Column:
    c = F.col
    return (c("x0") >= c("a_x0") - 2.5 * c("a_h")) & (c("x0") <= F.greatest(c("a_x1"), c("a_x0") + 4 * c("a_h"))) & (c("line_id") != c("a_line_id"))


def nearest_above(anchors: DataFrame, lines: DataFrame) -> DataFrame:
    """`anchors` with v, the value line that ends right above each, in its column, with no boundary line between.

    The last boundary above and the last value above are two maxima of one pass; a value above the boundary is none.
    """
    c = F.col
    near = anchors.join(lines.select("file", "page", "line_id", "text", "conf", "x0", "y0", "x1", "y1", "h", "boundary"), ["file", "page"]).where(_in_column() & (c("y0") < c("a_y0")))
    fits = ~c("boundary") & c("y1").between(c("a_y0") - 2.5 * c("a_h"), c("a_y0") + 0.4 * c("a_h"))
    found = near.groupBy(*anchors.columns).agg(
        F.max_by(F.struct("line_id", "text", "conf", "x0", "y0", "x1", "h"), F.when(fits, F.struct("y0", -c("line_id")))).alias("v"), F.max(F.when(c("boundary"), c("y0"))).alias("_bar")
    )
    return found.where(c("v").isNotNull() & (c("_bar").isNull() | (c("v.y0") >= c("_bar")))).drop("_bar")


def _unlabelled_values(lines: DataFrame, found: DataFrame) -> DataFrame:
    """Values whose own label was not read: parents' names and addresses right above the next label, numbers by their form.

    `lines` has label, boundary and h; `found` is (file, key, text, conf) of the labels that were read.
    """
    c = F.col
    shown = lines.where("label IS NOT NULL").select("file", c("label").alias("key")).union(found.select("file", "key")).distinct()
    anchor = [c("line_id").alias("a_line_id"), c("x0").alias("a_x0"), c("y0").alias("a_y0"), c("x1").alias("a_x1"), c("h").alias("a_h")]
    before = t.literal_map({"mother_name": "father_name", "spouse_name": "mother_name"})
    labels = lines.where(c("label").isin("mother_name", "spouse_name")).select("file", "page", F.try_element_at(before, c("label")).alias("key"), c("label").alias("next"), *anchor)
    up = nearest_above(labels.join(shown, ["file", "key"], "left_anti"), lines)
    taken = found.select("file", c("key").alias("next"), c("text").alias("_text"))
    up = up.join(taken, ["file", "next"], "left").where(~c("v.text").eqNullSafe(c("_text")))
    parents = up.groupBy("file", "key").agg(F.min_by("v", F.struct("page", "a_line_id")).alias("v")).select("file", "key", c("v.text").alias("text"), c("v.conf").alias("conf"))
    used = found.unionByName(parents).groupBy("file").agg(F.collect_set("text").alias("_used"))  # as many as there are labels
    ends = lines.where(c("label").isin("old_passport", "file_number")).select("file", "page", c("line_id").alias("from"), *anchor)
    step, blocks = ends.join(shown.where("key = 'address'"), "file", "left_anti"), []
    for i in range(5):
        step = cut_lineage(nearest_above(step, lines).join(used, "file", "left").where(~F.array_contains(F.coalesce("_used", F.array().cast("array<string>")), c("v.text"))).drop("_used"))
        blocks.append(step.select("file", "page", "from", F.lit(-i).alias("i"), c("v.text").alias("text"), c("v.conf").alias("conf")))
        if step.isEmpty():
            break
        step = step.select("file", "page", "from", c("v.line_id").alias("a_line_id"), *[c(f"v.{x}").alias(f"a_{x}") for x in ("x0", "y0", "x1", "h")])
    block = reduce(DataFrame.union, blocks).groupBy("file", "page", "from").agg(F.array_sort(F.collect_list(F.struct("i", "text"))).alias("l"), F.min("conf").alias("conf"))  # five lines at most
    address = block.groupBy("file").agg(F.min_by(F.struct(F.array_join("l.text", ", ").alias("text"), "conf"), F.struct("page", "from")).alias("b")).select("file", F.lit("address").alias("key"), "b.text", "b.conf")
    form = F.replace(F.upper("text"), F.lit(" "), F.lit("")).rlike(r"\b([A-Z][0-9OILSBZ]{7}|[A-Z]{2}[0-9OILSBZ]{6})\b")
    numbers = lines.where(c("label").isNull() & form & (F.length(t.alnum_key(c("text"))) <= 10) & ~c("text").contains("<<")).join(found.where("key = 'passport_number'"), "file", "left_anti")
    number = numbers.groupBy("file").agg(F.min_by(F.struct("text", "conf"), F.struct("page", "line_id")).alias("b")).select("file", F.lit("passport_number").alias("key"), "b.text", "b.conf")
    return parents.unionByName(address).unionByName(number)


def labelled_lines(lines: DataFrame, cutoff: float = 82.0) -> DataFrame:
    """Lines with the travel-document label they show, whether they bound a value, and their height."""
    flat = [(k, p) for k, ps in vocab.TRAVEL_LABELS.items() for p in ps]
    l = cut_lineage(_label_scores(lines, flat, cutoff))
    code = ((F.length("text") - F.length(F.replace("text", F.lit("<"), F.lit("")))) >= 3) & (F.length(F.replace("text", F.lit(" "), F.lit(""))) >= 30)
    return l.withColumn("boundary", F.col("label").isNotNull() | (F.col("label_score") >= 70) | code).withColumn("h", F.greatest(F.lit(1), F.col("y1") - F.col("y0")).cast("double"))


def labelled_values(lines: DataFrame, cutoff: float = 82.0) -> DataFrame:
    """(file, key, text, conf): the value printed under each travel-document label, in its column and above the next
    label, so an empty field stays empty; where a label could not be read, the value right above the next one.

    Lines that already come from `labelled_lines` are not labelled again."""
    l = lines if "boundary" in lines.columns else cut_lineage(labelled_lines(lines, cutoff))
    a = l.where("label is not null").select("file", "page", F.col("label").alias("key"), "label_score", *[F.col(c).alias(f"a_{c}") for c in ("line_id", "x0", "y0", "x1", "y1", "h")])
    c = F.col
    id_ = ["file", "page", "key", "a_line_id"]
    near = a.join(l.select("file", "page", "line_id", "text", "x0", "y0", "x1", "y1", "conf", "boundary"), ["file", "page"]).where(_in_column())
    stop = near.where(c("boundary") & (c("y0") > c("a_y0") + 0.5 * c("a_h"))).groupBy(*id_).agg(F.min("y0").alias("stop"))
    vals = near.where(
        ~c("boundary") & ((c("y0") + c("y1")) / 2 > (c("a_y0") + c("a_y1")) / 2 + 0.3 * c("a_h")) & (c("y0") <= c("a_y1") + 1.5 * c("a_h"))
    ).join(stop, id_, "left").where(c("stop").isNull() | (c("y0") < c("stop") - 0.2 * c("a_h")))
    first = vals.groupBy(*id_).agg(F.min_by(F.struct("text", "conf", "line_id", "x0", "y0", "y1"), F.struct("y0", F.abs(c("x0") - c("a_x0")), "line_id")).alias("v"), F.first("label_score").alias("label_score"), F.first("stop").alias("stop"), F.first("a_h").alias("a_h"))
    first = cut_lineage(first.where((c("key") != "sex") | F.upper("v.text").rlike(r"\b[MFX]\b")))
    best = first.groupBy("file", "key").agg(F.max_by(F.struct("page", "v", "stop", "a_h"), F.struct("label_score", -c("page"), -c("a_line_id"))).alias("b"))
    plain = best.where("key <> 'address'").select("file", "key", c("b.v.text").alias("text"), c("b.v.conf").alias("conf"))
    # an address goes on line by line while the gap stays small, five lines at most
    ad = best.where("key = 'address'").select("file", c("b.page").alias("page"), c("b.v").alias("v"), c("b.stop").alias("stop"), c("b.a_h").alias("a_h"))
    more = l.where("not boundary").join(ad, ["file", "page"]).where((c("y0") >= c("v.y0")) & (c("stop").isNull() | (c("y0") < c("stop") - 0.2 * c("a_h"))) & (F.abs(c("x0") - c("v.x0")) <= 3 * c("a_h")))
    w = Window.partitionBy("file").orderBy("y0", "line_id")
    gap = c("y0") - F.lag("y1").over(w)
    more = more.withColumn("_far", F.when(gap > 2.5 * F.lag("h").over(w), 1).otherwise(0)).withColumn("_g", F.sum("_far").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_k", F.row_number().over(w))
    block = more.where("_g = 0 and _k <= 5").groupBy("file").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "text"))), lambda s: s["text"]), ", ").alias("text"), F.min("conf").alias("conf")
    ).select("file", F.lit("address").alias("key"), "text", "conf")
    found = cut_lineage(plain.unionByName(block))
    return found.unionByName(_unlabelled_values(l, found))


def common_letters(text: Column, word: str) -> Column:
    """Length of the longest common subsequence of a text and a short fixed word."""

    def add(row: Column, letter: Column) -> Column:
        out = [F.lit(0)]
        for j, w in enumerate(word):
            out.append(F.when(letter == w, row[j] + 1).otherwise(F.greatest(row[j + 1], out[-1])))
        return F.array(*out)

    letters = F.filter(F.split(text, ""), lambda x: x != "")
    return F.aggregate(letters, F.array(*[F.lit(0)] * (len(word) + 1)), add, lambda row: row[len(word)])


def clean_value(key: Column, text: Column) -> Column:
    """Value cleaning by field."""
    v = F.btrim(F.regexp_replace(text, r"(?U)\s+", " "), F.lit(" ,.:;-"))
    english = F.trim(F.regexp_replace(v, "^.*/", ""))
    nation = t.alnum_key(english)
    indian = nation.isin("IN", "IND", "INDIA") | (200.0 * common_letters(nation, "INDIAN") / (6 + F.length(nation)) >= 75)
    word_zero = F.array_join(F.transform(F.split(v, " "), lambda w: F.when(w.rlike(r"^[^A-Z0-9]*[A-Z0]*[A-Z][A-Z0]*[^A-Z0-9]*$"), F.translate(w, "0", "O")).otherwise(w)), " ")
    pin = F.regexp_extract(word_zero, r"PIN\W*([0-9OSIB]{6})\b", 1)
    address = F.when(pin != "", F.regexp_replace(word_zero, r"PIN\W*[0-9OSIB]{6}\b", "PIN:@@")).otherwise(word_zero)
    address = F.replace(address, F.lit("@@"), t.repair_digits(pin))
    number = F.regexp_extract(F.replace(F.upper(v), F.lit(" "), F.lit("")), r"\b([A-Z][0-9OILSBZ]{7}|[A-Z]{2}[0-9OILSBZ]{6})\b", 1)
    two = number.rlike("^[A-Z]{2}")
    number = F.when(two, F.concat(F.substring(number, 1, 2), t.repair_digits(F.substring(number, 3, 6)))).otherwise(F.concat(F.substring(number, 1, 1), t.repair_digits(F.substring(number, 2, 7))))
    return (
        F.when((key == "nationality") & indian, "INDIAN").when(key == "nationality", english)
        .when(key == "address", address).when(key.isin("surname", "given_names", "father_name", "mother_name", "spouse_name", "place_of_birth", "place_of_issue"), word_zero)
        .when(key == "sex", F.regexp_extract(F.upper(v), r"\b([MFX])\b", 1)).when(key.startswith("date_"), F.coalesce(dates.parse_strict_date(v).cast("string"), F.lit("")))
        .when(key == "passport_number", number).when(key == "file_number", F.regexp_replace(F.upper(v), "[^A-Z0-9]", "")).otherwise(v)
    )


def remaining_date(known: Column, seen: Column) -> Column:
    """The one printed date strictly between the known ones, else NULL."""
    lo, hi = F.array_min(known), F.array_max(known)
    between = F.filter(F.array_except(F.array_distinct(seen), known), lambda d: (d > lo) & (d < hi))
    return F.when(F.size(between) == 1, between[0])


def with_remaining_date(printed: DataFrame, lines: DataFrame, parsed: DataFrame) -> DataFrame:
    """`printed` with a date of issue where none was read: the one printed date between birth and expiry.

    `lines` are those of `labelled_lines`; birth and expiry are taken as printed and from the code lines.
    """
    dated = printed.where("key IN ('date_of_birth', 'date_of_expiry')").select("file", dates.parse_strict_date(F.col("text")).alias("d"))
    coded = parsed.select("file", F.explode(F.array(*[F.col(k).try_cast("date") for k in ("date_of_birth", "date_of_expiry")])).alias("d"))
    known = dated.union(coded).where("d IS NOT NULL").groupBy("file").agg(F.collect_set("d").alias("known"))  # four at most
    seen = lines.where("NOT boundary").select("file", "conf", dates.parse_strict_date(F.col("text")).alias("d")).where("d IS NOT NULL")
    between = seen.join(known, "file").where((F.col("d") > F.array_min("known")) & (F.col("d") < F.array_max("known")))
    other = between.groupBy("file").agg(F.array_distinct(F.concat(F.array(F.min("d")), F.array(F.max("d")))).alias("seen"), F.first("known").alias("known"), F.min("conf").alias("conf"))
    left = other.withColumn("d", remaining_date(F.col("known"), F.col("seen"))).where("d IS NOT NULL").join(printed.where("key = 'date_of_issue'"), "file", "left_anti")
    return printed.unionByName(left.select("file", F.lit("date_of_issue").alias("key"), F.date_format("d", "dd/MM/yyyy").alias("text"), "conf"))


def reconcile_codes(printed: DataFrame, parsed: DataFrame) -> DataFrame:
    """One value per document and field: a verified code value wins, else the printed one; disagreement is flagged.

    `printed` is (file, key, text, conf). Output: file, field, value, source, confidence, verified, flag.
    """
    protected = ["passport_number", "date_of_birth", "date_of_expiry"]
    whole = F.col("checks")["composite"]
    nation = F.when(F.col("nationality") == "IND", "INDIAN").otherwise(F.col("nationality"))
    items = [("passport_number", F.col("passport_number"), F.col("checks")["passport_number"]), ("surname", F.col("surname"), whole), ("given_names", F.col("given_names"), whole),
             ("nationality", nation, whole & F.col("nationality").rlike("^[A-Z]{3}$")), ("sex", F.col("sex"), whole),
             ("date_of_birth", F.col("date_of_birth"), F.col("checks")["date_of_birth"]), ("date_of_expiry", F.col("date_of_expiry"), F.col("checks")["date_of_expiry"])]
    codes = parsed.select("file", F.explode(F.array(*[F.struct(F.lit(k).alias("field"), v.alias("code"), ok.alias("code_ok")) for k, v, ok in items])).alias("i")).select("file", "i.*")
    codes = codes.where("code is not null and code <> ''")
    vis = printed.select("file", F.col("key").alias("field"), "text", "conf", clean_value(F.col("key"), F.col("text")).alias("seen")).where(F.col("field").isin(vocab.TRAVEL_FIELDS))
    docs = printed.select("file").union(parsed.select("file")).distinct().select("file", F.explode(F.array(*[F.lit(f) for f in vocab.TRAVEL_FIELDS])).alias("field"))
    x = docs.join(vis, ["file", "field"], "left").join(codes, ["file", "field"], "left")
    a, b = t.alnum_key(F.col("seen")), t.alnum_key(F.col("code"))
    x = x.withColumn("_same", a == b).withColumn("_sim", indel_ratio(a, b))
    has_seen, has_code = F.coalesce("seen", F.lit("")) != "", F.col("code").isNotNull()
    sure = has_code & F.coalesce("code_ok", F.lit(False))
    agrees = has_seen & (F.col("_same") | (F.col("_sim") >= 85))
    flag = (
        F.when(sure & has_seen & ~agrees & (F.col("field") != "nationality"), "printed value differs from the code lines")
        .when(~sure & has_seen & has_code & ~F.col("_same"), "code line differs and is not confirmed by its check digits")
        .when(~sure & has_seen & ~has_code & (F.col("conf") < 0.8), "low reading confidence").when(~sure & ~has_seen & has_code, "code-line check digit failed")
    )
    out = x.select(
        "file", "field", F.when(sure, F.col("code")).when(has_seen, F.col("seen")).when(has_code, F.col("code")).otherwise("").alias("value"),
        F.when(sure, "mrz").when(has_seen, "printed text").when(has_code, "mrz").otherwise("not found").alias("source"),
        F.when(sure, 1.0).when(has_seen, F.col("conf")).alias("confidence"), F.when(sure, F.col("field").isin(protected) | agrees).otherwise(False).alias("verified"), flag.alias("flag"),
    )
    return _checked_file_number(out, parsed)


def _checked_file_number(values: DataFrame, parsed: DataFrame) -> DataFrame:
    """The file number held against the optional data of the code lines: a match verifies it and takes its flag back, a near
    miss flags it."""
    extra = parsed.select("file", t.alnum_key(F.col("personal_number")).alias("_extra")).where("length(_extra) >= 8")
    x = values.join(extra, "file", "left")
    own = F.when(F.col("field") == "file_number", t.alnum_key(F.col("value")))
    held = F.coalesce((own != "") & own.endswith(F.col("_extra")), F.lit(False))
    tail = F.when(own != "", F.right(own, F.length("_extra")))
    near = F.coalesce(~held & (indel_ratio(tail, F.when(tail.isNotNull(), F.col("_extra"))) >= 80), F.lit(False))
    return x.select(
        "file", "field", "value", F.when(held, "printed text + code lines").otherwise(F.col("source")).alias("source"), "confidence", (held | F.col("verified")).alias("verified"),
        F.when(held, F.lit(None)).when(near, "file number differs from the code lines").otherwise(F.col("flag")).alias("flag"),
    )


def travel_flags(values: DataFrame, today: str) -> DataFrame:
    """One flag per document and field: (file, field, reason).

    Rules have precedence: a date rule replaces what was flagged before; that a document has expired, or that a required
    field was not found, is only said where nothing else is.
    """
    own = values.where("flag is not null").select("file", "field", F.col("flag").alias("reason"), F.lit(1).alias("rank"))
    missing = values.where(F.col("field").isin(vocab.TRAVEL_REQUIRED) & (F.col("value") == "")).select("file", "field", F.lit("not found - enter manually").alias("reason"), F.lit(3).alias("rank"))
    pick = lambda k: F.max(F.when(F.col("field") == k, F.col("value"))).try_cast("date")
    d = values.groupBy("file").agg(pick("date_of_birth").alias("b"), pick("date_of_issue").alias("i"), pick("date_of_expiry").alias("e"))
    years = F.datediff("e", "i") / 365.25
    rule = lambda broken, field, reason, rank: F.when(broken, F.struct(F.lit(field).alias("field"), F.lit(reason).alias("reason"), F.lit(rank).alias("rank")))
    rules = F.array(
        rule(F.col("i") <= F.col("b"), "date_of_issue", "issue is not after birth", 0),
        rule((F.col("e") <= F.col("i")) | ~years.between(4.5, 10.1), "date_of_expiry", "expiry is not five or ten years after issue", 0),
        rule(F.col("e") < F.lit(today).cast("date"), "date_of_expiry", "document has expired", 2),
    )
    dated = d.select("file", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r")).select("file", "r.field", "r.reason", "r.rank")
    return reduce(DataFrame.unionByName, [own, missing, dated]).groupBy("file", "field").agg(F.min_by("reason", "rank").alias("reason"))


# ---- school memo -----------------------------------------------------------------------------
def memo_subjects(lines: DataFrame) -> DataFrame:
    """One row per printed subject area: the line that names it and the grade, point, marks or words on its row."""
    u = F.upper("text")
    l = lines.withColumn("u", u).withColumn("h", F.greatest(F.lit(1), F.col("y1") - F.col("y0")).cast("double")).withColumn("cy", (F.col("y0") + F.col("y1")) / 2)
    area = F.lit(None).cast("string")
    for code, _, pat in reversed(vocab.MEMO_AREAS):
        area = F.when(F.col("u").rlike(rf"^\W*{pat}\b") & ~F.col("u").rlike("EDUCATION|SKILLS"), code).otherwise(area)
    a = l.withColumn("area", area).where("area is not null").groupBy("file", "area").agg(F.min_by(F.struct("page", "line_id", "x0", "y0", "y1", "cy", "h", "u", "conf"), F.struct("page", "y0", "line_id")).alias("a"))
    c = F.col
    same = l.join(a.hint("merge"), "file").where((c("page") == c("a.page")) & (c("line_id") != c("a.line_id")) & (c("x0") > c("a.x0")) & (F.abs(c("cy") - c("a.cy")) < 0.6 * F.greatest("h", "a.h")))
    g = F.replace(F.regexp_replace("u", r"^[^A-Z0-9]+|[^A-Z0-9*]+$", ""), F.lit(" "), F.lit(""))
    n = t.repair_digits(g, card=True)
    same = same.withColumn("grade", F.when(g.rlike(r"^(A1|A2|B1|B2|C1|C2|D1|D2|D|E)\*?$"), F.replace(g, F.lit("*"), F.lit(""))))
    same = same.withColumn("number", F.when(c("grade").isNull() & n.rlike(r"^\d{1,3}\*?$"), F.replace(n, F.lit("*"), F.lit("")).try_cast("int"))).withColumn("words", F.when(c("grade").isNull() & c("number").isNull(), t.number_words_text(c("u"))))
    same = same.withColumn("lang", F.when(c("grade").isNull() & c("number").isNull() & (F.coalesce("words", F.lit("")) == "") & (F.length("u") >= 4) & c("u").rlike("^[A-Z/ .]+$"), c("u")))
    r = same.groupBy("file", "area").agg(
        F.max_by("grade", F.when(c("grade").isNotNull(), c("x0"))).alias("grade"), F.min_by("number", F.when(c("number").isNotNull(), c("x0"))).alias("number"),
        F.max_by("words", F.when(c("words") != "", c("x0"))).alias("words"), F.min_by("lang", F.when(c("lang").isNotNull(), c("x0"))).alias("lang"), F.min("conf").alias("row_conf"),
    )
    out = a.join(r.hint("merge"), ["file", "area"], "left")
    own = F.lit("")
    for code, _, pat in vocab.MEMO_AREAS:
        own = F.when(c("area") == code, F.btrim(F.regexp_replace("a.u", rf"^\W*{pat}\W*", ""), F.lit(" :;(),."))).otherwise(own)
    subject = F.coalesce(F.try_element_at(t.literal_map(vocab.MEMO_AREA_SUBJECT), c("area")), F.when(own != "", own), c("lang"), F.when(c("area") == "L3", "ENGLISH"), F.lit(""))
    point = (c("number") <= 10)
    return out.select("file", "area", subject.alias("subject"), "grade", F.when(point, c("number")).alias("grade_point"), F.when(~point, c("number")).alias("marks"),
                      F.coalesce("words", F.lit("")).alias("words"), F.round(F.least("a.conf", "row_conf"), 4).alias("confidence"), c("a.y0").alias("y"))


def number_on_row(rows: DataFrame, label: str, pattern: str) -> DataFrame:
    """Last number after a label, from the first printed row that shows it. `rows` is (file, row_no, text)."""
    hits = rows.where(F.col("text").rlike(f"(?i){label}"))
    after = F.btrim(F.regexp_replace("text", f"(?i)^.*?(?:{label})", ""), F.lit(" :;.,-("))
    v = F.try_element_at(F.regexp_extract_all(after, F.lit(pattern), 1), F.lit(-1))
    return hits.withColumn("value", v).where("value is not null").groupBy("file").agg(F.min_by("value", "row_no").alias("value"))


def check_memos(subjects: DataFrame, printed: DataFrame) -> DataFrame:
    """Flags of school memos: grade against point, figures against words, unread or missing rows, total and average.

    `printed` is (file, cgpa, total), and points_total where memos print the sum of the grade points.
    """
    c = F.col
    if "points_total" not in printed.columns:
        printed = printed.withColumn("points_total", F.lit(None).cast("int"))
    graded = subjects.groupBy("file").agg((F.count("grade") >= F.greatest(F.lit(1), F.floor(F.count("*") / 2))).alias("graded"), F.count("*").alias("n"))
    # sizes are guessed from the input file before its rows are printed: a guess must not send a row per memo through the driver
    s = subjects.join(graded.hint("merge"), "file").withColumn("from_words", c("words").try_cast("int"))
    s = s.withColumn("point", F.when(c("graded"), F.coalesce("grade_point", "from_words"))).withColumn("mark", F.when(~c("graded"), F.coalesce("marks", "from_words")))
    expected = F.try_element_at(t.literal_map(vocab.GRADE_POINTS), c("grade"))
    reason = (
        F.when(c("graded") & (c("grade").isNull() | c("point").isNull()), "grade or grade point not read")
        .when(c("graded") & (expected != c("point")), F.concat(F.lit("grade "), "grade", F.lit(" should carry "), expected, F.lit(" points")))
        .when(c("graded") & (c("from_words") != c("point")), "figures and words differ").when(~c("graded") & c("mark").isNull(), "marks not read")
        .when(~c("graded") & (c("from_words") != c("mark")), "figures and words differ")
    )
    rows = s.withColumn("reason", reason).where("reason is not null").select("file", F.concat(F.lit("subjects."), "area").alias("field"), "reason")
    d = s.groupBy("file").agg(F.first("graded").alias("graded"), F.first("n").alias("n"), F.sum("point").alias("points"), F.count("point").alias("n_points"), F.sum("mark").alias("marks"), F.count("mark").alias("n_marks")).join(printed.hint("merge"), "file", "left")
    mean = c("points") / 6
    whole = c("graded") & (c("n") == 6) & (c("n_points") == 6)
    average = (
        F.when(c("graded") & c("cgpa").isNull(), "CGPA not found")
        .when(whole & (c("points_total") != c("points")), "grade points do not add up to their total")
        .when(whole & (F.abs(c("cgpa") - F.round(mean + 1e-9, 1)) >= 0.051), "average of the grade points differs")
    )
    rules = F.array(
        F.when(c("n") < 6, F.struct(F.lit("subjects").alias("field"), F.lit("fewer than six subject rows were read").alias("reason"))),
        F.when(average.isNotNull(), F.struct(F.lit("cgpa").alias("field"), average.alias("reason"))),
        F.when(~c("graded") & c("total").isNotNull() & (c("n_marks") == c("n")) & (c("marks") != c("total")), F.struct(F.lit("total_marks").alias("field"), F.lit("subjects do not add up to the total").alias("reason"))),
        F.when(~c("graded") & c("total").isNull(), F.struct(F.lit("total_marks").alias("field"), F.lit("grand total not found").alias("reason"))),
    )
    docs = d.select("file", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r")).select("file", "r.field", "r.reason")
    return rows.unionByName(docs)
