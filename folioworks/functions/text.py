"""Column standardizers. Each returns a Column; the `*_note` forms return struct(value, note)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioworks import vocab
from folioworks.functions.similarity import best_entry, best_entry_per_word


def blank(c: Column) -> Column:
    """Null or only white space. Null never leaks out of the test."""
    return c.isNull() | (F.trim(c.cast("string")) == "")


def blank_array(c: Column) -> Column:
    return c.isNull() | (F.size(c) == 0)


def collapse_ws(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def alnum_key(c: Column) -> Column:
    """Upper-case letters and digits only: the match key of the layout operators."""
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]", "")


def spaced_key(c: Column) -> Column:
    """Upper-case words separated by one space: the match key of the classifier."""
    spaced = F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9 ]", " ")
    return F.trim(F.regexp_replace(spaced, " +", " "))


def name_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z ]", ""))


def digits_only(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "[^0-9]", "")


def subject_match_key(c: Column) -> Column:
    return F.replace(alnum_key(c), F.lit("PRACTICALS"), F.lit("PRACTICAL"))


def subject_set_key(c: Column) -> Column:
    """The name a subject counts under when a subject set is matched."""
    n = F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"[^\p{L} ]", "")
    return (
        F.when(n.startswith("MATHEMATICS"), "MATHEMATICS")
        .when(n.contains("CIVICS") | n.contains("POLITICAL SCIENCE"), "CIVICS")
        .otherwise(F.trim(F.regexp_replace(n, "PRACTICALS?", "")))
    )


_INT = r"(?i)^(0*)([0-9]{1,4})\s*([^\w\s]?\s*P|[^\w\s])?$"


def to_int(c: Column) -> Column:
    """'095' -> 95, '47*' -> 47, '76 P' -> 76; anything ambiguous -> NULL."""
    s = collapse_ws(c.cast("string"))
    return F.when(s.rlike(_INT), F.regexp_extract(s, _INT, 2)).try_cast("int")


def to_int_note(c: Column) -> Column:
    s = collapse_ws(c.cast("string"))
    zeros, marker = F.regexp_extract(s, _INT, 1), F.trim(F.regexp_extract(s, _INT, 3))
    note = (
        F.when(c.isNull(), "empty")
        .when(~s.rlike(_INT), F.concat(F.lit("not an unambiguous integer: "), s))
        .otherwise(
            F.concat_ws(
                "; ",
                F.when(zeros != "", F.lit("leading zeros stripped")),
                F.when(marker != "", F.concat(F.lit("marker "), marker, F.lit(" stripped"))),
            )
        )
    )
    return F.struct(to_int(c).alias("value"), note.alias("note"))


_FLOAT = r"^[0-9]{1,3}(\.[0-9]{1,3})?$"


def to_float(c: Column) -> Column:
    s = F.trim(F.rtrim(collapse_ws(c.cast("string")), F.lit("%")))
    return F.when(s.rlike(_FLOAT), s).try_cast("double")


def to_float_note(c: Column) -> Column:
    v = to_float(c)
    note = (
        F.when(c.isNull(), "empty")
        .when(v.isNull(), F.concat(F.lit("not an unambiguous number: "), c.cast("string")))
        .when(c.cast("string").contains("%"), "'%' stripped")
        .otherwise("")
    )
    return F.struct(v.alias("value"), note.alias("note"))


def strip_name(c: Column) -> Column:
    """White space collapsed and separator marks dropped at both ends; case kept."""
    return F.btrim(collapse_ws(c), F.lit(" :;.,-_|"))


def strip_name_note(c: Column) -> Column:
    note = F.when(strip_name(c) != collapse_ws(c), "separator punctuation stripped").otherwise("")
    return F.struct(strip_name(c).alias("value"), note.alias("note"))


def strip_id(c: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[\s.:\-]", ""))


def strip_id_note(c: Column) -> Column:
    note = F.when(strip_id(c) != F.coalesce(c, F.lit("")), "separators removed").otherwise("")
    return F.struct(strip_id(c).alias("value"), note.alias("note"))


_YEAR = r"(19[89][0-9]|20[0-3][0-9])"


def parse_year(c: Column) -> Column:
    return F.regexp_extract(collapse_ws(c), _YEAR, 1).try_cast("int")


def parse_month(c: Column) -> Column:
    """Month of the first token that names one: exact, glued to a word, abbreviated, then near-spelt."""
    letters = F.trim(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z]+", " "))
    tokens = F.filter(F.split(letters, " "), lambda w: F.length(w) >= 3)
    months = F.array(*[F.lit(m) for m in vocab.MONTHS])

    def spelled(tok: Column) -> Column:
        glued_long = F.filter(months, lambda m: (F.length(m) >= 4) & F.endswith(tok, m))
        glued_short = F.filter(
            months, lambda m: (F.length(m) == 3) & F.endswith(tok, m) & (F.length(tok) <= 5)
        )
        abbreviated = F.filter(months, lambda m: F.substring(tok, 1, 3) == F.substring(m, 1, 3))
        return F.coalesce(
            F.when(F.array_contains(months, tok), tok),
            F.try_element_at(glued_long, F.lit(1)),
            F.try_element_at(glued_short, F.lit(1)),
            F.try_element_at(abbreviated, F.lit(1)),
        )

    # the first word decides most texts by itself; only the others are compared by spelling
    plain = spelled(F.coalesce(F.try_element_at(tokens, F.lit(1)), F.lit("")))
    near = best_entry_per_word(vocab.MONTHS, 85)(F.when(plain.isNull(), letters))
    reading = F.zip_with(F.transform(tokens, spelled), near, lambda plain, close: F.coalesce(plain, close))
    return F.coalesce(F.try_element_at(F.filter(reading, lambda m: m.isNotNull()), F.lit(1)), F.lit(""))


def categorical_note(c: Column, entries: list[str], cutoff: float = 90) -> Column:
    """Exact, then spacing-insensitive, then near spelling; otherwise verbatim with a note."""
    s = F.btrim(F.upper(collapse_ws(c)), F.lit(" .,:;"))
    compact = F.replace(s, F.lit(" "), F.lit(""))
    known = F.array(*[F.lit(v) for v in entries])
    spacing = F.try_element_at(
        F.filter(known, lambda v: F.replace(v, F.lit(" "), F.lit("")) == compact), F.lit(1)
    )
    exact = F.array_contains(known, s)
    near = best_entry(entries, cutoff)(F.when(~exact, s))
    value = (
        F.when(s == "", "")
        .when(exact, s)
        .when(spacing.isNotNull(), spacing)
        .otherwise(F.coalesce(near["value"], collapse_ws(c)))
    )
    note = (
        F.when(s == "", "empty")
        .when(exact, "")
        .when(spacing.isNotNull(), "spacing normalized")
        .when(near["value"].isNotNull(), F.concat(F.lit("fuzzy-mapped (score "), F.round(near["score"]).cast("int"), F.lit(")")))
        .otherwise("not in vocabulary; kept verbatim")
    )
    return F.struct(value.alias("value"), note.alias("note"))


def _words_to_digits(c: Column, words: dict[str, str]) -> tuple[Column, Column]:
    tokens = F.filter(F.split(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z]+"), lambda t: t != "")
    lookup = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    digits = F.transform(tokens, lambda t: F.try_element_at(lookup, t))
    joined = F.when((F.size(tokens) > 0) & ~F.exists(digits, lambda d: d.isNull()), F.array_join(digits, ""))
    return F.size(tokens), joined


def parse_number_words(c: Column) -> Column:
    """'*SEVEN**FIVE***TWO*' -> 752. Up to four exact digit words; one misread word gives NULL."""
    n, joined = _words_to_digits(c, vocab.NUMBER_WORDS)
    return F.when(n <= 4, joined).try_cast("int")


def number_words_text(c: Column) -> Column:
    """'ZERO EIGHT' -> '08' (leading zeros kept); '' when any word is not a digit."""
    _, joined = _words_to_digits(c, vocab.DIGIT_WORDS)
    return F.coalesce(joined, F.lit(""))


def spell_digits(c: Column, sep: str = " ") -> Column:
    """The printing inverse of parse_number_words."""
    words = F.array(*[F.lit(w) for w in vocab.DIGIT_WORDS])
    digits = F.filter(F.split(c.cast("string"), ""), lambda d: d != "")
    return F.array_join(F.transform(digits, lambda d: F.element_at(words, d.cast("int") + 1)), sep)


def board_id(c: Column) -> Column:
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.coalesce(F.try_element_at(_literal_map(vocab.BOARD_IDS), t), t)


def board_state(c: Column) -> Column:
    return F.try_element_at(_literal_map(vocab.BOARD_STATE), F.coalesce(c, F.lit("")))


def document_kind(c: Column) -> Column:
    s = F.lower(F.coalesce(c, F.lit("")))
    return F.when(s.contains("intermediate"), "intermediate").when(s != "", "other").otherwise("")


def _literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


literal_map = _literal_map


def name_suspicions(c: Column) -> Column:
    """Reasons a person's name looks like reading residue, as an array."""
    v = F.coalesce(c, F.lit(""))
    tokens = F.filter(F.split(v, r"(?U)\s+"), lambda t: t != "")
    last = F.try_element_at(tokens, F.lit(-1))
    reasons = F.array(
        F.when(v.rlike(vocab.NAME_TEMPLATE_WORDS), F.lit("contains certificate template words")),
        F.when(v.rlike("[a-z]") & v.rlike("[A-Z]{3,}"), F.lit("mixed case inside an otherwise upper-case name")),
        F.when(v.rlike(r"[0-9()\[\]{}|/\\:;,]"), F.lit("contains digits or punctuation")),
        F.when(v.rlike(r"(^|\s)\.(\s|$)|\.\s*\."), F.lit("contains stray dots")),
        F.when(
            (F.size(tokens) > 1) & (F.length(last) <= 2) & ~last.isin(vocab.SHORT_NAME_ENDINGS),
            F.concat(F.lit("ends with a very short token "), last),
        ),
        F.when(F.length(F.replace(v, F.lit(" "), F.lit(""))) < 4, F.lit("implausibly short")),
    )
    return F.when(v == "", F.array().cast("array<string>")).otherwise(F.filter(reasons, lambda r: r.isNotNull()))


def repair_digits(c: Column, card: bool = False) -> Column:
    src, dst = vocab.LETTERS_AS_DIGITS_CARD if card else vocab.LETTERS_AS_DIGITS
    return F.translate(c, src, dst)


def repair_letters(c: Column, card: bool = False) -> Column:
    src, dst = vocab.DIGITS_AS_LETTERS_CARD if card else vocab.DIGITS_AS_LETTERS
    return F.translate(c, src, dst)


def tidy_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.btrim(c, F.lit(" ,.:;")), r"(?U)\s+", " "))


def name_like(c: Column, min_words: int = 1) -> Column:
    t = F.btrim(F.coalesce(c, F.lit("")), F.lit(" ,.:;"))
    words = F.filter(F.split(t, "[ .]+"), lambda w: w != "")
    stop = F.array(*[F.lit(w) for w in vocab.NAME_STOP_WORDS])
    return (
        t.rlike(r"^[A-Za-z .']+$")
        & (F.size(words) >= min_words)
        & (F.length(F.array_join(words, "")) >= 4)
        & ~F.arrays_overlap(F.transform(words, F.upper), stop)
    )


def mask_number(c: Column) -> Column:
    """Only the last four digits stay; '' when there are fewer."""
    d = digits_only(c)
    return F.when(F.length(d) >= 4, F.concat(F.lit("XXXX XXXX "), F.right(d, F.lit(4)))).otherwise("")


def postal_code(c: Column) -> Column:
    hits = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?<!\d)([1-9]\d{2} ?\d{3})(?!\d)"), 1)
    return F.coalesce(F.replace(F.try_element_at(hits, F.lit(-1)), F.lit(" "), F.lit("")), F.lit(""))


def code_line(c: Column) -> Column:
    """Upper case, no spaces, and every character outside A-Z 0-9 read as the filler '<'."""
    return F.regexp_replace(F.replace(F.upper(c), F.lit(" "), F.lit("")), "[^A-Z0-9<]", "<")


def file_stem(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"^.*[/\\]", ""), r"(?<=.)\.[^.]*$", "")


def file_number(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c, r"\D", "").try_cast("long"), F.lit(0).cast("long"))
