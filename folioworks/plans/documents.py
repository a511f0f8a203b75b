"""Classification and extraction of the certificates printed from the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks import vocab
from folioworks.operators import phrases
from folioworks.plans.registry import query
from folioworks.session import Part, cut_lineage, in_parts, spread_by, table
from folioworks.sources import derived

_LETTERS = "translate(CAST({} + 100000 AS VARCHAR), '0123456789', 'ABCDEFGHIJ')"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# what is printed, in SQL: one row per customer with orders
TRUTH_SQL = f"""
    r AS (SELECT o_custkey AS k, o_orderkey, list_extract({_list(derived._SUBJECTS)}, 1 + o_orderkey % 12) || ' ' || {_LETTERS.format("o_orderkey")} AS subject_name,
          CAST(o_orderkey * 7 % 101 AS INTEGER) AS first, CAST((o_orderkey * 13 + 5) % 101 AS INTEGER) AS second FROM orders),
    t AS (SELECT k, CAST(sum(first + second) AS INTEGER) AS total, CAST(count(*) AS INTEGER) AS n_rows FROM r GROUP BY 1),
    c AS (SELECT c_custkey AS k, 'certificate_' || CAST(c_custkey AS VARCHAR) || '.pdf' AS file, c_custkey % 17 = 5 AS ledger,
          c_mktsegment || ' ' || {_LETTERS.format("c_custkey")} AS student_name, 'RAM ' || {_LETTERS.format("c_custkey * 3")} AS father_name,
          'SITA ' || {_LETTERS.format("c_custkey * 7")} AS mother_name,
          lpad(CAST((c_custkey + 90) % 35 % 25 AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 100000000 AS VARCHAR), 8, '0') AS hall_ticket_number,
          CAST(1990 + c_custkey % 35 AS INTEGER) AS year_of_pass, list_extract({_list(vocab.MONTHS)}, 1 + c_custkey % 12) AS month_of_pass,
          list_extract({_list(vocab.MEDIA)}, 1 + c_custkey % 8) AS medium, list_extract({_list(vocab.RESULTS)}, 1 + c_custkey % 12) AS result,
          total, n_rows FROM customer JOIN t ON t.k = c_custkey)"""


@query(
    "certificate_classes",
    f"""WITH {TRUTH_SQL}
    SELECT file, CASE WHEN ledger THEN 'unknown' ELSE '{vocab.CERTIFICATE}' END AS document_type,
      CASE WHEN ledger THEN '' ELSE 'pass_certificate_cum_memorandum' END AS document_subtype,
      CASE WHEN ledger THEN '' WHEN k % 3 = 0 THEN 'Telangana' ELSE 'Andhra Pradesh' END AS state,
      CASE WHEN ledger THEN '' WHEN k % 3 = 2 THEN 'board_name' ELSE 'ocr_text' END AS state_source,
      CASE WHEN ledger THEN '' WHEN k % 3 = 0 THEN '{vocab.TS_STATE_BOARD}' WHEN k % 3 = 1 THEN '{vocab.AP_BOARD}' ELSE '{vocab.AP_BOARD_SHORT}' END AS board,
      NOT ledger AS supported FROM c""",
)
def certificate_classes(spark: SparkSession, root: str) -> DataFrame:
    def of(part: Part | None) -> DataFrame:
        docs, _ = phrases.classify_documents(derived.certificate_lines(spark, root, part))
        return docs.select("file", "document_type", "document_subtype", "state", "state_source", "board", "supported")

    # a line leaves little on disk, so more of them are read together
    return in_parts(spark, derived.certificate_parts(spark, root, 8 * derived.PART_ORDERS), of)


_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def _wrap(x: str) -> str:
    return f"CAST(({x}) % {1 << 64}::UHUGEINT AS UBIGINT)"


def _times(x: str, p: int) -> str:
    return _wrap(f"({x})::UHUGEINT * {p}::UHUGEINT")


def _turned(x: str, n: int) -> str:
    return _wrap(f"({x})::UHUGEINT * {1 << n}::UHUGEINT + (({x}) >> {64 - n})::UHUGEINT")


# the page an order is dealt to where a customer has several pages: Spark's xxhash64 of the key (seed 42), step by step
_PAGES_SQL = f"""
    m AS (SELECT k, CAST(ceil(n_rows / {derived._PER_PAGE}.0) AS HUGEINT) AS n FROM c WHERE n_rows > {derived._PER_PAGE}),
    x0 AS (SELECT m.k, n, {_times("o_orderkey::UBIGINT", _P2)} AS a FROM m JOIN r ON m.k = r.k),
    x1 AS (SELECT k, n, xor({(42 + _P5 + 8) % (1 << 64)}::UBIGINT, {_times(_turned("a", 31), _P1)}) AS a FROM x0),
    x2 AS (SELECT k, n, {_wrap(f"{_times(_turned('a', 27), _P1)}::UHUGEINT + {_P4}::UHUGEINT")} AS a FROM x1),
    x3 AS (SELECT k, n, {_times("xor(a, a >> 33)", _P2)} AS a FROM x2),
    x4 AS (SELECT k, n, {_times("xor(a, a >> 29)", _P3)} AS a FROM x3),
    x5 AS (SELECT k, n, xor(a, a >> 32)::HUGEINT AS a FROM x4),
    pg AS (SELECT DISTINCT k, ((a - CASE WHEN a >= {1 << 63}::HUGEINT THEN {1 << 64}::HUGEINT ELSE 0 END) % n + n) % n + 1 AS page FROM x5)"""


@query(
    "certificate_page_roles",
    f"""WITH {TRUTH_SQL}, {_PAGES_SQL}, p AS (SELECT 'certificate' AS role FROM c UNION ALL SELECT 'other' FROM pg WHERE page > 1)
    SELECT role, count(*) AS documents FROM p GROUP BY role""",
)
def certificate_page_roles(spark: SparkSession, root: str) -> DataFrame:
    """Pages by role: a first page shows enough labels to be a certificate side, further pages show only subject rows."""
    def of(part: Part | None) -> DataFrame:
        _, pages = phrases.classify_documents(derived.certificate_lines(spark, root, part))
        return pages.groupBy("role").agg(F.count("*").alias("documents"))

    return in_parts(spark, derived.certificate_parts(spark, root, 8 * derived.PART_ORDERS), of).groupBy("role").agg(F.sum("documents").alias("documents"))


_WORDS = {
    "english": [("of the", 1.0), ("with by", 2.0), ("and the", 1.0), ("is on the", 2.0)],
    "french": [("de la", 1.0), ("que des", 1.0), ("dans le", 2.0), ("pour les", 2.0)],
    "german": [("in der", 1.0), ("und die", 1.0), ("mit dem", 2.0), ("das ist", 2.0)],
    "spanish": [("de los", 1.0), ("en el", 1.0), ("por la", 2.0), ("con el", 2.0)],
}


def _evidence_sql() -> str:
    flat = [(i, lab, p.upper(), w) for i, (lab, ps) in enumerate(_WORDS.items()) for p, w in ps]
    sums = ", ".join(
        f"({' + '.join(f'CASE WHEN bool_or(contains(k, $${p}$$)) THEN {w} ELSE 0 END' for j, _, p, w in flat if j == i)}) AS s{i}" for i in range(len(_WORDS))
    )
    names = list(_WORDS)
    ranked = "list_sort([" + ", ".join(f"{{'n': -CAST(s{i} AS DOUBLE), 'o': {i}, 'l': '{names[i]}'}}" for i in range(len(names))) + "])"
    return f"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    n AS (SELECT doc_id, i, line, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM l),
    k AS (SELECT doc_id, trim(regexp_replace(regexp_replace(upper(replace(line, 'ß', 'SS')), '[^A-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS k FROM n
          UNION ALL SELECT doc_id, trim(regexp_replace(regexp_replace(upper(replace(line || ' ' || nxt, 'ß', 'SS')), '[^A-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) FROM n WHERE nxt IS NOT NULL),
    s AS (SELECT doc_id, {sums} FROM k GROUP BY 1),
    r AS (SELECT doc_id, {ranked} AS r FROM s)
    SELECT CAST(doc_id AS VARCHAR) AS file, r[1].l AS label, -r[1].n AS best, -r[2].n AS second FROM r"""


@query("phrase_evidence_classify", _evidence_sql())
def phrase_evidence_classify(spark: SparkSession, root: str) -> DataFrame:
    """Language cue phrases over all lines and line pairs of the texts; phrases this short must match exactly."""
    table_ = {lab: [(p.upper(), w) for p, w in ps] for lab, ps in _WORDS.items()}
    e = phrases.phrase_evidence(derived.document_lines(spark, root), table_, ["file"], cutoff=100.0)
    return e.select("file", "label", (F.col("best") + 0.0).alias("best"), (F.col("second") + 0.0).alias("second"))


@query(
    "registration_numbers",
    f"""WITH {TRUTH_SQL} SELECT file, hall_ticket_number AS number FROM c WHERE left(hall_ticket_number, 1) IN ('0', '1', '2')""",
)
def registration_numbers(spark: SparkSession, root: str) -> DataFrame:
    from folioworks.operators.dedup import registration_numbers as find

    return find(derived.certificate_lines(spark, root).withColumn("role", F.lit("certificate")))


@query(
    "keyword_counts",
    f"""WITH {TRUTH_SQL} SELECT file, CASE WHEN ledger THEN 1 ELSE 3 END AS hits FROM c""",
)
def keyword_counts(spark: SparkSession, root: str) -> DataFrame:
    lines = derived.certificate_lines(spark, root)
    return phrases.keyword_hits(lines, ["INTERMEDIATE EDUCATION", "PASS CERTIFICATE", "REGISTERED NO"], ["file"])


@query("page_texts", """SELECT doc_id, md5(text) AS digest FROM documents""")
def page_texts(spark: SparkSession, root: str) -> DataFrame:
    """Lines put back together in order give the text again."""
    from folioworks.operators.layout import page_text

    lines = derived.document_lines(spark, root)
    pages = page_text(lines).select("file", F.struct("page", "text").alias("p"))
    whole = pages.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["text"]), "\n").alias("text"))
    return whole.select(F.col("file").cast("long").alias("doc_id"), F.md5("text").alias("digest"))


def printed(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Lines, words, pages, visual rows and page statistics of the printed certificates."""
    from folioworks.operators.layout import page_stats, visual_rows

    lines = derived.certificate_lines(spark, root)
    words = derived.lines_to_words(lines)
    return {
        "lines": lines, "words": words, "pages": derived.certificate_pages(lines),
        "rows": visual_rows(words), "stats": page_stats(words), "customers": table(spark, root, "customer"),
    }


@query(
    "visual_row_counts",
    f"""WITH {TRUTH_SQL}, w AS (SELECT k, 5 * 2 + 2 * len(string_split('x', ' ')) AS x FROM c)
    SELECT file, CAST(9 + 3 + n_rows AS BIGINT) AS n_rows FROM c""",
)
def visual_row_counts(spark: SparkSession, root: str) -> DataFrame:
    """Printed rows per certificate of one page: nine heading rows, the table header, the subjects and two totals."""
    p = printed(spark, root)
    heads = p["lines"].where("line_id = 20").groupBy("file").agg(F.count("*").alias("_pages"))
    n = p["rows"].select("file", "page", "row_id").distinct().groupBy("file").agg(F.count("*").alias("n"))
    return n.join(heads.hint("merge"), "file").select("file", (F.col("n") - (F.col("_pages") - 1)).alias("n_rows"))


@query(
    "table_rows",
    f"""WITH {TRUTH_SQL}
    SELECT file, subject_name, 'I' AS paper, first AS marks, 100 AS maximum_marks, true AS paper_from_header FROM r JOIN c ON r.k = c.k WHERE NOT ledger
    UNION ALL SELECT file, subject_name, 'II', second, 100, true FROM r JOIN c ON r.k = c.k WHERE NOT ledger""",
)
def table_rows(spark: SparkSession, root: str) -> DataFrame:
    from folioworks.operators.assemble import extract_subjects

    def of(part: Part | None) -> DataFrame:
        rows = extract_subjects(*_printed_cut(spark, root, part))
        return rows.select("file", "subject_name", "paper", "marks", "maximum_marks", "paper_from_header")

    return in_parts(spark, derived.certificate_parts(spark, root), of)


def _printed_cut(spark: SparkSession, root: str, part: Part | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    lines = cut_lineage(derived.certificate_lines(spark, root, part))
    return lines, derived.lines_to_words(lines), derived.certificate_pages(lines)


@query(
    "extract_certificates",
    f"""WITH {TRUTH_SQL}
    SELECT file, CASE WHEN ledger THEN 'unknown' ELSE '{vocab.CERTIFICATE}' END AS document_type,
      CASE WHEN ledger THEN '' ELSE student_name END AS student_name, CASE WHEN ledger THEN '' ELSE father_name END AS father_name,
      CASE WHEN ledger THEN '' ELSE mother_name END AS mother_name, CASE WHEN ledger THEN '' ELSE hall_ticket_number END AS hall_ticket_number,
      CASE WHEN NOT ledger THEN year_of_pass END AS year_of_pass, CASE WHEN ledger THEN '' ELSE month_of_pass END AS month_of_pass,
      CASE WHEN ledger THEN '' ELSE medium END AS medium, CASE WHEN ledger THEN '' ELSE result END AS result,
      CASE WHEN NOT ledger THEN total END AS total_marks, CASE WHEN NOT ledger THEN 200 * n_rows END AS maximum_marks,
      CASE WHEN NOT ledger THEN round(100.0 * total / (200 * n_rows), 2) END AS percentage, CASE WHEN ledger THEN 0 ELSE 2 * n_rows END AS n_subjects
    FROM c""",
)
def extract_certificates(spark: SparkSession, root: str) -> DataFrame:
    from folioworks.operators.assemble import extract_certificates as extracted

    def of(part: Part | None) -> DataFrame:
        flat = extracted(*_printed_cut(spark, root, part))["flat"]
        return flat.select("file", "document_type", "student_name", "father_name", "mother_name", "hall_ticket_number", "year_of_pass", "month_of_pass",
                           "medium", "result", "total_marks", "maximum_marks", "percentage", F.size("subjects").alias("n_subjects"))

    return in_parts(spark, derived.certificate_parts(spark, root), of)


@query(
    "truth_rule_issues",
    f"""WITH {TRUTH_SQL}
    SELECT file, 'total_marks' AS field, 'subject_sum_mismatch' AS "check", 'error' AS severity FROM c WHERE k % 10 = 0
    UNION ALL SELECT file, 'year_of_pass', 'implausible_year', 'error' FROM c WHERE k % 8 = 0 UNION ALL SELECT file, 'medium', 'nonstandard_medium', 'warning' FROM c WHERE k % 9 = 0
    UNION ALL SELECT file, 'cgpa', 'implausible_cgpa', 'error' FROM c WHERE k % 12 = 0 UNION ALL SELECT file, 'mother_name', 'missing_value', 'info' FROM c WHERE k % 7 = 0
    UNION ALL SELECT file, 'result', 'nonstandard_result', 'info' FROM c WHERE k % 6 = 1 UNION ALL SELECT file, 'subjects', 'duplicate_subject_row', 'warning' FROM c WHERE k % 14 = 3
    UNION ALL SELECT file, 'subjects[0].marks', 'marks_exceed_max', 'error' FROM c WHERE k % 15 = 4""",
)
def truth_rule_issues(spark: SparkSession, root: str) -> DataFrame:
    """Record, subject and total rules over the truth of every certificate, with known faults put in."""
    from folioworks.operators.truth import check_truth

    k = F.col("custkey")
    rows = spread_by(derived.certificate_orders(spark, root), "file")
    one = lambda paper, marks: F.struct("subject_name", F.lit(paper).alias("paper"), marks.alias("marks"), F.lit(100).alias("maximum_marks"))
    s = rows.groupBy("file").agg(F.flatten(F.collect_list(F.array(one("I", F.col("first")), one("II", F.col("second"))))).alias("subjects"))
    t = derived.certificate_truth(spark, root).join(s.hint("merge"), "file")
    fault = F.transform(
        "subjects",
        lambda r, i: F.struct(r["subject_name"].alias("subject_name"), r["paper"].alias("paper"), r["marks"].alias("marks"),
                              F.when((i == 0) & (k % 15 == 4), r["marks"] - 1).otherwise(r["maximum_marks"]).alias("maximum_marks")),
    )
    # a repeated row carries no marks of its own, so the sum stays right
    again = F.transform(F.slice("subjects", 1, 1), lambda r: F.struct(r["subject_name"].alias("subject_name"), r["paper"].alias("paper"), F.lit(0).alias("marks"), F.lit(100).alias("maximum_marks")))
    empty = F.lit(None)
    t = t.withColumn("subjects", F.when(k % 14 == 3, F.concat(fault, again)).otherwise(fault))
    t = t.select(
        "file", F.lit(vocab.TARGET_DOCUMENT_TYPE).alias("document_type"), F.lit("Telangana").alias("state"), F.lit("B").alias("board"), "student_name", "father_name",
        F.when(k % 7 == 0, "").otherwise(F.col("mother_name")).alias("mother_name"), "hall_ticket_number", F.when(k % 8 == 0, 1975).otherwise(F.col("year_of_pass")).alias("year_of_pass"), "month_of_pass",
        F.lit("").alias("course"), F.lit("").alias("group"), F.when(k % 9 == 0, "KLINGON").otherwise(F.col("medium")).alias("medium"), "subjects",
        (F.col("total_marks") + F.when(k % 10 == 0, 1).otherwise(0)).alias("total_marks"), empty.cast("int").alias("maximum_marks"), empty.cast("double").alias("percentage"),
        F.when(k % 6 == 1, F.concat("result", F.lit("."))).otherwise(F.col("result")).alias("result"), F.when(k % 12 == 0, 11.0).alias("cgpa"),
    )
    # every rule reads the records: they are put together once, not rule by rule in one task
    return check_truth(cut_lineage(t)).select("file", "field", "check", "severity")


@query(
    "review_routing",
    """WITH l AS (SELECT c_custkey AS k, greatest(CASE WHEN c_custkey % 13 = 0 THEN 2 WHEN c_custkey % 100 >= 90 THEN 0 WHEN c_custkey % 100 >= 60 THEN 1 ELSE 2 END, CASE WHEN c_custkey % 11 = 0 THEN 2 ELSE 0 END) AS n,
      greatest(CASE WHEN c_custkey % 7 = 0 OR c_custkey % 5 = 0 THEN 1 ELSE 0 END, CASE WHEN c_custkey % 9 = 0 THEN 1 ELSE 0 END) AS s FROM customer)
    SELECT CAST(k AS VARCHAR) AS file, list_extract(['auto', 'review_recommended', 'manual_required'], 1 + greatest(n, s)) AS status, CAST((n > 0)::INT + (s > 0)::INT AS BIGINT) AS n_to_review FROM l""",
)
def review_routing(spark: SparkSession, root: str) -> DataFrame:
    """Two fields per customer with confidences, blanks and issues, routed per field and per document."""
    from folioworks.operators import review

    k = F.col("c_custkey")
    c = table(spark, root, "customer").select(k.cast("string").alias("file"), "c_custkey", "c_name")
    none = F.lit(None).cast("double")
    pairs = F.array(
        F.struct(F.lit("student_name").alias("field"), F.when(k % 13 == 0, "").otherwise(F.col("c_name")).alias("value"), ((k % 100) / 100).alias("confidence")),
        F.struct(F.lit("state").alias("field"), F.when(k % 7 == 0, "").otherwise("Telangana").alias("value"), F.when(k % 5 == 0, none).otherwise(0.95).alias("confidence")),
    )
    values = c.select("file", F.explode(pairs).alias("p")).select("file", "p.*")
    issues = c.where(k % 11 == 0).select("file", F.lit("student_name").alias("field"), F.lit("error").alias("severity")).unionByName(
        c.where(k % 9 == 0).select("file", F.lit("state").alias("field"), F.lit("warning").alias("severity"))
    )
    return review.route_documents(review.route_fields(values, issues))
