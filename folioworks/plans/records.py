"""Record checks, versions, presence, coverage and standardization over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioworks import vocab
from folioworks.functions import dates, stats
from folioworks.functions import text as t
from folioworks.operators import review, rules, truth
from folioworks.operators.standardize import mask_columns, standardize
from folioworks.plans.registry import query
from folioworks.session import cut_lineage, table

_LINE_TOTAL = "cast(round(l_extendedprice * (1 - l_discount) * (1 + l_tax) * 100) as bigint)"


def declared_totals(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Orders with a declared total in cents, wrong for every tenth order, and their lines in cents."""
    lines = table(spark, root, "lineitem").select("l_orderkey", F.expr(_LINE_TOTAL).alias("cents"))
    sums = lines.groupBy("l_orderkey").agg(F.sum("cents").alias("s"))
    orders = table(spark, root, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    off = F.when(F.col("o_orderkey") % 10 == 0, 1).otherwise(0)
    parent = orders.join(sums, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").alias("orderkey"), "o_orderstatus", (F.coalesce("s", F.lit(0)) + off).alias("declared")
    )
    return parent, lines.select(F.col("l_orderkey").alias("orderkey"), "cents")


@query(
    "order_total_reconcile",
    f"""
    WITH l AS (SELECT l_orderkey, {_LINE_TOTAL} AS cents FROM lineitem),
    s AS (SELECT l_orderkey, CAST(sum(cents) AS BIGINT) AS computed, count(*) AS n_rows FROM l GROUP BY 1),
    p AS (SELECT o_orderkey AS orderkey, o_orderstatus,
          coalesce(computed, 0) + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS declared, computed, n_rows
          FROM orders LEFT JOIN s ON o_orderkey = l_orderkey)
    SELECT orderkey, o_orderstatus, declared, computed, n_rows,
      CASE WHEN n_rows IS NULL THEN 'manual_required' WHEN computed <> declared THEN 'review_recommended' ELSE 'auto' END AS route
    FROM p""",
)
def order_total_reconcile(spark: SparkSession, root: str) -> DataFrame:
    parent, child = declared_totals(spark, root)
    return rules.reconcile_totals(parent, child, "orderkey", "declared", "cents")


_ORDER_ISSUES_SQL = """
    WITH j AS (SELECT l.*, o_orderdate FROM lineitem l JOIN orders ON l_orderkey = o_orderkey),
    d AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1),
    i AS (
      SELECT l_orderkey AS orderkey, 'l_shipdate' AS field, 'ships_before_order' AS "check", 'error' AS severity FROM j WHERE l_shipdate < o_orderdate
      UNION ALL SELECT l_orderkey, 'l_discount', 'discount_above_limit', 'warning' FROM j WHERE l_discount > 0.08
      UNION ALL SELECT l_orderkey, 'l_quantity', 'large_quantity', 'info' FROM j WHERE l_quantity >= 45
      UNION ALL SELECT l_orderkey, 'l_linenumber', 'duplicate_row', 'warning' FROM d
      UNION ALL SELECT o_orderkey, 'lines', 'missing', 'error' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))
"""


def order_issues(spark: SparkSession, root: str) -> DataFrame:
    lines = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_discount", "l_quantity")
    orders = table(spark, root, "orders").select("o_orderkey", "o_orderdate")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("orderkey", F.col("l_orderkey"))
    per_row = rules.run_rules(
        rows,
        [
            rules.Rule("l_shipdate", "ships_before_order", "error", F.col("l_shipdate") < F.col("o_orderdate"), "ships before it was ordered"),
            rules.Rule("l_discount", "discount_above_limit", "warning", F.col("l_discount") > 0.08, "discount above the limit"),
            rules.Rule("l_quantity", "large_quantity", "info", F.col("l_quantity") >= 45, "unusually large"),
        ],
        ["orderkey"],
    )
    again = lines.groupBy("l_orderkey", "l_linenumber").count().where("count > 1").withColumnRenamed("l_orderkey", "orderkey")
    repeated = rules.run_rules(again, [rules.Rule("l_linenumber", "duplicate_row", "warning", F.lit(True), "repeated line number")], ["orderkey"])
    empty, _ = truth.presence_checks(orders.withColumnRenamed("o_orderkey", "orderkey"), lines.withColumnRenamed("l_orderkey", "orderkey"), "orderkey")
    missing = rules.run_rules(empty, [rules.Rule("lines", "missing", "error", F.lit(True), "no lines")], ["orderkey"])
    return per_row.unionByName(repeated).unionByName(missing)


@query("order_rules_issues", _ORDER_ISSUES_SQL + 'SELECT orderkey, field, "check", severity FROM i')
def order_rules_issues(spark: SparkSession, root: str) -> DataFrame:
    return order_issues(spark, root).select("orderkey", "field", "check", "severity")


@query(
    "issue_severity_summary",
    _ORDER_ISSUES_SQL
    + """SELECT severity, "check", count(*) AS n FROM i GROUP BY GROUPING SETS ((severity), ("check"), (severity, "check"), ())""",
)
def issue_severity_summary(spark: SparkSession, root: str) -> DataFrame:
    i = order_issues(spark, root)
    return i.groupingSets([["severity"], ["check"], ["severity", "check"], []], "severity", "check").agg(F.count("*").alias("n"))


@query(
    "issue_frequency",
    _ORDER_ISSUES_SQL + """SELECT severity, "check", count(*) AS n FROM i WHERE severity IN ('warning', 'error') GROUP BY 1, 2""",
)
def issue_frequency(spark: SparkSession, root: str) -> DataFrame:
    return rules.issue_summary(rules.flagged(order_issues(spark, root)))


@query(
    "review_queue",
    _ORDER_ISSUES_SQL
    + """, q AS (SELECT orderkey, field, "check", severity, row_number() OVER (PARTITION BY orderkey, "check" ORDER BY field) AS copy FROM i WHERE severity <> 'info')
    SELECT orderkey, field, "check", CASE severity WHEN 'error' THEN 'high' ELSE 'medium' END AS priority,
      'R' || CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END AS id
    FROM (SELECT *, row_number() OVER (ORDER BY orderkey, "check", copy) AS n FROM q)""",
)
def review_queue(spark: SparkSession, root: str) -> DataFrame:
    i = rules.flagged(order_issues(spark, root))
    copy = F.row_number().over(Window.partitionBy("orderkey", "check").orderBy("field"))
    items = i.withColumn("copy", copy).withColumn("priority", F.when(F.col("severity") == "error", "high").otherwise("medium"))
    return review.number_queue(items, [F.col("orderkey"), F.col("check"), F.col("copy")]).select("orderkey", "field", "check", "priority", "id")


@query(
    "presence_checks",
    """SELECT 'document_without_label' AS kind, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
       UNION ALL SELECT 'label_without_document', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""",
)
def presence_checks(spark: SparkSession, root: str) -> DataFrame:
    only_docs, only_labels = truth.presence_checks(table(spark, root, "documents"), table(spark, root, "labels"), "doc_id")
    return only_docs.select(F.lit("document_without_label").alias("kind"), "doc_id").unionByName(
        only_labels.select(F.lit("label_without_document").alias("kind"), "doc_id")
    )


@query(
    "set_operations",
    """SELECT 'both' AS side, doc_id FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)
       UNION ALL SELECT 'documents_only', doc_id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)""",
)
def set_operations(spark: SparkSession, root: str) -> DataFrame:
    d, l = table(spark, root, "documents").select("doc_id"), table(spark, root, "labels").select("doc_id")
    return d.intersect(l).select(F.lit("both").alias("side"), "doc_id").unionByName(d.exceptAll(l).select(F.lit("documents_only").alias("side"), "doc_id"))


@query(
    "incremental_anti",
    "SELECT doc_id, lang, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
)
def incremental_anti(spark: SparkSession, root: str) -> DataFrame:
    from folioworks.sources.records import pending

    return pending(table(spark, root, "documents"), table(spark, root, "labels"), "doc_id").select("doc_id", "lang", "n_chars")


@query(
    "coverage_by_field",
    """WITH j AS (SELECT d.lang, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
       SELECT 'lang' AS field, count(lang) AS n_filled, count(*) AS n_rows FROM j UNION ALL SELECT 'source', count(source), count(*) FROM j
       UNION ALL SELECT 'quality', count(quality), count(*) FROM j UNION ALL SELECT 'toxic', count(toxic), count(*) FROM j""",
)
def coverage_by_field(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "documents").select("doc_id", "lang", "source").join(table(spark, root, "labels"), "doc_id", "left")
    return truth.coverage(d, ["lang", "source", "quality", "toxic"])


@query(
    "dataset_profile",
    """SELECT lang, source, count(*) AS n_documents, CAST(sum(n_chars) AS BIGINT) AS n_chars, count(DISTINCT text) AS n_texts,
       count_if(n_chars < 100) AS n_short, round(avg(n_chars), 4) AS mean_chars FROM documents GROUP BY 1, 2""",
)
def dataset_profile(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "documents")
    return d.groupBy("lang", "source").agg(
        F.count("*").alias("n_documents"), F.sum("n_chars").alias("n_chars"), F.countDistinct("text").alias("n_texts"),
        F.count_if(F.col("n_chars") < 100).alias("n_short"), F.round(F.avg("n_chars"), 4).alias("mean_chars"),
    )


@query(
    "reading_confidence_stats",
    """SELECT user_id, count(*) AS words, round(avg(least(value / 500, 1)), 4) AS mean_confidence,
       count_if(least(value / 500, 1) < 0.8) AS low_confidence FROM events GROUP BY 1""",
)
def reading_confidence_stats(spark: SparkSession, root: str) -> DataFrame:
    from folioworks.operators.layout import confidence_stats

    e = table(spark, root, "events").select("user_id", F.least(F.col("value") / 500, F.lit(1.0)).alias("conf"))
    return confidence_stats(e, ["user_id"])


@query(
    "exact_dup_groups",
    """WITH g AS (SELECT md5(text) AS h, min(doc_id) AS a, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1)
       SELECT a, doc_id AS b, 'identical file bytes' AS reason FROM documents JOIN g ON md5(text) = h WHERE doc_id <> a""",
)
def exact_dup_groups(spark: SparkSession, root: str) -> DataFrame:
    from folioworks.operators.dedup import star_links

    d = table(spark, root, "documents").select("doc_id", F.sha2(F.col("text"), 256).alias("sha256"))
    return star_links(d, "doc_id", ["sha256"], "identical file bytes")


_V2 = "CASE WHEN c_custkey % 7 = 0 THEN 'MACHINERY' WHEN c_custkey % 11 = 0 THEN '' ELSE c_mktsegment END"


def customer_versions(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Customers with blanks, and a later version of the same records."""
    c = table(spark, root, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    v1 = c.withColumn("c_name", F.when(F.col("c_custkey") % 13 == 0, "").otherwise(F.col("c_name")))
    v2 = c.withColumn("c_mktsegment", F.expr(_V2)).withColumn("c_nationkey", F.when(F.col("c_custkey") % 5 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")))
    return v1, v2


@query(
    "version_diff",
    f"""WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN '' ELSE c_name END AS n1, c_name AS n2, c_mktsegment AS m1, {_V2} AS m2,
        CAST(c_nationkey AS VARCHAR) AS k1, CAST(CASE WHEN c_custkey % 5 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS VARCHAR) AS k2 FROM customer),
    u AS (SELECT c_custkey, 'c_name' AS field, n1 AS v1, n2 AS v2 FROM a UNION ALL SELECT c_custkey, 'c_mktsegment', m1, m2 FROM a
          UNION ALL SELECT c_custkey, 'c_nationkey', k1, k2 FROM a)
    SELECT *, CASE WHEN field = 'c_nationkey' THEN 'derived (convention change)' WHEN trim(v1) = '' THEN 'filled' WHEN trim(v2) = '' THEN 'cleared' ELSE 'corrected' END AS kind
    FROM u WHERE v1 IS DISTINCT FROM v2""",
)
def version_diff(spark: SparkSession, root: str) -> DataFrame:
    v1, v2 = customer_versions(spark, root)
    return truth.version_diff(v1, v2, "c_custkey", ["c_name", "c_mktsegment", "c_nationkey"], derived=("c_nationkey",))


@query(
    "override_merge",
    """SELECT c_custkey, c_name || CASE WHEN c_custkey % 4 = 0 THEN ' DECIDED' WHEN c_custkey % 3 = 0 THEN ' DRAFT' ELSE '' END AS c_name,
       CASE WHEN c_custkey % 6 = 0 THEN 'DECIDED' WHEN c_custkey % 3 = 0 THEN 'DRAFT' ELSE c_mktsegment END AS c_mktsegment FROM customer""",
)
def override_merge(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "customer").select("c_custkey", "c_name", "c_mktsegment")
    drafts = c.where("c_custkey % 3 = 0").select("c_custkey", F.concat("c_name", F.lit(" DRAFT")).alias("c_name"), F.lit("DRAFT").alias("c_mktsegment"))
    decided = c.where("c_custkey % 4 = 0").select("c_custkey", F.lit("c_name").alias("field"), F.concat("c_name", F.lit(" DECIDED")).alias("value")).unionByName(
        c.where("c_custkey % 6 = 0").select("c_custkey", F.lit("c_mktsegment").alias("field"), F.lit("DECIDED").alias("value"))
    )
    return truth.merge_overrides(c, drafts, decided, "c_custkey", ["c_name", "c_mktsegment"])


@query(
    "linked_record_conflicts",
    """WITH l AS (SELECT doc_id, md5(text) AS h, n_chars, lang, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS source FROM documents WHERE text IS NOT NULL),
    g AS (SELECT *, count(*) OVER (PARTITION BY h) > 1 AS copied FROM l QUALIFY count(*) OVER (PARTITION BY n_chars) > 1),
    v AS (SELECT doc_id, h, n_chars, copied, 'source' AS field, source AS value FROM g UNION ALL SELECT doc_id, h, n_chars, copied, 'lang', lang FROM g),
    w AS (SELECT * FROM v WHERE value <> ''),
    inner_first AS (SELECT h, field, min(doc_id) AS a, arg_min(value, doc_id) AS first FROM w WHERE copied GROUP BY 1, 2),
    outer_first AS (SELECT n_chars, field, min(doc_id) AS a, arg_min(value, doc_id) AS first, arg_min(h, doc_id) AS first_h FROM w GROUP BY 1, 2)
    SELECT a AS doc_id, w.field, 'error' AS severity, first AS truth_value, CAST(w.doc_id AS VARCHAR) || ' has ' || value AS detail
    FROM w JOIN inner_first f ON w.h = f.h AND w.field = f.field WHERE copied AND value <> first
    UNION ALL
    SELECT a, w.field, 'warning', first, CAST(w.doc_id AS VARCHAR) || ' has ' || value
    FROM w JOIN outer_first f ON w.n_chars = f.n_chars AND w.field = f.field WHERE value <> first AND w.h <> first_h""",
)
def linked_record_conflicts(spark: SparkSession, root: str) -> DataFrame:
    """Texts of one length are linked, copies by their bytes too: source or language that differ inside a group, or between
    copies. One record in three has no source, often the one that all links meet in."""
    from folioworks.operators.dedup import star_links

    d = table(spark, root, "documents").where("text IS NOT NULL")
    equal = exact_dup_groups(spark, root).withColumn("same_bytes", F.lit(True))
    pairs = cut_lineage(equal.unionByName(star_links(d, "doc_id", ["n_chars"], "equal length").withColumn("same_bytes", F.lit(False))))
    d = d.select("doc_id", "lang", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")).alias("source"))
    return truth.conflicts(pairs, d, ["lang", "source"], "doc_id").select("doc_id", "field", "severity", "truth_value", "detail")


# ---- standardization -------------------------------------------------------------------------
@query(
    "standardize_notes",
    r"""WITH s AS (SELECT trim(regexp_replace(' :' || upper(p_name) || '  ;', '\s+', ' ', 'g')) AS ws, ' :' || upper(p_name) || '  ;' AS raw,
        lpad(CAST(p_size AS VARCHAR), 3, '0') || CASE WHEN p_size % 3 = 0 THEN '*' WHEN p_size % 3 = 1 THEN ' P' ELSE 'x' END AS size_text, p_size,
        p_partkey, upper(replace(p_brand, '#', '-')) AS brand FROM part)
    SELECT p_partkey, trim(ws, ' :;.,-_|') AS name, CASE WHEN p_size % 3 = 2 THEN NULL ELSE p_size END AS size,
      CASE WHEN p_size % 3 = 2 THEN 'not an unambiguous integer: ' || size_text
           ELSE 'leading zeros stripped; marker ' || CASE WHEN p_size % 3 = 0 THEN '*' ELSE 'P' END || ' stripped' END AS size_note,
      regexp_replace(brand, '[\s.:\-]', '', 'g') AS code FROM s""",
)
def standardize_notes(spark: SparkSession, root: str) -> DataFrame:
    mark = F.when(F.col("p_size") % 3 == 0, "*").when(F.col("p_size") % 3 == 1, " P").otherwise("x")
    p = table(spark, root, "part").select(
        "p_partkey",
        F.concat(F.lit(" :"), F.upper("p_name"), F.lit("  ;")).alias("name"),
        F.concat(F.lpad(F.col("p_size").cast("string"), 3, "0"), mark).alias("size"),
        F.upper(F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("code"),
    )
    out, _ = standardize(p, {"name": t.strip_name_note, "size": t.to_int_note, "code": t.strip_id_note}, ["p_partkey"])
    return out.select("p_partkey", "name", "size", "size_note", "code")


@query(
    "standardize_note_counts",
    r"""WITH s AS (SELECT CAST(o_totalprice / 1000 AS DECIMAL(12,1)) AS v, o_orderkey FROM orders),
        x AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN CAST(v AS VARCHAR) || '%' WHEN 1 THEN CAST(v AS VARCHAR) ELSE 'n/a' END AS raw, o_orderkey FROM s)
    SELECT 'share' AS "column", CASE o_orderkey % 3 WHEN 0 THEN '''%'' stripped' WHEN 1 THEN '' ELSE 'not an unambiguous number' END AS note, count(*) AS n
    FROM x GROUP BY 2""",
)
def standardize_note_counts(spark: SparkSession, root: str) -> DataFrame:
    v = (F.col("o_totalprice") / 1000).cast("decimal(12,1)").cast("string")
    k = F.col("o_orderkey") % 3
    o = table(spark, root, "orders").select("o_orderkey", F.when(k == 0, F.concat(v, F.lit("%"))).when(k == 1, v).otherwise("n/a").alias("share"))
    _, notes = standardize(o, {"share": t.to_float_note}, ["o_orderkey"])
    return notes


@query(
    "whitespace_keys",
    r"""SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS collapsed, md5(regexp_replace(upper(replace(text, 'ß', 'SS')), '[^A-Z0-9]', '', 'g')) AS match_key,
        md5(trim(regexp_replace(regexp_replace(upper(replace(text, 'ß', 'SS')), '[^A-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))) AS spaced_key,
        regexp_replace(text, '[^0-9]', '', 'g') AS digits FROM documents""",
)
def whitespace_keys(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "documents")
    c = F.col("text")
    return d.select("doc_id", F.md5(t.collapse_ws(c)).alias("collapsed"), F.md5(t.alnum_key(c)).alias("match_key"),
                    F.md5(t.spaced_key(c)).alias("spaced_key"), t.digits_only(c).alias("digits"))


@query(
    "month_year_parse",
    """WITH m AS (SELECT o_orderkey, upper(monthname(o_orderdate)) AS month, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders)
       SELECT o_orderkey, month, year FROM m""",
)
def month_year_parse(spark: SparkSession, root: str) -> DataFrame:
    """Sessions printed in several ways, one of them misspelt, read back."""
    month, year = F.upper(F.date_format("o_orderdate", "MMMM")), F.year("o_orderdate").cast("string")
    k = F.col("o_orderkey") % 5
    raw = (
        F.when(k == 0, F.concat(month, F.lit(" - "), year, F.lit(" (REG)")))
        .when(k == 1, F.concat(F.lit("in"), month, F.lit("-"), year))
        .when(k == 2, F.concat(F.substring(month, 1, 3), F.lit(" "), year))
        .when((k == 3) & (F.length(month) >= 7), F.concat(F.lit("X"), F.expr("substring(upper(date_format(o_orderdate, 'MMMM')), 2)"), F.lit(" "), year))
        .otherwise(F.concat(F.lit("held "), month, F.lit(", "), year))
    )
    o = table(spark, root, "orders").select("o_orderkey", raw.alias("raw"))
    return o.select("o_orderkey", t.parse_month(F.col("raw")).alias("month"), t.parse_year(F.col("raw")).alias("year"))


@query(
    "date_parse",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 6 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS parsed FROM orders""",
)
def date_parse(spark: SparkSession, root: str) -> DataFrame:
    d = "o_orderdate"
    k = F.col("o_orderkey") % 7
    misread = F.translate(F.date_format(d, "dd/MM/yyyy"), "015", "OlS")
    raw = (
        F.when(k < 2, F.concat(F.lit("DOB: "), F.date_format(d, "dd/MM/yyyy")))
        .when(k < 4, F.date_format(d, "d-M-yyyy")).when(k == 4, F.concat(F.lit("on "), F.date_format(d, "d . M . yyyy")))
        .when(k == 5, misread).otherwise(F.concat(F.lit("31/02/"), F.year(d)))
    )
    o = table(spark, root, "orders").select("o_orderkey", raw.alias("raw"))
    return o.select("o_orderkey", dates.parse_date(F.col("raw"), "2026-01-01").cast("string").alias("parsed"))


@query("number_words", "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 8 THEN NULL ELSE CAST(o_orderkey % 10000 AS INTEGER) END AS value FROM orders")
def number_words(spark: SparkSession, root: str) -> DataFrame:
    words = t.spell_digits(F.col("o_orderkey") % 10000, "**")
    raw = F.when(F.col("o_orderkey") % 9 == 8, F.concat(F.lit("GEVEN "), words)).otherwise(F.concat(F.lit("*"), words, F.lit("*")))
    return table(spark, root, "orders").select("o_orderkey", t.parse_number_words(raw).alias("value"))


@query(
    "categorical_map",
    """SELECT c_custkey, CASE c_custkey % 5 WHEN 4 THEN 'unknown value' ELSE c_mktsegment END AS value,
       CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'spacing normalized' WHEN 2 THEN 'fuzzy-mapped (score ' || CAST(round(200.0 * (length(c_mktsegment) - 1) / (2 * length(c_mktsegment) - 1)) AS INTEGER) || ')' WHEN 3 THEN '' ELSE 'not in vocabulary; kept verbatim' END AS note FROM customer""",
)
def categorical_map(spark: SparkSession, root: str) -> DataFrame:
    """Segments printed plainly, spaced out, with a lost letter, with marks, or as something else."""
    seg, k = F.col("c_mktsegment"), F.col("c_custkey") % 5
    raw = (
        F.when(k == 0, F.lower(seg)).when(k == 1, F.concat(F.substring(seg, 1, 3), F.lit(" "), F.expr("substring(c_mktsegment, 4)")))
        .when(k == 2, F.concat(F.substring(seg, 1, 2), F.expr("substring(c_mktsegment, 4)"))).when(k == 3, F.concat(seg, F.lit(" .")))
        .otherwise("unknown  value")
    )
    entries = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    c = table(spark, root, "customer").select("c_custkey", t.categorical_note(raw, entries).alias("r"))
    return c.select("c_custkey", F.col("r.value").alias("value"), F.col("r.note").alias("note"))


@query(
    "pattern_mask",
    r"""WITH d AS (SELECT doc_id, regexp_extract_all(text, '\d{8,}') AS runs FROM documents)
        SELECT doc_id, 'XXXX XXXX ' || right(r, 4) AS masked FROM (SELECT doc_id, unnest(runs) AS r FROM d)""",
)
def pattern_mask(spark: SparkSession, root: str) -> DataFrame:
    runs = F.regexp_extract_all("text", F.lit(r"(\d{8,})"), 1)
    d = table(spark, root, "documents").select("doc_id", F.explode(runs).alias("masked"))
    return mask_columns(d, ["masked"])


@query(
    "canonical_boards",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'TSBIE' WHEN 1 THEN 'BIEAP' WHEN 2 THEN 'BIEAP' ELSE 'Elsewhere' END AS board_id,
       CASE c_custkey % 4 WHEN 0 THEN 'Telangana' WHEN 3 THEN NULL ELSE 'Andhra Pradesh' END AS state,
       CASE WHEN c_custkey % 2 = 0 THEN 'intermediate' ELSE 'other' END AS kind FROM customer""",
)
def canonical_boards(spark: SparkSession, root: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    name = F.when(k == 0, vocab.TS_STATE_BOARD).when(k == 1, vocab.AP_BOARD).when(k == 2, vocab.AP_BOARD_SHORT).otherwise("Elsewhere")
    kind = F.when(F.col("c_custkey") % 2 == 0, vocab.TARGET_DOCUMENT_TYPE).otherwise("Ledger")
    return table(spark, root, "customer").select("c_custkey", t.board_id(name).alias("board_id"), t.board_state(name).alias("state"), t.document_kind(kind).alias("kind"))


@query(
    "name_suspicion_reasons",
    r"""WITH n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN 'THIS IS ' || upper(p_name) WHEN 2 THEN upper(p_name) || ' X' ELSE upper(p_name) || ' 7' END AS v FROM part)
    SELECT p_partkey, concat_ws(' | ',
      CASE WHEN p_partkey % 4 = 1 THEN 'contains certificate template words' END,
      CASE WHEN p_partkey % 4 = 3 THEN 'contains digits or punctuation' END,
      CASE WHEN p_partkey % 4 = 2 THEN 'ends with a very short token X' WHEN p_partkey % 4 = 3 THEN 'ends with a very short token 7' END) AS reasons FROM n""",
)
def name_suspicion_reasons(spark: SparkSession, root: str) -> DataFrame:
    n, k = F.upper("p_name"), F.col("p_partkey") % 4
    v = F.when(k == 0, n).when(k == 1, F.concat(F.lit("THIS IS "), n)).when(k == 2, F.concat(n, F.lit(" X"))).otherwise(F.concat(n, F.lit(" 7")))
    return table(spark, root, "part").select("p_partkey", F.array_join(t.name_suspicions(v), " | ").alias("reasons"))


@query(
    "noisy_or",
    """SELECT user_id, round(1 - exp(sum(ln(1 - value / 1000))), 6) AS any_reading, round(min(value / 1000), 6) AS weakest,
       round(max(value / 1000), 6) AS strongest FROM events GROUP BY 1""",
)
def noisy_or(spark: SparkSession, root: str) -> DataFrame:
    p = F.col("value") / 1000
    return table(spark, root, "events").groupBy("user_id").agg(
        F.round(stats.noisy_or_agg(p), 6).alias("any_reading"), F.round(F.min(p), 6).alias("weakest"), F.round(F.max(p), 6).alias("strongest")
    )


@query(
    "subject_set_group",
    """WITH s AS (SELECT user_id, list(DISTINCT event_type) AS types, count(*) AS n FROM events GROUP BY 1)
       SELECT user_id, CASE WHEN list_has_all(types, ['error', 'signup', 'view']) THEN 'ESV' WHEN list_has_all(types, ['click', 'purchase']) THEN 'CP' ELSE '' END AS group_name FROM s""",
)
def subject_set_group(spark: SparkSession, root: str) -> DataFrame:
    from folioworks.operators.assemble import first_held_set

    e = table(spark, root, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("types"))
    return e.select("user_id", first_held_set(F.col("types"), [("ESV", ["error", "signup", "view"]), ("CP", ["click", "purchase"])]).alias("group_name"))
