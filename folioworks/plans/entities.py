"""Copies, components and splits of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.operators import dedup, graph, split
from folioworks.plans.registry import query
from folioworks.plans.sqltext import lcs_length
from folioworks.session import cut_lineage, table

_CHAIN = "SELECT o_custkey AS a, o_orderkey % (SELECT count(*) FROM customer) AS b FROM orders"


def copies(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return dedup.star_links(d, "doc_id", ["sha256"], "identical file bytes")


@query(
    "entity_components",
    f"""WITH RECURSIVE e AS (SELECT a, b FROM ({_CHAIN}) WHERE a <> b UNION SELECT b, a FROM ({_CHAIN}) WHERE a <> b),
    r(node, seen) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a)
    SELECT node, least(node, min(seen)) AS component FROM r GROUP BY node""",
)
def entity_components(spark: SparkSession, root: str) -> DataFrame:
    """Customers linked by their orders; the smallest customer names the component."""
    n = table(spark, root, "customer").count()
    o = table(spark, root, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % n).alias("b"))
    return graph.connected_components(o)


@query(
    "copy_groups",
    """WITH g AS (SELECT md5(text) AS h, min(doc_id) AS a FROM documents GROUP BY 1)
       SELECT doc_id AS node, a AS component FROM documents JOIN g ON md5(text) = h""",
)
def copy_groups(spark: SparkSession, root: str) -> DataFrame:
    return graph.connected_components(copies(spark, root), nodes=table(spark, root, "documents").select("doc_id"))


@query("near_dup_pairs")
def near_dup_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Links between documents whose whole-text signatures differ in ten bits at most, enough to join every near copy."""
    return dedup.near_copy_links(dedup.text_signature(table(spark, root, "documents"), "doc_id", "text"), "doc_id")


def _word_sets(x: str, y: str, name: str) -> str:
    """SQL columns: the shared words and both full texts, shared words first, of two names."""
    tx, ty = f"list_distinct(string_split({x}, ' '))", f"list_distinct(string_split({y}, ' '))"
    both = f"list_sort(list_intersect({tx}, {ty}))"
    full = lambda one, two: f"array_to_string(list_concat({both}, list_sort(list_filter({one}, lambda w: NOT list_contains({two}, w)))), ' ')"
    return f"array_to_string({both}, ' ') AS {name}0, {full(tx, ty)} AS {name}1, {full(ty, tx)} AS {name}2"


def _sets_agree(n: str, exact: bool) -> str:
    """SQL: the word-set ratio is 90 or more; or, not `exact`, may be by the Levenshtein distance."""
    part = lambda i: f"(length({n}0) > 0 AND 200.0 * length({n}0) >= 90 * (length({n}0) + length({n}{i})))"
    whole = f"200.0 * ({lcs_length(n + '1', n + '2')}) >= 90 * (length({n}1) + length({n}2))" if exact else f"10 * levenshtein({n}1, {n}2) <= length({n}1) + length({n}2)"
    return f"(({n}0 <> '' AND {n}0 IN ({n}1, {n}2)) OR {part(1)} OR {part(2)} OR {whole})"


_CODE = "translate((({}) + 100000)::VARCHAR, '0123456789', 'ABCDEFGHIJ')"
_ENTITY_SQL = f"""WITH RECURSIVE c AS (SELECT c_custkey AS k, c_mktsegment AS seg FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)),
    p AS (SELECT k, CASE WHEN k % 40 < 2 THEN 'SHARED ' || {_CODE.format('k // 40')} WHEN k % 90 = 17 THEN seg WHEN k % 90 = 18 THEN {_CODE.format('k')} || ' K ' || seg ELSE seg || ' ' || {_CODE.format('k')} END AS s,
                 CASE WHEN k % 70 = 9 THEN '' WHEN k % 60 = 30 THEN 'RAMACHANDRA VENKATESWARA ' || {_CODE.format('k // 60')} WHEN k % 60 = 31 THEN 'RAMACHANDRA VENKATESWRA ' || {_CODE.format('k // 60')}
                      WHEN k % 30 < 2 THEN 'RAM ' || {_CODE.format('k // 30')} ELSE 'RAM ' || {_CODE.format('k * 3')} END AS f,
                 CASE WHEN k % 60 IN (30, 31) THEN 'SITAMAHALAKSHMI DEVI ' || {_CODE.format('k // 60')} WHEN k % 30 < 2 THEN 'SITA ' || {_CODE.format('k // 30')} ELSE 'SITA ' || {_CODE.format('k * 7')} END AS m,
                 CASE WHEN k % 50 = 7 THEN k - 1 ELSE k END AS number FROM c),
    same_bytes AS (SELECT min(k) OVER (PARTITION BY s, f, m) AS a, k AS b, 'identical file bytes' AS reason FROM p),
    numbered AS (SELECT min(k) OVER (PARTITION BY number) AS a, k AS b, 'shared registration number' AS reason FROM p),
    copies AS (SELECT min(k) OVER (PARTITION BY s, f) AS a, k AS b, 'student and father names agree' AS reason FROM p),
    reps AS (SELECT s, f, min(k) AS id FROM p GROUP BY s, f),
    both_s AS (SELECT x.id AS i, y.id AS j, x.f AS xf, y.f AS yf, {_word_sets('x.s', 'y.s', 's')} FROM reps x JOIN reps y ON x.id < y.id),
    near_s AS MATERIALIZED (SELECT i, j, xf, yf, s0, s1, s2 FROM both_s WHERE {_sets_agree('s', False)}),
    both_f AS (SELECT *, {_word_sets('xf', 'yf', 'f')} FROM near_s),
    near_f AS MATERIALIZED (SELECT * FROM both_f WHERE xf = '' OR yf = '' OR {_sets_agree('f', False)}),
    near AS (SELECT i AS a, j AS b, 'student and father names agree' AS reason FROM near_f WHERE {_sets_agree('s', True)} AND (xf = '' OR yf = '' OR {_sets_agree('f', True)})),
    person AS MATERIALIZED (SELECT a, b, string_agg(DISTINCT reason, '; ' ORDER BY reason) AS reasons FROM (
        SELECT * FROM same_bytes UNION ALL SELECT * FROM numbered UNION ALL SELECT * FROM copies UNION ALL SELECT * FROM near) WHERE a <> b GROUP BY a, b),
    e AS (SELECT a, b FROM person UNION SELECT b, a FROM person),
    r(node, seen) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a),
    comp AS (SELECT node, min(seen) AS component FROM r GROUP BY node),
    homes AS (SELECT f, m, min(k) AS id FROM p WHERE f <> '' GROUP BY f, m),
    home_pairs AS MATERIALIZED (SELECT x.id AS a, y.id AS b, x.f AS f1, y.f AS f2, x.m AS m1, y.m AS m2 FROM homes x JOIN homes y ON x.id < y.id
        WHERE 20 * levenshtein(x.f, y.f) <= length(x.f) + length(y.f) AND 20 * levenshtein(x.m, y.m) <= length(x.m) + length(y.m)),
    home AS (SELECT a, b FROM home_pairs WHERE 200.0 * ({lcs_length('f1', 'f2')}) >= 95 * (length(f1) + length(f2)) AND 200.0 * ({lcs_length('m1', 'm2')}) >= 95 * (length(m1) + length(m2))
             UNION SELECT a, b FROM (SELECT min(k) OVER (PARTITION BY f, m) AS a, k AS b FROM p WHERE f <> '') WHERE a <> b)
    SELECT a, b, 'same_student' AS relation, reasons FROM person
    UNION ALL SELECT a, b, 'same_parents_different_student', 'both parents'' names match' FROM home h
        LEFT JOIN comp ca ON ca.node = a LEFT JOIN comp cb ON cb.node = b WHERE NOT coalesce(ca.component = cb.component, false)"""


@query("same_entity_links", _ENTITY_SQL)
def same_entity_links(spark: SparkSession, root: str) -> DataFrame:
    """Customers' certificates linked by bytes, number, names and household; the SQL compares all pairs."""
    from folioworks.sources import derived

    t = derived.certificate_truth(spark, root)
    k = F.col("custkey")
    code = lambda n: derived.letters(n.cast("long"))
    say = lambda word, n: F.concat(F.lit(word + " "), code(n))
    segment = F.regexp_replace("student_name", " .*", "")
    people = t.select(
        k, F.when(k % 50 == 7, k - 1).otherwise(k).cast("string").alias("number"),
        F.when(k % 40 < 2, say("SHARED", k / 40)).when(k % 90 == 17, segment).when(k % 90 == 18, F.concat(code(k), F.lit(" K "), segment)).otherwise(F.col("student_name")).alias("student_name"),
        F.when(k % 70 == 9, F.lit(None)).when(k % 60 == 30, say("RAMACHANDRA VENKATESWARA", k / 60)).when(k % 60 == 31, say("RAMACHANDRA VENKATESWRA", k / 60))
        .when(k % 30 < 2, say("RAM", k / 30)).otherwise(F.col("father_name")).alias("father_name"),
        F.when((k % 60).isin(30, 31), say("SITAMAHALAKSHMI DEVI", k / 60)).when(k % 30 < 2, say("SITA", k / 30)).otherwise(F.col("mother_name")).alias("mother_name"),
    )
    people = cut_lineage(people.withColumn("sha256", F.sha2(F.concat_ws("|", F.coalesce("student_name", F.lit("")), F.coalesce("father_name", F.lit("")), "mother_name"), 256)))
    links = dedup.entity_links(people, people.select("custkey", "number"), None, "custkey")
    return links.select("a", "b", "relation", F.array_join("reasons", "; ").alias("reasons"))


def split_documents(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    d = table(spark, root, "documents").select("doc_id", F.col("lang").alias("stratum"))
    g = graph.connected_components(copies(spark, root), nodes=d.select("doc_id")).select(F.col("node").alias("doc_id"), F.col("component").alias("group"))
    docs = cut_lineage(d.join(g, "doc_id"))
    n = docs.count()
    sizes = {"train": n - 2 * (n // 10), "validation": n // 10, "test": n // 10}
    return cut_lineage(split.group_split(docs, sizes, id_="doc_id")), docs, sizes


@query("group_split")
def group_split(spark: SparkSession, root: str) -> DataFrame:
    return split_documents(spark, root)[0].select("doc_id", "group", "stratum", "partition")


@query(
    "split_summary",
    """WITH n AS (SELECT count(*) AS n, count(*) // 10 AS t FROM documents)
       SELECT 'train' AS partition, n - 2 * t AS documents, 0 AS leaks FROM n UNION ALL SELECT 'validation', t, 0 FROM n UNION ALL SELECT 'test', t, 0 FROM n""",
)
def split_summary(spark: SparkSession, root: str) -> DataFrame:
    assigned, docs, _ = split_documents(spark, root)
    leaks = split.split_leaks(assigned, docs, "doc_id").count()
    return assigned.groupBy("partition").agg(F.count("*").alias("documents")).withColumn("leaks", F.lit(leaks))


def households(spark: SparkSession, root: str) -> DataFrame:
    """Documents with the person (equal texts) and the household (texts of one length) that they belong to."""
    d = table(spark, root, "documents").where("text IS NOT NULL").select("doc_id", "n_chars", F.sha2("text", 256).alias("sha256"))
    same, home = dedup.star_links(d, "doc_id", ["sha256"], "identical file bytes"), dedup.star_links(d, "doc_id", ["n_chars"], "equal length")
    return graph.household_components(same, home, d.select("doc_id"))


@query(
    "household_components",
    """SELECT doc_id AS node, min(doc_id) OVER (PARTITION BY md5(text)) AS person, min(doc_id) OVER (PARTITION BY n_chars) AS household FROM documents WHERE text IS NOT NULL""",
)
def household_components(spark: SparkSession, root: str) -> DataFrame:
    return households(spark, root)


@query(
    "household_split_report",
    """WITH d AS (SELECT doc_id, n_chars, md5(text) AS h FROM documents WHERE text IS NOT NULL), k AS (SELECT * FROM d WHERE doc_id % 10 <> 9), n AS (SELECT count(*) AS n, count(*) // 10 AS t FROM k)
       SELECT 'train' AS item, n - 2 * t AS n FROM n UNION ALL SELECT 'validation', t FROM n UNION ALL SELECT 'test', t FROM n
       UNION ALL SELECT 'persons in several partitions', 0 UNION ALL SELECT 'households in several partitions', 0
       UNION ALL SELECT 'households with several members in a partition', (SELECT count(*) FROM (SELECT n_chars FROM k GROUP BY n_chars HAVING count(*) > 1))
       UNION ALL SELECT 'left-out documents linked to a partition', (SELECT count(*) FROM d WHERE doc_id % 10 = 9 AND n_chars IN (SELECT n_chars FROM k))""",
)
def household_split_report(spark: SparkSession, root: str) -> DataFrame:
    """A split that keeps households whole, one document in ten left out of it, and what a leak report says of it."""
    groups = cut_lineage(households(spark, root).withColumnRenamed("node", "doc_id"))
    kept, left_out = groups.where("doc_id % 10 <> 9"), groups.where("doc_id % 10 = 9")
    docs = cut_lineage(kept.join(table(spark, root, "documents").select("doc_id", F.col("lang").alias("stratum")), "doc_id"))
    n = docs.count()
    assigned = cut_lineage(split.group_split(docs.withColumnRenamed("household", "group"), {"train": n - 2 * (n // 10), "validation": n // 10, "test": n // 10}, id_="doc_id"))
    one = lambda item, df: df.agg(F.count("*").alias("n")).select(F.lit(item).alias("item"), "n")
    parts = [
        assigned.groupBy(F.col("partition").alias("item")).agg(F.count("*").alias("n")),
        one("persons in several partitions", split.split_leaks(assigned, groups, "doc_id", "person")),
        one("households in several partitions", split.split_leaks(assigned, groups, "doc_id", "household")),
        one("households with several members in a partition", split.within_partition_groups(assigned.select("doc_id", "partition"), groups, "doc_id", "household")),
        one("left-out documents linked to a partition", split.excluded_links(left_out, assigned.select("doc_id", "partition"), groups, "doc_id", "household")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4])
