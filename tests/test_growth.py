"""What must hold for large tables, told by plans and by many small groups."""

import random

from pyspark.sql import functions as F

from folioworks.operators import decode, identity, split
from folioworks.plans.identity import holders
from folioworks.session import spread_by


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_holders_of_a_small_file_are_dealt_over_tasks(spark):
    assert holders(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4


def test_a_split_of_hundreds_of_group_sizes(spark):
    sizes = list(range(2, 500))
    docs = spark.createDataFrame([(n,) for n in sizes], "n int").select(F.explode(F.sequence(F.lit(1), "n")).alias("i"), F.col("n").cast("string").alias("group"), F.lit("s").alias("stratum"))
    docs = docs.withColumn("file", F.concat_ws("-", "group", "i"))
    n = sum(sizes)
    want = {"train": n - 2 * (n // 10), "validation": n // 10, "test": n // 10}
    got = split.group_split(docs, want).groupBy("partition").agg(F.count("*").alias("n"), F.collect_set("group").alias("g")).collect()
    assert {r["partition"]: r["n"] for r in got} == want
    assert sum(len(r["g"]) for r in got) == len(sizes)


def test_scores_of_a_word_are_settled_without_a_shuffle(spark):
    rng = random.Random(3)
    rows = [("f", 1, w, [(lab, float(rng.randint(0, 3))) for _ in range(2) for lab in ("I-A", "I-B", "O")]) for w in range(200)]
    words = spread_by(spark.createDataFrame(rows, "file string, page int, word_id int, scores array<struct<label:string,logit:double>>"), "file")
    flat = words.select("file", "page", "word_id", F.explode("scores").alias("s")).select("file", "page", "word_id", "s.*")
    want = {r["word_id"]: (r["label"], round(r["p"], 9)) for r in decode.best_labels(decode.word_probabilities(flat)).collect()}
    got = decode.with_best_label(words)
    assert {r["word_id"]: (r["label"], round(r["p"], 9)) for r in got.collect()} == want
    at = got.select("*", F.lit("w").alias("text"), F.lit(0.9).alias("conf"), *[F.lit(0).alias(c) for c in ("line_id", "x0", "y0", "x1", "y1")])
    assert plan_of(decode.decode_spans(at)).count("Exchange ") == 1


def test_rows_per_memo_are_not_sent_through_the_driver(spark):
    kind = "file string, area string, grade string, grade_point int, marks int, words string"
    subjects = spark.createDataFrame([("f", "MA", "A1", 9, None, "")], kind)
    # a table that looks small: what it is guessed at says nothing of the rows made from it
    printed = spark.range(1).select(F.translate(F.col("id").cast("string"), "0", "f").alias("file"), F.lit(9.0).alias("cgpa"), F.lit(None).cast("int").alias("total"))
    flags = identity.check_memos(subjects, printed)
    assert "Broadcast" not in plan_of(flags)
    assert {r["reason"] for r in flags.collect()} == {"grade A1 should carry 10 points", "fewer than six subject rows were read"}


def test_a_surname_like_a_label_is_not_read_and_the_sql_says_so(spark, tmp_path):
    import duckdb

    from folioworks.plans.identity import travel_document_fields
    from folioworks.plans.registry import ORACLE

    # 204187 is DAEBIH, near DATEOFBIRTH; 355074's father is RAM EFFAHE, near NAMEOFFATHER
    rows = [(k, "n", 1, 0.0, "BUILDING") for k in (7, 204187, 204518, 355074)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    want = set(db.execute(ORACLE["travel_document_fields"]).fetchall())
    got = {tuple(r) for r in travel_document_fields(spark, str(tmp_path)).collect()}
    assert got == want and ("doc_204518", "surname", "DAEFBI", False, False) in got


def test_further_pages_of_a_certificate_have_their_role(spark, tmp_path):
    import duckdb

    from folioworks.plans.documents import certificate_page_roles
    from folioworks.plans.registry import ORACLE

    spark.createDataFrame([(k, "n", 1, 0.0, "BUILDING") for k in range(12)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    # as many orders a customer as a copy of the orders over the same customers makes
    spark.range(600).select(F.col("id").alias("o_orderkey"), (F.col("id") * F.col("id") % 12).alias("o_custkey")).write.parquet(str(tmp_path / "orders.parquet"))
    db = duckdb.connect()
    for t in ("customer", "orders"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = dict(db.execute(ORACLE["certificate_page_roles"]).fetchall())
    assert {r["role"]: r["documents"] for r in certificate_page_roles(spark, str(tmp_path)).collect()} == want
    assert want["certificate"] == 4 and want["other"] > 10


def test_scores_are_told_once(spark):
    # a filter on a score must not be pushed below the shuffle before it, where crowded tasks would score every pair first
    from folioworks.operators.align import keys_like
    from folioworks.operators.phrases import phrase_hits
    from folioworks.sources.derived import certificate_lines

    lines = certificate_lines(spark, "/root/testdata/sf0.001")
    assert plan_of(phrase_hits(lines, ["MEMORANDUM OF MARKS", "FATHER S NAME"], ["file"])).count("ArrowEvalPython") == 1
    keys = spark.createDataFrame([("f", "ENGLISHBAA"), ("f", "OTHER")], "file string, key string")
    alike = keys_like(keys, keys.select("file", F.col("key").alias("tkey")))
    assert plan_of(alike).count("ArrowEvalPython") == 1
    assert {(r["key"], r["sim"]) for r in alike.collect()} == {("ENGLISHBAA", 100.0), ("OTHER", 100.0)}


def test_the_prefilter_finds_what_its_pieces_find():
    import re

    from folioworks.functions.similarity import _pieces, phrase_prefilter

    phrases = ["FATHER S NAME", "IN", "INTERMEDIATE", "BOARD OF EDUCATION", "A P", "NOTE"]
    pattern = re.compile(phrase_prefilter(phrases, 88.0))
    pieces = {p for ph in phrases for _, p in _pieces(ph, 88.0)}
    rng = random.Random(5)
    texts = ["".join(rng.choice("ABDEFHINOPRT ") for _ in range(12)) for _ in range(5000)] + phrases
    assert all(bool(pattern.search(x)) == any(p in x for p in pieces) for x in texts)
    assert phrase_prefilter(["MARCHING", "MARCHES"], 100.0) == "MARCH(?:ES|ING)"


def test_common_subsequences_of_any_letters():
    from folioworks.functions.similarity import lcs_lengths

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    rng = random.Random(7)
    for letters in ("ABC", "AB\0é日"):
        pairs = [["".join(rng.choice(letters) for _ in range(rng.randint(0, 70))) for _ in range(2)] for _ in range(300)]
        assert lcs_lengths([a for a, _ in pairs], [b for _, b in pairs]).tolist() == [plain(a, b) for a, b in pairs]


def test_printed_pages_are_dealt_over_tasks_and_nothing_by_customer_is_broadcast(spark):
    from folioworks.operators.layout import visual_rows
    from folioworks.operators.phrases import keyword_hits
    from folioworks.sources import derived

    root = "/root/testdata/sf0.001"
    lines = derived.certificate_lines(spark, root)
    assert "Broadcast" not in plan_of(lines)
    # by number: such a shuffle keeps its partitions however small the orders are
    assert "REPARTITION_BY_NUM" in plan_of(derived.certificate_orders(spark, root))
    assert "REPARTITION_BY_NUM" in plan_of(visual_rows(derived.lines_to_words(lines)))
    some = spark.createDataFrame([("f", 1, 2, "TWO"), ("f", 1, 1, "ONE"), ("f", 2, 1, None), ("f", 3, 1, "THREE"), ("g", 1, 1, None)], "file string, page int, line_id int, text string")
    got = {r["file"]: r["hits"] for r in keyword_hits(some, ["ONE TWO", "TWO THREE", "TWO  THREE"], ["file"]).collect()}
    assert got == {"f": 2, "g": 0}


def test_names_that_meet_are_not_sent_through_the_driver(spark):
    from folioworks.operators import dedup, simjoin

    # guessed at a few bytes, like a file whose names compress well
    names = spark.range(3).select("id", F.array(F.lit(1).cast("long"), F.col("id") + 5).alias("first"), F.array(F.lit(9).cast("long")).alias("second"), F.lit(1).alias("about"))
    for crowd in (100, 1):
        met = simjoin.meeting(names, names, lambda a, b: a == b, crowd=crowd)
        assert "Broadcast" not in plan_of(met)
        assert {(r["a"], r["b"]) for r in met.collect()} == {(0, 1), (0, 2), (1, 2)}
    same = dedup.star_links(spark.range(4).select("id", (F.col("id") % 2).alias("k")), "id", ["k"], "same")
    assert "Broadcast" not in plan_of(same)
    assert {(r["a"], r["b"]) for r in same.collect()} == {(0, 2), (1, 3)}


def test_words_know_their_page_without_a_join(spark):
    from folioworks.plans.sequences import layout_jitter
    from folioworks.sources import derived

    root = "/root/testdata/sf0.001"
    lines = derived.certificate_lines(spark, root)
    assert plan_of(layout_jitter(spark, root)).count("Join") == plan_of(lines).count("Join")
    got = derived.with_page_size(lines).select("file", "page", "width", "height").distinct()
    want = derived.certificate_pages(lines).select("file", "page", "width", "height")
    assert got.count() == want.count() and got.subtract(want).isEmpty()
