from pyspark.sql import functions as F

from folioworks import schemas, vocab
from folioworks.operators import align, assemble, metrics, truth


def record(file, name="A BCDE", subjects=(("MATHEMATICS A", "I", 50, 100), ("PHYSICS", "I", 60, 100), ("CHEMISTRY", "I", 40, 100)), total=150):
    return (file, vocab.TARGET_DOCUMENT_TYPE, "Telangana", "B", name, "C DEFG", "E FGHI", "1234567890", 2020, "MARCH", "", "", "ENGLISH", list(subjects), total, None, None, "PASSED.", None)


def test_build_version(spark):
    base = spark.createDataFrame([record("a"), record("b", subjects=())], schemas.TRUTH)
    decisions = spark.createDataFrame([("a", "student_name", "NEW NAME")], "file string, field string, value string")
    edits = spark.createDataFrame(
        [("b", None, "a", {0: "MATHEMATICS B"}, None, None, None, None)],
        schemas.T.StructType([
            schemas.T.StructField("file", schemas.T.StringType()), schemas.T.StructField("replace", schemas.T.ArrayType(schemas.SUBJECT)), schemas.T.StructField("copy_from", schemas.T.StringType()),
            schemas.T.StructField("rename", schemas.T.MapType(schemas.T.IntegerType(), schemas.T.StringType())), schemas.T.StructField("marks", schemas.T.MapType(schemas.T.IntegerType(), schemas.T.IntegerType())),
            schemas.T.StructField("maxima", schemas.T.MapType(schemas.T.IntegerType(), schemas.T.IntegerType())), schemas.T.StructField("add", schemas.T.ArrayType(schemas.SUBJECT)), schemas.T.StructField("all_maximum", schemas.T.IntegerType()),
        ]),
    )
    out = truth.build_version(base, base, decisions, edits)
    got = {r["file"]: r for r in out["records"].collect()}
    assert got["a"]["student_name"] == "NEW NAME" and got["a"]["maximum_marks"] == 300 and got["a"]["percentage"] == 50.0 and got["a"]["group"] == "MPC"
    assert got["b"]["subjects"][0]["subject_name"] == "MATHEMATICS B" and got["a"]["result"] == "PASSED"
    kinds = {(r["file"], r["field"]): r["kind"] for r in out["changes"].collect()}
    assert kinds[("a", "student_name")] == "corrected" and kinds[("b", "subjects")] == "filled" and kinds[("a", "maximum_marks")] == "derived"
    assert out["problems"].count() == 0


def test_evaluation_report(spark):
    t = spark.createDataFrame([record("a"), record("b")], schemas.TRUTH)
    p = t.withColumn("student_name", F.when(F.col("file") == "b", "").otherwise(F.col("student_name")))
    issues = spark.createDataFrame([], schemas.ISSUE)
    al = spark.createDataFrame([("b", "STUDENT_NAME", "accepted", None, None)], "file string, field string, status string, label_value string, suggestion string")
    sup = spark.createDataFrame([("a", True), ("b", True)], "file string, supported boolean")
    r = metrics.evaluation_report(t, p, issues, al, sup, "validation")
    assert [(x["category"], x["n"]) for x in r["categories"].collect()] == [("layout_error", 1)]
    name = r["fields"].where("field = 'student_name' and subset = 'all'").first()
    assert (name["n_annotated"], name["n_predicted"], name["exact_match"]) == (2, 1, 1)


def test_fallback_only_when_it_adds_up(spark):
    rows = "file string, pos int, marks int"
    a = spark.createDataFrame([("a", 0, 10), ("b", 0, 10)], rows)
    b = spark.createDataFrame([("a", 0, 30), ("b", 0, 99)], rows)
    totals = spark.createDataFrame([("a", 30), ("b", 50)], "file string, total_marks int")
    got = {r["file"]: r["marks"] for r in assemble.prefer_fallback(a, b, totals).collect()}
    assert got == {"a": 30, "b": 10}


def test_word_labels(spark):
    words = spark.createDataFrame([("f", 1, i, 1, x, 0.0 + y) for i, x, y in [(1, "RAVI", 10), (2, "KUMAR", 10), (3, "NOTE", 40), (4, "55", 90), (5, "60", 90)]], "file string, page int, word_id int, row_id int, text string, cy double")
    fields = spark.createDataFrame([("f", "STUDENT_NAME", "accepted", 1, [1, 2]), ("f", "RESULT", "review", 1, [3])], "file string, field string, status string, page int, word_ids array<int>")
    subjects = spark.createDataFrame([("f", "not_found", None, None, None, None)], "file string, status string, page int, word_ids array<int>, max_id int, mark_id int")
    bands = spark.createDataFrame([("f", 1, 80.0, 100.0)], "file string, page int, top double, bottom double")
    got = {r["word_id"]: r["label"] for r in align.word_labels(words, fields, subjects, bands, spark.createDataFrame([], "file string")).collect()}
    assert got == {1: "B-STUDENT_NAME", 2: "I-STUDENT_NAME", 3: "IGNORE", 4: "IGNORE", 5: "IGNORE"}
