import json
import os

from pyspark.sql import functions as F

from folioworks import schemas
from folioworks.operators import layout, tables
from folioworks.operators.assemble import extract_certificates
from folioworks.sources import derived, logs, records
from folioworks.streaming.uploads import UPLOAD, read_page_stream, run_extraction


def page(spark, cells, width=1000, height=800):
    rows = [("f", 1, i, line, text, x, y, x + 10 * len(text), y + 20, 0.9) for i, (line, text, x, y) in enumerate(cells)]
    words = spark.createDataFrame(rows, schemas.WORD)
    pages = spark.createDataFrame([("f", 1, width, height, "certificate")], schemas.PAGE)
    return layout.visual_rows(words), layout.page_skew(words, pages), layout.page_stats(words), pages


def test_sideways_table(spark):
    cells = [(0, "SUBJECT", 60, 100), (1, "ENGLISH", 300, 100), (2, "PHYSICS", 500, 100)]
    for n, (y, year, top, got) in enumerate([(200, "Ist", ("100", "100"), ("47*", "58")), (360, "2nd", ("100", "100"), ("61", "70")), (520, "PRACTICALS", ("30", "30"), ("27", "29"))]):
        cells += [(10 * n + 3, year, 0, y + 20), (10 * n + 4, "Max", 120, y), (10 * n + 4, "Marks", 160, y), (10 * n + 5, top[0], 310, y), (10 * n + 6, top[1], 510, y),
                  (10 * n + 7, "Marks", 120, y + 40), (10 * n + 7, "Secured", 180, y + 40), (10 * n + 8, got[0], 310, y + 40), (10 * n + 9, got[1], 510, y + 40)]
    rows, skew, stats, pages = page(spark, cells)
    out = tables.sideways_rows(rows, pages, skew, stats)
    got = sorted((r["subject_name"], r["paper"], r["marks_text"], r["maximum_text"]) for r in out.collect())
    assert got == sorted([
        ("ENGLISH", "I", "47*", "100"), ("PHYSICS", "I", "58", "100"), ("ENGLISH", "II", "61", "100"), ("PHYSICS", "II", "70", "100"),
        ("ENGLISH PRACTICAL", "II", "27", "30"), ("PHYSICS PRACTICAL", "II", "29", "30")])
    assert tables.plausible_pages(out, True).count() == 1


def test_open_school_table(spark):
    cells = [(0, "Code", 20, 100), (1, "Subject", 120, 100), (2, "Theory", 500, 100), (3, "Practical", 650, 100), (4, "Total", 820, 100)]
    for n, (code, name, th, pr, tot) in enumerate([("302", "ENGLISH", "83", None, "83"), ("312", "PHYSICS", "45", "15", "60"), ("313", "CHEMISTRY", "50", "20", "70")]):
        y = 160 + 60 * n
        cells += [(10 * n + 5, code, 20, y), (10 * n + 6, name, 120, y), (10 * n + 7, th, 510, y), (10 * n + 8, tot, 830, y)]
        if pr:
            cells.append((10 * n + 9, pr, 680, y))
    rows, skew, stats, _ = page(spark, cells)
    out = tables.open_school_rows(rows, skew, stats)
    assert sorted((r["subject_name"], r["marks_text"], r["maximum_text"]) for r in out.collect()) == [("CHEMISTRY", "70", None), ("ENGLISH", "83", None), ("PHYSICS", "60", None)]
    assert tables.plausible_pages(out, False).count() == 1


def put(folder, name, pages):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(p) + "\n" for p in pages))


def stream(spark, tmp_path, extract, tables):
    q = run_extraction(read_page_stream(spark, str(tmp_path / "in"), "1 hour", 1), str(tmp_path / "out"), str(tmp_path / "cp"), extract, tables)
    ended = q.awaitTermination(120)
    q.stop()
    assert ended and q.exception() is None


def test_stream_holds_pages_until_a_file_is_complete(spark, tmp_path):
    page_of = lambda file, page, n: {"file": file, "page": page, "n_pages": n, "width": 10, "height": 10, "rotation": 0, "lines": [{"id": 1, "text": "x y", "bbox": [0, 0, 5, 5], "confidence": 0.9}], "words": []}
    batches = [[page_of("a", 2, 2), page_of("b", 1, 1), page_of("b", 1, 1)], [page_of("a", 2, 2), page_of("c", 1, 2)], [page_of("a", 1, 2), page_of("d", 1, None)], [page_of("b", 1, 1), page_of("a", 1, 2)]]
    for i, pages in enumerate(batches):
        put(tmp_path / "in", f"{i}.json", pages)
        stream(spark, tmp_path, lambda lines, words, pages: {"lines": lines}, ("lines",))
    got = spark.read.parquet(str(tmp_path / "out" / "lines"))
    assert sorted((r["file"], r["page"]) for r in got.collect()) == [("a", 1), ("a", 2), ("b", 1)]
    assert got.where("file = 'a'").select("batch").distinct().count() == 1  # both pages in one batch, though they came in two


def test_stream_gives_up_on_a_file_in_time(spark, tmp_path):
    page_of = lambda file: {"file": file, "page": 1, "n_pages": 2, "width": 10, "height": 10, "rotation": 0, "lines": [{"id": 1, "text": "x", "bbox": [0, 0, 5, 5], "confidence": 0.9}], "words": []}
    for i, name in enumerate("ab"):
        put(tmp_path / "in", f"{i}.json", [page_of(name)])
        os.utime(tmp_path / "in" / f"{i}.json", (1_700_000_000 + 9000 * i,) * 2)  # the second comes two and a half hours later
        stream(spark, tmp_path, lambda lines, words, pages: {"lines": lines}, ("lines",))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out" / "incomplete")).select("file", "pages_read").collect()] == [("a", 1)]


def test_stream_equals_the_batch_extraction(spark, tmp_path):
    lines = derived.certificate_lines(spark, "/root/testdata/sf0.001")
    two = [r.file for r in lines.select("file").distinct().orderBy("file").limit(2).collect()]
    lines = lines.where(F.col("file").isin(two)).withColumn("page", F.when(F.col("line_id") < 20, 1).otherwise(2)).persist()  # the table on a page of its own
    words, sizes = derived.lines_to_words(lines), derived.certificate_pages(lines)
    box = F.array("x0", "y0", "x1", "y1").alias("bbox")
    l = lines.groupBy("file", "page").agg(F.collect_list(F.struct(F.col("line_id").alias("id"), "text", box, F.col("conf").alias("confidence"))).alias("lines"))
    w = words.groupBy("file", "page").agg(F.collect_list(F.struct(F.col("word_id").alias("id"), "line_id", "text", box, F.col("conf").alias("confidence"))).alias("words"))
    n = lines.groupBy("file").agg(F.max("page").alias("n_pages"))
    pages = [json.loads(r[0]) for r in l.join(w, ["file", "page"]).join(sizes.drop("role"), ["file", "page"]).join(n, "file").withColumn("rotation", F.lit(0)).select(F.to_json(F.struct("*"))).collect()]
    assert len(pages) == lines.select("file", "page").distinct().count() == 4
    put(tmp_path / "in", "0.json", [p for p in pages if p["page"] == 1])
    put(tmp_path / "in", "1.json", pages)  # the rest, and the first pages again
    tables = ("values", "subjects", "documents")
    stream(spark, tmp_path, extract_certificates, tables)
    whole = spark.createDataFrame(pages, UPLOAD)
    batch = extract_certificates(records.page_lines(whole), records.page_words(whole), records.page_sizes(whole))
    for t in tables:
        got = spark.read.parquet(str(tmp_path / "out" / t)).select(*batch[t].columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, batch[t].collect())), t


def test_sources_and_logs(spark, tmp_path):
    df = spark.range(10).select("id", F.when(F.col("id") < 7, "train").otherwise("test").alias("partition"))
    assert records.write_counted(df, str(tmp_path / "m"), "json", by=["partition"]) == 10
    assert records.read_manifest(spark, str(tmp_path / "m"), df.select("id").schema, "test").count() == 3
    (tmp_path / "l.jsonl").write_text('{"id": 1}\n\n{"id": oops}\n')
    good, bad = records.read_json_lines(spark, str(tmp_path / "l.jsonl"), df.select("id").schema)
    assert good.count() == 1 and bad.count() == 1
    assert records.pending(df, df.where("id < 4"), "id").count() == 6
    a, b = logs.fingerprint(df).first(), logs.fingerprint(df.repartition(5)).first()
    assert a["hash"] == b["hash"] and a["n_rows"] == 10
    assert logs.log_run(spark, str(tmp_path / "runs"), "x", "baseline", "rules") == "exp_001_x"
    assert logs.log_run(spark, str(tmp_path / "runs"), "y", "baseline", "rules") == "exp_002_y"
    views = spark.createDataFrame([("view", "c", "XXXX XXXX 1234", True)], "event string, client string, number string, check_digit_ok boolean")
    logs.log_number_views(views, str(tmp_path / "views"))
    assert spark.read.parquet(str(tmp_path / "views")).first()["number_last4"] == "1234"


def test_writers_at_the_same_time_get_different_run_numbers(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "runs")
    with ThreadPoolExecutor(4) as pool:
        runs = list(pool.map(lambda i: logs.log_run(spark, path, f"w{i}", "baseline", "rules"), range(8)))
    assert len(set(runs)) == 8
    assert sorted(r["run_no"] for r in logs.read_runs(spark, path).collect()) == list(range(1, 9))
    assert logs.log_run(spark, path, "later", "baseline", "rules") == "exp_009_later"


def test_one_number_is_claimed_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "claims")
    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(lambda _: logs._claim(spark, path, 1), range(64)))
    assert sorted(numbers) == list(range(1, 65))
