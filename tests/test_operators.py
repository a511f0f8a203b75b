import random

import pytest
from pyspark.sql import functions as F

from folioworks import schemas, vocab
from folioworks.operators import assemble, dedup, graph, layout, matching, metrics, review, split, tables, truth
from folioworks.operators.ranking import number_rows


def test_number_rows(spark):
    df = spark.range(1000).select(F.xxhash64("id").alias("h"), "id")
    got = [r["rank"] for r in number_rows(df, [F.col("h"), F.col("id")]).orderBy("h").collect()]
    assert got == list(range(1, 1001))


def test_greedy_match_equals_one_at_a_time(spark):
    rnd = random.Random(5)
    edges = [(g, i, j, float(rnd.randint(0, 6))) for g in ("a", "b") for i in range(8) for j in range(8) if rnd.random() < 0.6]
    want = set()
    for g in ("a", "b"):
        used_i, used_j = set(), set()
        for s, i, j in sorted(((e[3], e[1], e[2]) for e in edges if e[0] == g), reverse=True):
            if i not in used_i and j not in used_j:
                used_i.add(i)
                used_j.add(j)
                want.add((g, i, j))
    df = spark.createDataFrame(edges, "g string, i int, j int, score double")
    got = {(r["g"], r["i"], r["j"]) for r in matching.greedy_match(df, ["g"], "i", "j", "score").collect()}
    assert got == want


def test_best_non_overlapping(spark):
    rnd = random.Random(7)
    spans = [("g", s, s + rnd.randint(0, 3), float(rnd.randint(0, 9)), k) for k, s in enumerate(rnd.sample(range(60), 40))]
    want, taken = set(), set()
    for _, s, e, v, k in sorted(spans, key=lambda x: (-x[3], x[4])):
        if not taken & set(range(s, e + 1)):
            taken |= set(range(s, e + 1))
            want.add(k)
    df = spark.createDataFrame(spans, "g string, s int, e int, v double, k int")
    got = {r["k"] for r in matching.best_non_overlapping(df, ["g"], "s", "e", [-F.col("v"), F.col("k")]).collect()}
    assert got == want


def _greedy_spans(spans):
    """Brute force: (group, start, stop, value, id) by value, then id; a span goes in when it meets none that is in."""
    taken, want = {}, set()
    for g, s, e, v, k in sorted(spans, key=lambda x: (-x[3], x[4])):
        if s is not None and e is not None and s <= e and not taken.setdefault(g, set()) & set(range(s, e + 1)):
            taken[g] |= set(range(s, e + 1))
            want.add(k)
    return want


@pytest.mark.parametrize("seed,fold,chunk", [(2, 16, 64), (4, 32, 1000)])
def test_best_non_overlapping_large_islands(spark, seed, fold, chunk):
    rnd = random.Random(seed)
    spans = []
    for k in range(300):
        g, s = rnd.choice(["a", "b", None]), rnd.randint(0, 400)
        spans.append((g, s, s + rnd.choice([0, 1, 3, 5, 9, 200 if k % 40 == 0 else 2]), float(rnd.randint(0, 5)), k))
    spans += [("stairs", s, s + 4, 1.0, 1000 + s) for s in range(120)]  # equal values: a chain from left to right
    spans += [("a", None, 5, 9.0, 2000), ("a", 7, None, 9.0, 2001), ("a", 9, 3, 9.0, 2002)]
    df = spark.createDataFrame(spans, "g string, s int, e int, v double, k int")
    got = matching.best_non_overlapping(df, ["g"], "s", "e", [-F.col("v"), F.col("k")], fold=fold, chunk=chunk)
    rows = [r["k"] for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == _greedy_spans(spans)
    assert got.columns == df.columns
    assert matching.best_non_overlapping(df.where("false"), ["g"], "s", "e", [F.col("k")], fold=fold).count() == 0


def test_best_non_overlapping_chain_over_chunks(spark):
    """One island, every span meets the next, and the left one of two is better: thousands of spans in a few rounds."""
    n = 20_000
    df = spark.range(n).select(F.lit("x").alias("g"), (F.col("id") * 2).alias("s"), (F.col("id") * 2 + 3).alias("e"), "id")
    got = matching.best_non_overlapping(df, ["g"], "s", "e", [F.col("s")], chunk=8_000)
    row = got.agg(F.count("*").alias("n"), F.max(F.col("id") % 2).alias("odd")).first()
    assert (row["n"], row["odd"]) == (n // 2, 0)


def test_components_name_the_smallest(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in (101, 102, 103)] + [(200, 201)]
    nodes = spark.createDataFrame([(n,) for n in [*range(0, 41), 100, 101, 102, 103, 200, 201, 300]], "n long")
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in graph.connected_components(df, nodes=nodes).collect()}
    assert got[40] == 0 and got[103] == 100 and got[201] == 200 and got[300] == 300


def test_near_copies_join_like_all_pairs(spark):
    rnd = random.Random(11)
    base = [rnd.getrandbits(256) for _ in range(12)]
    sigs = []
    for b in base:
        for _ in range(12):
            x = b
            for bit in rnd.sample(range(256), rnd.randint(0, 8)):
                x ^= 1 << bit
            sigs.append(x)
    signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    rows = [(i, *[signed((s >> (64 * w)) & ((1 << 64) - 1)) for w in range(4)]) for i, s in enumerate(sigs)]
    parent = list(range(len(sigs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sigs)):
        for j in range(i):
            if (sigs[i] ^ sigs[j]).bit_count() <= 10:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(rows, "id long, s0 long, s1 long, s2 long, s3 long").withColumnRenamed("id", "doc")
    nodes = df.select("doc")
    got = {r["node"]: r["component"] for r in graph.connected_components(dedup.near_copy_links(df, "doc"), nodes=nodes).collect()}
    assert got == {i: find(i) for i in range(len(sigs))}


def test_split_is_exact_whole_and_repeatable(spark):
    docs = [(f"d{i}.pdf", f"g{i // 2}" if i < 6 else f"g{i}", "s" + str(i % 2)) for i in range(20)]
    df = spark.createDataFrame(docs, "file string, group string, stratum string")
    sizes = {"train": 14, "validation": 3, "test": 3}
    a = {r["file"]: r["partition"] for r in split.group_split(df, sizes, 1).collect()}
    b = {r["file"]: r["partition"] for r in split.group_split(df.repartition(7), sizes, 1).collect()}
    assert a == b and len(a) == 20
    assert {k: list(a.values()).count(k) for k in sizes} == sizes
    for g in {d[1] for d in docs}:
        assert len({a[f] for f, gg, _ in docs if gg == g}) == 1
    assert split.split_leaks(spark.createDataFrame(list(a.items()), "file string, partition string"), df).count() == 0
    with pytest.raises(ValueError):
        split.group_split(df, {"train": 3}, 1)
    with pytest.raises(ValueError):
        split.training_rows(df.withColumn("partition", F.lit("x")), "test")


def test_truth_rules_flag_and_keep(spark):
    rec = ("x.pdf", vocab.TARGET_DOCUMENT_TYPE, "Telangana", "B", "THIS TO CERTY TAT SOME NAME", "C D", "E F", "", 2020, "MARCH", "", "", "",
           [("ENGLISH", "I", 50, 100), ("ENGLISH", "II", 60, 100)], 111, 100, None, "PASSED", None)
    df = spark.createDataFrame([rec], schemas.TRUTH)
    checks = {r["check"] for r in truth.check_truth(df).collect()}
    assert {"subject_sum_mismatch", "maximum_below_total", "name_ocr_residue", "missing_value"} <= checks
    assert "schema_keys" not in checks and "duplicate_subject_row" not in checks
    assert df.first()["total_marks"] == 111


WORDS = [
    (0, 1, "I", 500, 50, 520, 70), (1, 1, "Year", 525, 50, 580, 70), (2, 2, "II", 800, 50, 825, 70), (3, 2, "Year", 830, 50, 885, 70),
    (4, 3, "ENGLISH", 100, 100, 250, 120), (5, 4, "100", 450, 100, 490, 120), (6, 5, "47*", 600, 100, 640, 120), (7, 6, "100", 750, 100, 790, 120),
    (8, 7, "71", 900, 100, 930, 120), (9, 8, "PHYSICS", 100, 150, 240, 170), (10, 8, "PRACTICALS", 245, 150, 400, 170),
    (11, 9, "30", 750, 150, 780, 170), (12, 10, "27", 900, 150, 930, 170),
]


def test_tables_with_year_headers(spark):
    words = spark.createDataFrame([("f", 1, i, l, x, a, b, c, d, 0.99) for i, l, x, a, b, c, d in WORDS], schemas.WORD)
    pages = spark.createDataFrame([("f", 1, 1000, 400, "certificate")], schemas.PAGE)
    rows, stats, skew = layout.visual_rows(words), layout.page_stats(words), layout.page_skew(words, pages)
    boundary = tables.year_boundary(rows).first()
    assert boundary["axis"] == "x" and 580 < boundary["at"] < 800
    by = {w[0]: w for w in WORDS}
    cell = lambda label, *ids: ("f", 1, label, list(ids), " ".join(by[i][2] for i in ids), min(by[i][3] for i in ids), min(by[i][4] for i in ids), max(by[i][5] for i in ids), max(by[i][6] for i in ids), 0.99, 0.9)
    cells = spark.createDataFrame(
        [cell("SUBJECT", 4), cell("SUBJECT", 9, 10), cell("MAX_MARKS", 5), cell("MAX_MARKS", 7), cell("MAX_MARKS", 11), cell("MARKS", 6), cell("MARKS", 8), cell("MARKS", 12)],
        "file string, page int, label string, word_ids array<int>, text string, x0 int, y0 int, x1 int, y1 int, conf double, confidence double",
    )
    got = tables.reconstruct(cells, words, skew, stats, tables.year_boundary(rows))
    assert sorted((r["subject_name"], r["paper"], r["marks_text"], r["maximum_text"]) for r in got.collect()) == [
        ("ENGLISH", "I", "47*", "100"), ("ENGLISH", "II", "71", "100"), ("PHYSICS PRACTICALS", "II", "27", "30")]


def _brute_rows(words):
    rows = []
    for w in sorted(words, key=lambda w: ((w[4] + w[6]) / 2, w[0])):
        for r in rows:
            a, b = min(x[4] for x in r), max(x[6] for x in r)
            if max(0, min(b, w[6]) - max(a, w[4])) / max(1, min(b - a, w[6] - w[4])) >= 0.5 and abs(a + b - w[4] - w[6]) / 2 < max(b - a, w[6] - w[4]):
                r.append(w)
                break
        else:
            rows.append([w])
    return {frozenset(x[0] for x in r) for r in rows}


def test_visual_rows_equal_the_greedy_growth(spark):
    rnd = random.Random(2)
    words = []
    for i in range(300):
        y, x = rnd.randint(0, 1500), rnd.randint(0, 900)
        words.append((i, i, f"w{i}", x, y, x + 40, y + rnd.randint(8, 30)))
    df = spark.createDataFrame([("f", 1, i, l, x, a, b, c, d, 0.9) for i, l, x, a, b, c, d in words], schemas.WORD)
    got = {frozenset(r["w"]) for r in layout.visual_rows(df).groupBy("row_id").agg(F.collect_list("word_id").alias("w")).collect()}
    assert got == _brute_rows(words)


def test_review_routes(spark):
    values = spark.createDataFrame([("a", "student_name", "X", 0.95), ("a", "total_marks", None, None), ("a", "state", "", None), ("b", "result", "PASSED", 0.7), ("c", "group", "", None)], "file string, field string, value string, confidence double")
    issues = spark.createDataFrame([("b", "result", "x", "error", None, "", "open")], schemas.ISSUE)
    got = {(r["file"], r["field"]): r["level"] for r in review.route_fields(values, issues).collect()}
    assert got == {("a", "student_name"): "auto", ("a", "total_marks"): "manual_required", ("a", "state"): "review_recommended", ("b", "result"): "manual_required", ("c", "group"): "auto"}


def test_subject_matching_and_rates(spark):
    t_ = spark.createDataFrame([("f", 0, "ENGLISH", "I", 47, 100), ("f", 1, "ENGLISH", "II", 71, 100), ("f", 2, "PHYSICS PRACTICALS", "II", 27, 30)], "file string, pos int, subject_name string, paper string, marks int, maximum_marks int")
    p = spark.createDataFrame([("f", 0, "ENGLISH", "II", 71, 100), ("f", 1, "ENGL1SH", "I", 47, 100), ("f", 2, "PHYSICS PRACTICAL", "II", 27, 30)], t_.schema)
    m = metrics.match_subject_rows(t_, p)
    assert {(r["i"], r["j"]) for r in m.collect()} == {(0, 1), (1, 0), (2, 2)}
    s = {r["subset"]: r for r in metrics.subject_metrics(m, p).collect()}["all"]
    assert (s["name_ok"], s["complete_row"], s["truth_rows"], s["row_precision"]) == (2, 2, 3, 1.0)


def test_flat_keys_in_order():
    assert vocab.FLAT_KEYS[:3] == ["file", "document_type", "state"] and vocab.FLAT_KEYS[-1] == "notes"
    assert vocab.FLAT_KEYS.index("subjects") == vocab.FLAT_KEYS.index("medium") + 1


def test_vote_prefers_a_passing_reading(spark):
    df = spark.createDataFrame([("d", "111", 0.9), ("d", "111", 0.8), ("d", "222", 0.7)], "file string, number string, conf double")
    got = assemble.vote(df, ["file"], "number", [F.col("number") == "222", F.col("votes")]).first()
    assert got["number"] == "222" and got["votes"] == 1


def test_split_places_larger_groups_first(spark):
    docs = [(f"d{i}.pdf", "a" if i < 14 else "b" if i < 17 else "c", "s") for i in range(20)]
    df = spark.createDataFrame(docs, "file string, group string, stratum string")
    for seed in range(5):
        got = split.group_split(df, {"train": 14, "validation": 3, "test": 3}, seed).collect()
        assert {r["group"]: r["partition"] for r in got if r["group"] == "a"} == {"a": "train"}
        assert sorted(r["partition"] for r in got if r["group"] != "a") == ["test"] * 3 + ["validation"] * 3


def test_split_mixes_strata_of_groups(spark):
    docs = [(f"d{i}.pdf", f"g{i // 2}", f"s{i // 2 % 4}") for i in range(160)]
    df = spark.createDataFrame(docs, "file string, group string, stratum string")
    got = split.group_split(df, {"train": 96, "validation": 32, "test": 32}, 3)
    counts = {(r["partition"], r["stratum"]): r["n"] for r in split.split_summary(got).collect()}
    assert all(counts[p, f"s{k}"] == n for p, n in (("train", 24), ("validation", 8), ("test", 8)) for k in range(4))


def test_conflicts_are_not_hidden_by_a_blank_hub(spark):
    pairs = spark.createDataFrame([(1, 2, True), (1, 3, False)], "a long, b long, same_bytes boolean")
    df = spark.createDataFrame([(1, "", "k"), (2, "X", "k"), (3, "Y", "k")], "id long, name string, other string")
    got = [tuple(r) for r in truth.conflicts(pairs, df, ["name", "other"], "id").select("id", "field", "severity", "truth_value", "detail").collect()]
    assert got == [(2, "name", "warning", "X", "3 has Y")]


def test_conflicts_at_two_levels(spark):
    pairs = spark.createDataFrame([(1, 2, False), (1, 3, False), (2, 3, True), (4, 5, True), (3, 4, False)], "a long, b long, same_bytes boolean")
    df = spark.createDataFrame([(1, "X"), (2, "Y"), (3, "Z"), (4, "X"), (5, "W")], "id long, name string")
    got = sorted(tuple(r) for r in truth.conflicts(pairs, df, ["name"], "id").select("id", "severity", "truth_value", "detail").collect())
    assert got == [(1, "warning", "X", "2 has Y"), (1, "warning", "X", "3 has Z"), (1, "warning", "X", "5 has W"), (2, "error", "Y", "3 has Z"), (4, "error", "X", "5 has W")]


def test_households_are_components_of_persons(spark):
    person = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a long, b long")
    home = spark.createDataFrame([(3, 6), (1, 3), (8, 9), (6, 3)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in range(1, 11)], "id long")
    got = {r.node: (r.person, r.household) for r in graph.household_components(person, home, nodes).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 1), 4: (4, 4), 5: (5, 1), 6: (5, 1), 7: (7, 7), 8: (8, 8), 9: (9, 8), 10: (10, 10)}


def test_a_boundary_between_stops_the_value_above(spark):
    from folioworks.operators.identity import nearest_above

    rows = [("f", 1, 1, "ABOVE", 100, 100, 200, 130, False), ("f", 1, 2, "LABEL", 100, 140, 200, 170, True), ("f", 1, 3, "ASIDE", 700, 150, 800, 180, False), ("f", 1, 4, "NEAR", 110, 150, 200, 185, False)]
    lines = spark.createDataFrame(rows, "file string, page int, line_id int, text string, x0 int, y0 int, x1 int, y1 int, boundary boolean").withColumn("conf", F.lit(0.9)).withColumn("h", F.lit(30.0))
    anchor = spark.createDataFrame([("f", 1, 9, 100, 190, 200, 30.0)], "file string, page int, a_line_id int, a_x0 int, a_y0 int, a_x1 int, a_h double")
    assert [r.v.text for r in nearest_above(anchor, lines).collect()] == ["NEAR"]
    assert nearest_above(anchor, lines.where("line_id <> 4")).count() == 0  # the label stands between


def test_other_nationalities_stay(spark):
    from folioworks.operators.identity import clean_value

    df = spark.createDataFrame([("ITALIAN",), ("CANADIAN",), ("INDIAM",), ("INDAN",), ("IND",), ("",)], "v string")
    assert [r[0] for r in df.select(clean_value(F.lit("nationality"), F.col("v"))).collect()] == ["ITALIAN", "CANADIAN", "INDIAN", "INDIAN", "INDIAN", ""]


def test_a_record_without_a_father_links_to_every_near_name(spark):
    people = spark.createDataFrame(
        [(1, "RAMESH PRASAD", ""), (2, "RAMESH KUMAR", ""), (3, "RAMESH KUMAAR", "VENKAT RAO")], "id long, student_name string, father_name string"
    )
    got = {(r["a"], r["b"]) for r in dedup.same_name_links(people, "id").select("a", "b").collect()}
    assert got == {(2, 3)}
