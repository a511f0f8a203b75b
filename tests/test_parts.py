import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from folioworks.plans import alignment, documents
from folioworks.session import cut_lineage, in_parts, of_part
from folioworks.sources import derived

ROOT = "/root/testdata/sf0.001"


def folders(spark):
    cut_lineage(spark.range(1))
    top = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    return {f"{d}/{x}" for d, names, _ in os.walk(top) for x in names if x.startswith("rdd-")}


def test_a_part_leaves_its_rows_and_no_checkpoints(spark):
    before = folders(spark)

    def make(part):
        mine = cut_lineage(spark.range(100).where(of_part(F.col("id"), part)))
        return cut_lineage(mine.withColumn("x", F.array(F.col("id"), F.lit(None))))

    got = in_parts(spark, 4, make)
    # the one that `folders` makes itself
    assert len(folders(spark) - before) <= 1
    assert sorted((r.id, r.x) for r in got.collect()) == [(i, [i, None]) for i in range(100)]


def test_parts_of_the_certificates_are_all_of_them(spark):
    whole = derived.certificate_lines(spark, ROOT)
    parts = [derived.certificate_lines(spark, ROOT, (i, 3)) for i in range(3)]
    assert all(p.count() > 0 for p in parts)
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    assert both.exceptAll(whole).isEmpty() and both.count() == whole.count()


#: Queries that read every printed page, and the module that makes a part of them.
IN_PARTS = {"align_truth": alignment, "align_subject_rows": alignment, "annotation_review_queue": alignment, "truth_suggestions": alignment, "review_queue_summary": alignment, "table_rows": documents, "extract_certificates": documents, "certificate_classes": documents, "certificate_page_roles": documents}


@pytest.mark.parametrize("name", IN_PARTS)
def test_pages_are_read_a_part_at_a_time(spark, monkeypatch, name):
    asked = []

    class Done(Exception):
        pass

    def instead(spark, n, make):
        asked.append(n)
        raise Done

    # classes leave less on disk, and are read eight times as many at once
    monkeypatch.setattr(derived, "PART_ORDERS", 90 if name.startswith("certificate_") else 700)
    monkeypatch.setattr(IN_PARTS[name], "in_parts", instead)
    with pytest.raises(Done):
        contract.queries()[name](spark, ROOT)
    assert asked == [3]


def test_the_key_of_two_lines_is_both_keys(spark):
    from folioworks.functions.text import spaced_key

    odd = ["", " ", "ß", "straße 5", "a.b", "-x-", "  two  words ", "é日", "İstanbul", "line end", "A"]
    d = spark.createDataFrame([(a, b) for a in odd for b in odd], "a string, b string")
    whole, both = spaced_key(F.concat_ws(" ", "a", "b")), F.trim(F.concat_ws(" ", spaced_key(F.col("a")), spaced_key(F.col("b"))))
    assert d.where(whole != both).isEmpty()
