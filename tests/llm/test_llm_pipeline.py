"""The pipeline on a small corpus, stage by stage against plain code."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_llm_operators import components  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A corpus with toxic words, a line every page has, copies, near copies and personal data."""
    root = tmp_path_factory.mktemp("corpus")
    rows, labels = [], []
    for i in range(1, 121):
        body = " ".join(f"w{(i * 31 + k * k) % 4001}q" for k in range(60))
        if i % 4 == 0:
            body += f" you moron number {i} here"
        rows.append((i, f"menu home about\n{body}\nwrite to user{i}@mail.example.com", "en", "site", 0))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(200 + k, rows[0][1], "en", "site", 0) for k in range(3)] + [(300, rows[2][1].replace("w", "w", 1) + " end", "en", "site", 0), (400, None, "en", "site", None), (401, "", "en", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root)


def test_stages_in_turn(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.common.written(stage(spark, docs, folder), "t")
        seen.append({r.doc_id: r for r in docs.collect()})
        if name != "packing":
            assert docs.columns == COLUMNS
            assert docs.count() == len(seen[-1])
    clean, lines, single, masked, packed = seen
    assert set(clean) == {i for i in before if i > 120 or i % 4}
    assert set(lines) == set(clean) and all("menu home" not in (r.text or "") for r in lines.values())
    assert lines[400].text is None and lines[401].text == "" and all(r.n_chars == len(r.text) for r in lines.values() if r.text is not None)
    want = components({i: r.text for i, r in lines.items()}, 5, 80)
    assert set(single) == {i for i, (_, top) in want.items() if i == top}
    assert all("[EMAIL]" in r.text and "@" not in r.text for i, r in masked.items() if i <= 300) and set(masked) == set(single)
    assert set(packed) == set(masked)


def test_run_is_the_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.where("offset + length > 4096").isEmpty() and out.where("start = 0").count() == out.select("doc_id").distinct().count()
