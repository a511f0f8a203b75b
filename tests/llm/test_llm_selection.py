"""Resampling, clustering and license templates on small tables, against brute force and planted cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

pytest.importorskip("public_tokenizers")

from folioworks.llm import centroids, licenses, queries, resample  # noqa: E402

ROOT = "/root/testdata/sf0.001"
DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("n_words", T.LongType()), T.StructField("buckets", T.StringType()), T.StructField("labels", T.StringType()),
])
LONG = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
ODD = [None, "", " \n\t-- ", LONG, "a b a b " * 30, "twice the same " * 9, "twice the same " * 9, "Ünïcode ½ 字漢 👩 ΑΣ ABC Abc x_y 7up", "x" * 5000 + " y", "end"]
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, texts, ids=None):
    """Documents with extra columns whose names clash with those the operators make."""
    return spark.createDataFrame([(i, t, 0.5, 1, "mine", "mine") for i, t in zip(ids or range(1, len(texts) + 1), texts)], DOCS)


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


# Resampling.


def test_payloads_are_the_words_in_order():
    rng = random.Random(5)
    vocabulary = ["a", "b", "ab", "ba", "字", "aé", "long" * 20, "x1"]
    for known in ([], ["a"], ["ab", "字"], ["a", "b", "ab", "ba", "字", "aé", "x1"]):
        automaton = resample._automaton([(w, zlib.crc32(w.encode()), len(w.encode())) for w in known])
        for n in (0, 1, 2, 5, 40):
            words = [rng.choice(vocabulary) for _ in range(n)]
            crc, size = resample.payloads(automaton, resample.plain(" , ".join(words)))
            assert crc.tolist() == [zlib.crc32(w.encode()) for w in words]
            assert size.tolist() == [len(w.encode()) for w in words]


def test_composed_payloads_are_the_crcs_of_runs():
    words = ["alpha", "字漢", "c", "d" * 300, "epsilon", "f"]
    load = [np.array([fn(w.encode()) for w in words]) for fn in (zlib.crc32, len)]
    for longest in (1, 2, 3, 9):
        want = [zlib.crc32(" ".join(words[i : i + k]).encode()) for k in range(1, min(longest, 6) + 1) for i in range(7 - k)]
        assert resample.run_crcs(*load, longest).tolist() == want
    assert resample.run_crcs(load[0][:0], load[1][:0], 3).tolist() == []


def brute_resample(rows, target, percent, least, seed, runs, buckets):
    def features(text):
        w = words_of(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, runs + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(b for _, x in rows for b in features(x)), Counter(b for x in target for b in features(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for i, x in rows:
        f = features(x)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(words_of(x)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, *r[1:4]))
    drawn = able[: percent * len(able) // 100]
    return sorted(((*r, None) for r in [*(r for r in out if r[1] < least), *able[len(drawn) :]]), key=str), [(*r, k) for k, r in enumerate(drawn, 1)]


@pytest.mark.parametrize(("runs", "known"), [(1, 100_000), (3, 100_000), (2, 12), (1, 0)])
def test_resampling_equals_brute_force(spark, runs, known):
    rows = [(i + 1, t) for i, t in enumerate(ODD)] + [(6, ODD[5]), (None, "no id " * 12)]
    rows += [(100 + r.doc_id, r.text) for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{ROOT}/benchmark.parquet").collect()] + [None, ""]
    docs = documents(spark, [t for _, t in rows], [i for i, _ in rows])
    theirs = spark.createDataFrame([(t,) for t in target], "text string")
    got = [tuple(r) for r in resample.resample(docs, theirs, 30, 5, 11, runs, 997, known).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()]
    rest, drawn = brute_resample(rows, target, 30, 5, 11, runs, 997)
    assert sorted((r for r in got if r[5] is not None), key=lambda r: r[5]) == drawn
    assert sorted((r for r in got if r[5] is None), key=str) == rest


def test_resampling_without_rows(spark):
    none = documents(spark, [])
    assert resample.resample(none, none).count() == 0
    out = resample.resample(documents(spark, ["some words here " * 10]), none).collect()
    assert len(out) == 1 and out[0].rank is None  # a tenth of one document is none


# Clustering.


def brute_clusters(points, first, rounds):
    c = first.copy()
    for r in range(rounds + 1):
        d = ((points[:, None, :] - c[None]) ** 2).sum(axis=2)
        own = d.argmin(axis=1)
        if r < rounds:
            for j in range(len(c)):
                if (own == j).any():
                    c[j] = [int(v) // int((own == j).sum()) for v in points[own == j].sum(axis=0)]
    return own, d.min(axis=1), c


@pytest.mark.parametrize("seed", range(6))
def test_orchard_search_equals_brute_force_and_measures_less(seed):
    rng = np.random.default_rng(seed)
    hubs = rng.integers(-300, 300, (12, 8))
    c = hubs[rng.integers(0, 12, 30)] + rng.integers(-9, 9, (30, 8)) * (seed % 2)  # with seed even: many equal centroids
    x = np.concatenate([hubs[rng.integers(0, 12, 5000)] + rng.integers(-25, 25, (5000, 8)), (c[:-1] + c[1:]) // 2, c])
    own, dist, measured = centroids.Orchard(c).nearest(x)
    d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (own == d.argmin(axis=1)).all() and (dist == d.min(axis=1)).all()
    assert measured.mean() < 0.75 * len(c)


def test_ties_at_exactly_twice_the_distance_find_the_smaller_number():
    c = np.array([[100, 0], [4, 0], [0, 0]])
    own, dist, _ = centroids.Orchard(c).nearest(np.array([[2, 0]]))  # the gap of 1 and 2 is twice the distance of both
    assert (own[0], dist[0]) == (1, 4)


def test_clusters_equal_brute_force_on_odd_rows(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{ROOT}/embeddings.parquet").collect()]
    rows += [(rows[0][0], rows[0][1])] * 40 + [(None, rows[1][1])]
    odd = [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [None] + [0.0] * 63), (905, [float("nan")] + [0.0] * 63), (906, [float("-inf")] + [0.0] * 63), (907, [1e30] + [0.0] * 63)]
    schema = "vec_id long, embedding array<float>, cluster string, x int"
    df = spark.createDataFrame([(i, v, "mine", 1) for i, v in rows + odd], schema)
    x = np.array([[math.floor(256 * float(np.float32(v))) for v in vec] for _, vec in rows])
    name = lambda i: "" if i is None else str(i)
    order = sorted(range(len(rows)), key=lambda i: (hashlib.sha256(f"2:{name(rows[i][0])}".encode()).hexdigest(), rows[i][0] or 0, x[i].tolist()))
    own, dist, c = brute_clusters(x, x[order[:7]], 4)
    got = centroids.cluster(df, k=7, rounds=4, seed=2).collect()
    want = sorted((name(i), int(a), int(d), int(dist[own == a].sum()), int(dist.sum()), centroids.spelt(c[a])) for (i, _), a, d in zip(rows, own, dist))
    assert sorted((name(r.vec_id), *tuple(r)[1:6]) for r in got) == want
    few = centroids.cluster(df.where("vec_id = 902 or vec_id = 1"), k=40, rounds=2).collect()
    assert [(r.vec_id, r.cluster, r.distance, r.inertia) for r in few] == [(1, 0, 0, 0)]
    assert centroids.cluster(df.limit(0)).count() == 0
    assert centroids.cluster(df.where("vec_id > 900")).count() == 0


# Licenses.


def as_pattern(steps):
    out = ""
    for kind, value in steps:
        out += re.escape(f" {value}") if kind == "word" else f"(?: [^ ]+){{0,{value}}}" if kind == "any" else f"(?:{as_pattern(value)})?"
    return out


def printed(steps, rng):
    """A text that the template accepts, its free regions filled by chance."""
    out = []
    for kind, value in steps:
        if kind == "word":
            out.append(value)
        elif kind == "any":
            out += [f"name{rng.randint(0, 9)}" for _ in range(rng.randint(0, value))]
        elif rng.random() < 0.5:
            out += printed(value, rng)
    return out


def test_templates_accept_what_their_markup_says():
    rng = random.Random(3)
    accepted = 0
    for label, markup in licenses.TEMPLATES:
        automaton, steps = licenses.compiled(label, markup), licenses.parsed(markup)
        while steps[0][0] != "word":
            steps = steps[1:]
        pattern = re.compile(as_pattern(steps))
        for _ in range(60):
            words = printed(steps, rng)
            if rng.random() < 0.5:  # one word changed, lost or added
                i = rng.randrange(len(words))
                words[i : i + 1] = rng.choice([[], ["other"], [words[i], "more"]])
            whole, part = automaton.run(words, 0)
            assert whole == bool(pattern.match(" " + " ".join(words))), (label, words)
            assert 0 <= part <= 1 and (part == 1) == whole
            accepted += whole
    assert accepted > 300


def test_bad_markup_is_refused():
    for markup in ("<<beginOptional>> a", "a <<endOptional>> b", "<<var;name=x;max=3>>"):
        with pytest.raises(ValueError):
            licenses.compiled("x", markup)


MIT = """MIT License — Copyright © 2024 Some Body

# Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
# (the “Software”), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
# publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
# subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
# substantial portions of the Software. THE SOFTWARE IS PROVIDED “AS IS”, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
# NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE GOOD
# PEOPLE OF NOWHERE BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING
# FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def test_licenses_in_documents(spark):
    texts = [
        MIT, MIT.replace("free of charge", "for a fee"), "code. Licensed under the Apache License,\n// Version 2.0", "the mit license. THE MIT LICENSE; apache license",
        "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "licensed under the GNU Lesser General Public License", "x " * 200_000 + "Licensed under the Apache License, Version 2.0 " * 2000, *ODD,
    ]
    got = {r.doc_id: r for r in licenses.scan(documents(spark, texts), ["doc_id", "text", "score", "labels"]).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts, 1):
        w = words_of(t)
        places = sorted((k, label) for phrase, label in licenses.PHRASES for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split())
        assert (got[i].n_words, got[i].n_base) == (len(w), len(places))
        assert (got[i].first_word, got[i].last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert got[i].base_labels == sorted({x for _, x in places}) and set(got[i].base_labels) <= set(got[i].labels)
        assert 0 <= got[i].score <= 1
    assert (got[1].labels, got[1].score) == (["mit"], 1.0)
    assert got[2].labels == ["mit"] and got[2].score == 0.5  # the title names it, the changed text is not accepted
    assert got[3].labels == ["apache", "apache-2.0"] and got[4].labels == ["apache", "mit"] and got[4].n_base == 3
    assert [got[i].labels for i in (5, 6, 7)] == [["mit"], ["cc-by-nc"], ["gpl"]] and got[8].n_base == 2000
    assert all(not got[i].labels and got[i].score == 0 for i in range(9, len(texts) + 1))
    assert licenses.scan(documents(spark, []), ["doc_id"]).count() == 0


def test_registered_license_query_covers_every_document(spark):
    rows = queries.license_labels(spark, "/root/testdata/sf0.01").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        w = f" {' '.join(words_of(docs[r.doc_id]))} "
        assert r.n_base == sum(len(re.findall(f"(?= {p} )", w)) for p, _ in licenses.PHRASES)
        assert ("cc-by-nc" in r.labels.split(",")) == (" licensed under cc by nc " in w)


def test_registered_queries_name_their_columns(spark):
    assert queries.resample_documents(spark, ROOT).columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert queries.centroid_clusters(spark, ROOT).where(F.col("cluster").isNull()).count() == 0
