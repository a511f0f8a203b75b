"""Copies, near copies and records of the same person, linked without comparing all pairs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioworks import vocab
from folioworks.functions import text as t
from folioworks.functions.similarity import indel_ratio, token_set_may_reach, token_set_ratio
from folioworks.operators import simjoin
from folioworks.operators.graph import connected_components
from folioworks.session import cut_lineage, spread
from folioworks.shipping import ship_by_value

ship_by_value(__name__)

_BANDS = 12


def star_links(df: DataFrame, id_: str, key: list[str], reason: str) -> DataFrame:
    """One link from every member of an equal-key group to its smallest member: linear, however large the group."""
    reps = df.groupBy(*key).agg(F.min(id_).alias("a"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return (
        df.select(id_, *key).join(reps.hint("merge"), key).where(F.col(id_) != F.col("a"))
        .select("a", F.col(id_).alias("b"), F.lit(reason).alias("reason"))
    )


def registration_numbers(lines: DataFrame, key: str = "file") -> DataFrame:
    """Ten-digit numbers starting 0-2, digit runs joined over spaces and dots first; distinct per document."""
    joined = F.regexp_replace("text", r"(?<=\d)[\s.](?=\d)", "")
    hits = F.regexp_extract_all(joined, F.lit(r"(?<!\d)([0-2]\d{9})(?!\d)"), 1)
    return lines.where("role <> 'notes'").select(key, F.explode(hits).alias("number")).distinct()


@F.pandas_udf(T.StructType([T.StructField(f"s{i}", T.LongType()) for i in range(4)]))
def _fold_hashes(hashes: pd.Series) -> pd.DataFrame:
    """256 sign bits of the summed token hashes; each token hash is stretched to four words."""
    steps = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], dtype=np.uint64)
    out = np.zeros((len(hashes), 4), dtype=np.int64)
    for i, h in enumerate(hashes):
        if h is None or len(h) == 0:
            continue
        x = np.asarray(h, dtype=np.int64).view(np.uint64)[:, None] * steps[None, :]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        votes = np.unpackbits(np.ascontiguousarray(x).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(votes * 2 > len(h), bitorder="little").view(np.int64)
    return pd.DataFrame(out, columns=["s0", "s1", "s2", "s3"])


def text_signature(df: DataFrame, id_: str, text: str) -> DataFrame:
    """256-bit signature of the whole text in four longs. Tokens are hashed by Spark; only the folding is numpy."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return df.select(id_, _fold_hashes(F.transform(words, lambda w: F.xxhash64(w))).alias("s")).select(id_, "s.*")


def bits_apart(a: str, b: str) -> Column:
    return reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(4)])


def _band_keys() -> Column:
    """Two untouched bands are certain when at most ten bits differ, so each pair of the 12 bands is a key."""
    bands = []
    for w in range(4):
        for lo, width in ((0, 21), (21, 21), (42, 22)):
            bands.append(F.shiftrightunsigned(F.col(f"s{w}"), lo).bitwiseAND((1 << width) - 1))
    return F.array(*[F.xxhash64(F.lit(i * _BANDS + j), bands[i], bands[j]) for i, j in combinations(range(_BANDS), 2)])


def linked_within_buckets(members: DataFrame, near: Callable[[str, str], Column], passes: int = 2) -> DataFrame:
    """Links (a, b) whose components equal those of every near pair that shares a bucket.

    `members` has id, bucket and whatever `near` reads through the aliases given to it. First each bucket's
    members are compared with one pivot, a few times with different pivots: a hot bucket of copies is joined up
    at linear cost. Then only members still outside their bucket's largest component are compared with the rest
    of the bucket, which finds every link the pivots missed.
    """
    members = cut_lineage(members)
    crowd = members.groupBy("bucket").agg(F.count("*").alias("_n")).where("_n > 1").select("bucket")
    members = cut_lineage(members.join(crowd, "bucket", "left_semi"))
    rest = [c for c in members.columns if c != "bucket"]
    found = []
    for k in range(passes):
        pick = F.min_by(F.struct(*rest), F.struct(F.xxhash64(F.lit(k), "id"), F.col("id"))) if k else F.min_by(F.struct(*rest), F.col("id"))
        pivots = members.groupBy("bucket").agg(pick.alias("p"))
        both = members.select("bucket", F.struct(*rest).alias("m")).join(pivots, "bucket").where("m.id <> p.id")
        found.append(both.where(near("m", "p")).select(F.least("m.id", "p.id").alias("a"), F.greatest("m.id", "p.id").alias("b")))
    links = cut_lineage(reduce(DataFrame.union, found).distinct())
    comp = connected_components(links).select(F.col("node").alias("id"), "component")
    placed = members.join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = cut_lineage(placed)
    sizes = placed.groupBy("bucket", "component").agg(F.count("*").alias("_n"))
    main = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("_n", "component")).alias("_main"), F.count("*").alias("_k")).where("_k > 1").drop("_k")
    split = placed.join(main, "bucket")
    strays = split.where("component <> _main").select("bucket", F.struct(*rest, "component").alias("m"))
    others = split.select("bucket", F.struct(*rest, "component").alias("p"))
    extra = strays.join(others, "bucket").where(F.col("m.component") != F.col("p.component")).where(near("m", "p"))
    extra = extra.select(F.least("m.id", "p.id").alias("a"), F.greatest("m.id", "p.id").alias("b"))
    return links.union(extra).distinct()


def near_copy_links(signatures: DataFrame, id_: str, bits: int = vocab.SIGNATURE_BITS_APART) -> DataFrame:
    """Links between texts whose signatures differ in at most `bits` (<= 10) bits, equal ones collapsed first."""
    if bits > _BANDS - 2:
        raise ValueError("the band keys guarantee ten differing bits at most")
    key = ["s0", "s1", "s2", "s3"]
    signed = cut_lineage(signatures)
    same = star_links(signed, id_, key, "same signature").select("a", "b")
    reps = signed.groupBy(*key).agg(F.min(id_).alias("id"))
    members = reps.select("id", *key, F.explode(F.array_distinct(_band_keys())).alias("bucket"))
    near = linked_within_buckets(members, lambda m, p: bits_apart(m, p) <= bits)
    return same.union(near)


def _both_names(pairs: DataFrame, names: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b) with the columns of both as structs m and p."""
    m = names.select(F.col("id").alias("a"), F.struct(*columns).alias("m"))
    p = names.select(F.col("id").alias("b"), F.struct(*columns).alias("p"))
    return pairs.join(m.hint("merge"), "a").join(p.hint("merge"), "b")


def same_name_links(people: DataFrame, id_: str, similarity: float = vocab.NAME_SIMILARITY) -> DataFrame:
    """Records whose student names agree and whose father names agree (or one is blank).

    Equal names are linked to their smallest record. Different ones meet if they share a key of the student's
    name, and of the father's where that is crowded; every pair over the cutoff does (see simjoin). Candidates are
    dropped by lengths and Levenshtein distance, which never exceeds the distance the ratio is made of, before scoring.
    """
    keyed = people.select(F.col(id_).alias("id"), t.name_key(F.col("student_name")).alias("s"), t.name_key(F.col("father_name")).alias("f")).where("s <> ''")
    keyed = cut_lineage(keyed)
    copies = star_links(keyed, "id", ["s", "f"], "same names").select("a", "b")
    reps = cut_lineage(spread(keyed.groupBy("s", "f").agg(F.min("id").alias("id"))))
    cut = simjoin.word_set_keys(simjoin.word_set_keys(reps, "s", similarity, "hs", "os"), "f", similarity, "hf", "of")
    cut = cut_lineage(cut.withColumn("about", F.struct(*[simjoin.letter_bag(F.col(c), True).alias(c) for c in ("s", "f")])))
    h = simjoin.hashed
    # either father's name may be the one that holds
    fathers = lambda one, two: F.when(F.col("f") != "", F.concat(h(F.col(one), 1), h(F.col(two), 2)))
    index = cut.select("id", h(F.col("hs")).alias("first"), fathers("hf", "of").alias("second"), "about")
    probe = cut.select("id", h(F.col("os")).alias("first"), fathers("of", "hf").alias("second"), "about")

    def fits(a: Column, b: Column) -> Column:
        blank = (a["f"]["n"] == 0) | (b["f"]["n"] == 0)
        return simjoin.bags_may_reach(a["s"], b["s"], similarity, True) & (blank | simjoin.bags_may_reach(a["f"], b["f"], similarity, True))

    pairs = _both_names(simjoin.meeting(index, probe, fits), reps, ["s", "f"])
    no_father = (F.col("m.f") == "") | (F.col("p.f") == "")
    cutoff = similarity * 100
    maybe = pairs.where(token_set_may_reach(F.col("m.s"), F.col("p.s"), cutoff) & (no_father | token_set_may_reach(F.col("m.f"), F.col("p.f"), cutoff)))
    maybe = cut_lineage(spread(maybe))
    near = (token_set_ratio(F.col("m.s"), F.col("p.s")) >= cutoff) & (no_father | (token_set_ratio(F.col("m.f"), F.col("p.f")) >= cutoff))
    return copies.union(maybe.where(near).select("a", "b")).distinct()


def same_parent_links(people: DataFrame, id_: str, cutoff: float = 95.0) -> DataFrame:
    """Records of one household: both parents' names nearly equal.

    Names meet by a segment of the father's name, and of the mother's where that is crowded.
    """
    keyed = people.select(F.col(id_).alias("id"), t.name_key(F.col("father_name")).alias("f"), t.name_key(F.col("mother_name")).alias("m")).where("f <> '' and m <> ''")
    keyed = cut_lineage(keyed)
    copies = star_links(keyed, "id", ["f", "m"], "same parents").select("a", "b")
    reps = cut_lineage(spread(keyed.groupBy("f", "m").agg(F.min("id").alias("id"))))
    cut = simjoin.segment_keys(simjoin.segment_keys(reps, "f", cutoff / 100, "hf", "of"), "m", cutoff / 100, "hm", "om")
    cut = cut_lineage(cut.withColumn("about", F.struct(*[simjoin.letter_bag(F.col(c), False).alias(c) for c in ("f", "m")])))
    h = simjoin.hashed
    # the shorter father's name holds the segments; either mother's name may be the shorter one
    index = cut.select("id", h(F.col("hf")).alias("first"), F.concat(h(F.col("hm"), 1), h(F.col("om"), 2)).alias("second"), "about")
    probe = cut.select("id", h(F.col("of")).alias("first"), F.concat(h(F.col("om"), 1), h(F.col("hm"), 2)).alias("second"), "about")
    fits = lambda a, b: simjoin.bags_may_reach(a["f"], b["f"], cutoff / 100, False) & simjoin.bags_may_reach(a["m"], b["m"], cutoff / 100, False)
    pairs = _both_names(simjoin.meeting(index, probe, fits), reps, ["f", "m"])

    def may(x: str) -> Column:
        a, b = F.col(f"m.{x}"), F.col(f"p.{x}")
        return F.levenshtein(a, b) <= (1 - cutoff / 100) * (F.length(a) + F.length(b)) + 1e-9

    maybe = cut_lineage(spread(pairs.where(may("f") & may("m"))))
    near = (indel_ratio(F.col("m.f"), F.col("p.f")) >= cutoff) & (indel_ratio(F.col("m.m"), F.col("p.m")) >= cutoff)
    return copies.union(maybe.where(near).select("a", "b")).distinct()


def entity_links(records: DataFrame, numbers: DataFrame | None = None, signatures: DataFrame | None = None, id_: str = "file") -> DataFrame:
    """Same-entity links with their reasons, and same-household links where no same-entity link exists.

    `records` has the id, sha256 and the three names; `numbers` (id, number); `signatures` (id, s0..s3).
    """
    legs = [star_links(records.where("sha256 is not null"), id_, ["sha256"], "identical file bytes")]
    if signatures is not None:
        legs.append(near_copy_links(signatures, id_).withColumn("reason", F.lit("near-identical text signature")))
    if numbers is not None:
        legs.append(star_links(numbers, id_, ["number"], "shared registration number"))
    legs.append(same_name_links(records, id_).withColumn("reason", F.lit("student and father names agree")))
    order = lambda d: d.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "reason")
    person = reduce(DataFrame.unionByName, [order(x) for x in legs]).groupBy("a", "b").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    person = cut_lineage(person.withColumn("relation", F.lit("same_student")).withColumn("same_bytes", F.array_contains("reasons", "identical file bytes")))
    comp = connected_components(person)
    home = same_parent_links(records, id_)
    ca = comp.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    cb = comp.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    house = (
        home.join(ca.hint("merge"), "a", "left").join(cb.hint("merge"), "b", "left").where(~F.coalesce(F.col("ca") == F.col("cb"), F.lit(False)))
        .select("a", "b", F.array(F.lit("both parents' names match")).alias("reasons"), F.lit("same_parents_different_student").alias("relation"), F.lit(False).alias("same_bytes"))
    )
    return person.unionByName(house)
