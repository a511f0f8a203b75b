"""Importance resampling towards a target corpus, by hashed words and short runs of words.

A dictionary of distinct words, each between two delimiters, becomes an Aho-Corasick automaton whose payloads are the CRC-32
and the length of the word. One scan of a text emits the payloads in order; the CRC of a run of words is composed of the
payloads next to each other, without touching the characters again. The CRC modulo the number of buckets is the feature's
bucket. Buckets are counted over both corpora, every bucket gets a gain (the log ratio of its two smoothed shares), every
document the mean gain of its features, and documents are drawn by the Gumbel trick.

The dictionary holds the frequent words of both corpora, DICTIONARY of them at most and none over LONGEST characters, so its
size is bounded whatever the data. Words it lacks stand in the gaps between two hits and get their CRC on the spot: no word
is left out, and the dictionary's size changes the time, never a result.

A null or empty text has no words, no features and weight 0. A null id is drawn by the hash of an empty one. Repeated rows
are rows of their own; rows equal in everything may change places. Extra columns do not matter. An empty table, or an empty
target, gives gains from what there is; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.llm import common
from folioworks.operators.ranking import number_rows
from folioworks.shipping import ship_by_value

BUCKETS = 10_000
#: Words in the automaton at most, and characters of the longest of them.
DICTIONARY = 100_000
LONGEST = 64
#: Frequency classes to a doubling, when the dictionary's least count is chosen.
CLASSES = 4

#: Every byte that is no part of a word becomes a blank, A-Z become a-z.
_PLAIN = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def plain(text: str | None) -> str:
    """The words of a text in lower case, one blank before, between and after them; a lone blank if there is none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).split()
    return (b" %b " % b" ".join(words)).decode("utf-8", "surrogatepass") if words else " "


# The CRC of two strings set together, from the CRCs of both and the length of the second.


def _zeros() -> list[np.ndarray]:
    """For k = 0, 1, ...: what 2**k bytes of zero do to a CRC, as one table for each of its four bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> np.uint32(1)) ^ np.uint32(0xEDB88320), step >> np.uint32(1))
    values = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    tables = [(values >> np.uint32(8)) ^ step[values & np.uint32(255)]]
    for _ in range(31):
        tables.append(_through(tables[-1], tables[-1]))
    return tables


def _through(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & np.uint32(255)] ^ table[1][(crc >> np.uint32(8)) & np.uint32(255)] ^ table[2][(crc >> np.uint32(16)) & np.uint32(255)] ^ table[3][crc >> np.uint32(24)]


def composed(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of first + second, `length` being the bytes of the second."""
    state = common.worker_state()
    if "crc_zeros" not in state:
        state["crc_zeros"] = _zeros()
    out = first.astype(np.uint32)
    for k in range(int(length.max(initial=0)).bit_length()):
        on = (length >> k) & 1 == 1
        out[on] = _through(state["crc_zeros"][k], out[on])
    return out ^ second.astype(np.uint32)


def run_crcs(crc: np.ndarray, size: np.ndarray, longest: int) -> np.ndarray:
    """CRCs of all runs of 1 to `longest` words next to each other, joined by one blank."""
    blank = np.uint32(zlib.crc32(b" "))
    found = [crc.astype(np.uint32)]
    for k in range(1, min(longest, len(crc))):
        before = composed(found[-1][:-1], np.full(len(crc) - k, blank), np.ones(len(crc) - k, dtype=np.int64))
        found.append(composed(before, crc[k:], size[k:]))
    return np.concatenate(found)


# The automaton.


def _automaton(words: Sequence[tuple[str, int, int]]):
    import ahocorasick

    out = ahocorasick.Automaton(ahocorasick.STORE_ANY)
    for word, crc, size in words:
        out.add_word(f" {word} ", crc | size << 32 | len(word) << 48)
    if len(out):
        out.make_automaton()
    return out


def payloads(automaton, text: str) -> tuple[np.ndarray, np.ndarray]:
    """CRC and bytes of every word of a plain text, in order: of the automaton's hits, and of the words in the gaps between."""
    hits = np.fromiter(chain.from_iterable(automaton.iter(text)), np.int64) if len(automaton) else np.zeros(0, np.int64)
    ends, load = hits[0::2], hits[1::2]
    crc, size = load & 0xFFFFFFFF, (load >> 32) & 0xFFFF
    opened = np.append(ends - (load >> 48) - 1, len(text) - 1)  # the blank before each hit, and the last of all
    closed = np.insert(ends, 0, 0)  # the blank after each hit, and the first of all
    at, more_crc, more_size = [], [], []
    for g in np.flatnonzero(opened > closed).tolist():
        for word in text[closed[g] : opened[g]].encode("utf-8", "surrogatepass").split():
            at.append(g)
            more_crc.append(zlib.crc32(word))
            more_size.append(len(word))
    return np.insert(crc, at, more_crc), np.insert(size, at, more_size)


# The steps in Spark.


def _words(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def dictionary(texts: DataFrame, limit: int = DICTIONARY) -> list[tuple[str, int, int]]:
    """(word, CRC, bytes) of the most frequent words of `texts` (one column, text), `limit` at most.

    Words are counted by Spark. The driver first sees how many words each frequency class has, some hundred rows, then the
    words of the classes that fit.
    """
    counts = texts.select(F.explode(_words(F.col("text"))).alias("word")).where(f"word <> '' AND length(word) <= {LONGEST}").groupBy("word").agg(F.count("*").alias("n"))
    counts = common.written(counts.withColumn("kind", F.floor(F.log2("n") * CLASSES).cast("int")), "words")
    held, least = 0, None
    for kind, n in sorted(((r.kind, r.n) for r in counts.groupBy("kind").agg(F.count("*").alias("n")).collect()), reverse=True):
        if held + n > limit:
            break
        held, least = held + n, kind
    if least is None:
        return []
    chosen = counts.where(F.col("kind") >= least).select("word", F.crc32(F.encode("word", "UTF-8")), F.octet_length("word"))
    return [tuple(r) for r in chosen.collect()]


def bucketed(df: DataFrame, words: list[tuple[str, int, int]], keep: Sequence[str], runs: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """`keep`, n_words (long) and the bucket of every feature (array of int), repeats included; written once."""
    sent, token = df.sparkSession.sparkContext.broadcast(words), uuid.uuid4().hex

    def scan(texts):
        state = common.worker_state()
        if state.get("resample_token") != token:
            state["resample_token"], state["resample_automaton"] = token, _automaton(sent.value)
        n_words, flat, offsets = [], [], [0]
        for t in texts:
            crc, size = payloads(state["resample_automaton"], plain(t))
            found = run_crcs(crc, size, runs) % np.uint32(buckets)
            n_words.append(len(crc))
            flat.append(found.astype(np.int32))
            offsets.append(offsets[-1] + len(found))
        values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32))
        return [pa.array(n_words, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)]

    return common.written(common.map_texts(df, scan, [("n_words", "long"), ("buckets", "array<int>")], keep), "buckets")


def counted(bucketed_: DataFrame) -> DataFrame:
    """(bucket, n) over all documents."""
    return bucketed_.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """A whole-numbered gain for every bucket, in thousandths: how much more of the target than of the documents falls into it.

    `docs` and `target` are (bucket, n). The result has as many rows as there are buckets, whatever the data.
    """
    both = docs.select("bucket", F.col("n").alias("s")).join(target.select("bucket", F.col("n").alias("t")), "bucket", "full")
    both = {r.bucket: (r.s or 0, r.t or 0) for r in both.collect()}
    rows = [(b, *both.get(b, (0, 0))) for b in range(buckets)]
    all_s, all_t = sum(r[1] for r in rows), sum(r[2] for r in rows)
    num = (F.col("t") + 1).cast("double") * F.lit(float(all_s + buckets))
    den = (F.col("s") + 1).cast("double") * F.lit(float(all_t + buckets))
    table = docs.sparkSession.createDataFrame(rows, "bucket int, s long, t long")
    found = table.select("bucket", F.floor(1000 * F.log(num / den)).alias("gain")).collect()
    return [r.gain for r in sorted(found)]


def weighed(bucketed_: DataFrame, gain: list[int], keep: Sequence[str]) -> DataFrame:
    """`keep`, n_words, n_features and weight (long): the mean gain of the features, rounded down."""
    sent, keep = bucketed_.sparkSession.sparkContext.broadcast(np.array(gain, dtype=np.int64)), list(keep)
    src = bucketed_.select(*keep, "n_words", "buckets")

    def run(batches):
        for b in batches:
            lists = b.column(len(keep) + 1)
            at = lists.offsets.to_numpy().astype(np.int64)
            total = np.append(0, np.cumsum(sent.value[lists.values.to_numpy()]))[at]
            n = np.diff(at)
            weight = np.where(n > 0, np.diff(total) // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep) + 1)), pa.array(n), pa.array(weight)], names=[*keep, "n_words", "n_features", "weight"])

    kept = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep)
    return src.mapInArrow(run, f"{kept}, n_words long, n_features long, weight long")


def gumbel(id_: Column, seed: int) -> Column:
    """Floor of a thousandfold standard Gumbel value, told by the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def drawn(weights: DataFrame, percent: int, least_words: int, seed: int, id_: str = "doc_id") -> DataFrame:
    """All rows with score and rank (long): 1, 2, 3 ... over the drawn, null for the rest.

    Of the n documents with `least_words` or more, floor(percent * n / 100) of highest score are drawn, ties to the smaller id.
    """
    scored = common.written(weights.withColumn("score", F.col("weight") + gumbel(F.col(id_), seed)), "scored")
    able = F.col("n_words") >= least_words
    n = percent * scored.where(able).count() // 100
    order = [F.desc("score"), F.asc(id_), *[F.asc(c) for c in scored.columns if c not in ("score", id_)]]
    ranked = number_rows(scored.where(able), order, "rank").withColumn("rank", F.when(F.col("rank") <= n, F.col("rank")).cast("long"))
    return ranked.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024, runs: int = 1, buckets: int = BUCKETS, words: int = DICTIONARY
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document of `docs`, resampled towards the texts of `target`."""
    known = dictionary(docs.select("text").unionByName(target.select("text")), words)
    mine = bucketed(docs.select("doc_id", "text"), known, ["doc_id"], runs, buckets)
    theirs = bucketed(target.select("text"), known, [], runs, buckets)
    gain = gains(counted(mine), counted(theirs), buckets)
    return drawn(weighed(mine, gain, ["doc_id"]), percent, least_words, seed)


ship_by_value(__name__)
